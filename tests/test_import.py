"""The entry module can be imported and list its queries before there is a session."""

import os
import subprocess
import sys


def test_import_without_session():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=repo, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
