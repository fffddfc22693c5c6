"""The registered queries: columns that their contracts fix, against plain Python over the smallest tables; and the pipeline's stages on odd rows."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import ODD, RULES, WORD, brute_base, brute_classes, brute_lines, brute_statistics, shingle_sets

from weftline.llm import mixing, queries, urls


def crc(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by == 0


def rows(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def run(spark, folder, name, key):
    found = queries.QUERIES[name](spark, folder).collect()
    by_key = {r[key]: r for r in found}
    assert len(by_key) == len(found)
    return by_key


def test_op1(spark, folder):
    docs = rows(spark, folder, "documents", "doc_id", "text")
    got = run(spark, folder, "op1_pitman_yor", "doc_id")
    learnt = [not crc(i, 10) for i, _ in docs]
    total = sum(len(WORD.findall(t or "")) + 1 for (_, t), ok in zip(docs, learnt, strict=True) if ok)
    for (i, _), ok, (n, known, base) in zip(docs, learnt, brute_base([t for _, t in docs], learnt), strict=True):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not ok, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op2(spark, folder):
    docs = rows(spark, folder, "documents", "doc_id", "text")
    want = brute_classes([i for i, _ in docs], shingle_sets([t for _, t in docs]))
    assert {i: r["class_id"] for i, r in run(spark, folder, "op2_minhash", "doc_id").items()} == want


def test_op3(spark, folder):
    got = run(spark, folder, "op3_url_filter", "page_id")
    for i, url in rows(spark, folder, "pages", "page_id", "url"):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.text if best else None)
        assert r["verdict"] in ("allow", "block") and (best is None or r["verdict"] == best.verdict)


def test_op4(spark, folder):
    docs = rows(spark, folder, "documents", "doc_id", "text")
    want = brute_lines(docs)
    got = run(spark, folder, "op4_line_dedup", "doc_id")
    assert sum(got[i]["text"] != want[i] for i in want) <= 1


def test_op5(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    got = run(spark, folder, "op5_bpe", "doc_id")
    for i, text in rows(spark, folder, "documents", "doc_id", "text"):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op7(spark, folder):
    got = run(spark, folder, "op7_quality_rules", "doc_id")
    for i, text in rows(spark, folder, "documents", "doc_id", "text"):
        r, want = got[i], brute_statistics(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["rule"] is None)


def test_op8(spark, folder):
    got = run(spark, folder, "op8_language_id", "doc_id")
    docs = rows(spark, folder, "documents", "doc_id", "text", "lang")
    for i, text, _ in docs:
        r = got[i]
        assert r["held_out"] == crc(i, 5) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    held = [(got[i]["lang_pred"], lang) for i, _, lang in docs if crc(i, 5)]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op9(spark, folder):
    vectors = {i: np.array(v, float) for i, v in rows(spark, folder, "embeddings", "vec_id", "embedding") if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    got = collections.defaultdict(list)
    for r in queries.QUERIES["op9_neighbours"](spark, folder).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in vectors if i % 50 == 0}
    hits = total = 0
    for q, found in got.items():
        cosine = {i: float(v @ vectors[q] / (np.linalg.norm(v) * np.linalg.norm(vectors[q]))) for i, v in vectors.items() if i != q}
        want = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(want) + 1))
        assert all(math.isclose(s, cosine[i], rel_tol=1e-12) for _, i, s in found)
        hits, total = hits + len({i for _, i, _ in found} & set(want)), total + len(want)
    assert hits >= 0.9 * total


def test_op10(spark, folder):
    got = run(spark, folder, "op10_mixing", "doc_id")
    docs = rows(spark, folder, "documents", "doc_id", "text", "source")
    sizes, taken = collections.Counter(), collections.Counter()
    for i, text, source in docs:
        assert got[i]["size"] == len(WORD.findall(text or "")) and got[i]["taken"] <= 3 * got[i]["size"]
        sizes[source] += got[i]["size"]
        taken[source] += got[i]["taken"]
    want = mixing.targets(dict(sizes))
    for i, _, source in docs:
        assert got[i]["source_size"] == sizes[source] and math.isclose(got[i]["target"], want[source])
    assert all(abs(taken[s] - t) <= max(0.1 * t, max(got[i]["size"] for i, _, x in docs if x == s)) for s, t in want.items())
    assert {i: r["shards"] for i, r in run(spark, folder, "op10_mixing", "doc_id").items()} == {i: r["shards"] for i, r in got.items()}


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and columns named like those of stages."""
    long = " ".join(f"word{i % 977}" for i in range(150_000))
    made = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", None if t is None else len(t), "x", 5) for i, t in enumerate([*ODD, long])]
    made += [(None, "no id here at all", "en", "s0", 17, "x", 5), (4, "a", "en", "s0", 1, "x", 5), (4, "a", "en", "s0", 1, "x", 5)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, mix_size string, n_tokens int")


def test_stages_on_odd_rows(spark, folder, odd_docs):
    import corpus_pipeline

    for now in (odd_docs, odd_docs.limit(0)):
        n = now.count()
        for name, stage in corpus_pipeline.STAGES:
            own = now.select("doc_id", "text", "lang", "source", "n_chars") if name == "mix_sources" else now
            out = stage(spark, own, folder)
            got = out.collect()
            assert len(got) <= (3 * n if name == "mix_sources" else n) and len(set(out.columns)) == len(out.columns)
            if name != "encode":
                assert out.columns == own.columns
            else:
                assert all(r["round_trip"] for r in got)
            if name == "language_id":
                assert all(any(c.isalpha() for c in r["text"]) for r in got)


def test_extreme_vectors(spark):
    """Cosines neither overflow nor vanish; many vectors that are equally near keep the order of their ids."""
    from weftline.llm import neighbours

    made = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [2.0, -1.0]), *((10 + i, [float(1 + i), 2.0 * (1 + i)]) for i in range(60))]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert len(got) == 5 and all(math.isclose(r["score"], 1.0, rel_tol=1e-15) for r in got)
    exact = {i: float(neighbours.cosine(np.array(made[0][1]), np.array(v))) for i, v in made if i}
    assert [r["vec_id"] for r in got] == sorted(exact, key=lambda i: (-exact[i], i))[:5]


def test_rules_without_any(spark):
    odd = spark.createDataFrame([(1, None), (2, "http://x.org/é")], "page_id long, url string")
    assert {r["__rule"] for r in urls.judge(odd, RULES).collect()} == {None, "org/"}
