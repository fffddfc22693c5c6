"""WARC archives compressed with a dictionary of their own.

Rows become WARC/1.1 records: a response, or a revisit that refers to the response with the same
payload. Records are dealt to archives by hash; each archive trains a Zstandard dictionary on an evenly
spaced sample of its own records (SAMPLE_BYTES, of each record its first RECORD_BYTES; where they are too
few or too alike to train on, the sample itself is the dictionary), embeds it in a leading skippable frame, and compresses each
record as a frame of its own, so any record can be read alone and lost frames harm no others. Archives
are written under an attempt's own name and renamed, so a task that runs again leaves one whole file;
only files that the manifest names are read back.

Rows: a null payload counts as empty, a null id is written as an empty one and read back as null. Rows
that repeat id and payload are as many records; of equal ids that hold the largest, all are responses.
Other columns take no part. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.staging import new_path, small_batches, staged, tidy

#: The magic number of the dictionary frame and of Zstandard frames.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES, RECORD_BYTES = 4 << 20, 128 << 10
#: Of fewer records the sample itself is the dictionary.
LEAST_SAMPLE = 8
ARCHIVE_BYTES = 48 << 20
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, key: str, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}:{sha1}')}>"


def header_uri(url: str) -> str:
    """A URI that may stand in a header: white space and unprintable characters as %XX of their UTF-8 bytes."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def record(kind: str, key: str, url: str, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """One WARC record. A revisit has no payload, only its digest and length."""
    body = b"" if kind == "revisit" else payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(kind, key, sha1)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", header_uri(url)),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("X-Row-Id", key),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("response", refers_to or "", sha1)), ("X-Refers-To-Row-Id", refers_to or "")] if kind == "revisit" else []),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(body))),
    ]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of another length than it states")
    return fields, rest[:size]


def archive(records: list[bytes], level: int = 3) -> bytes:
    """The bytes of an archive: its dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    every = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[:RECORD_BYTES] for r in records[::every]]
    dictionary = None
    if len(sample) >= LEAST_SAMPLE:
        with suppress(zstandard.ZstdError):  # too little to learn from
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 8)), sample)
    if dictionary is None:
        dictionary = zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=level)
    out = io.BytesIO()
    own = zstandard.ZstdCompressor(level=6).compress(dictionary.as_bytes())
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(own)) + own)
    coder = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    for r in records:
        out.write(coder.compress(r))
    return out.getvalue()


def opened(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    own = data[8 : 8 + size]
    if own.startswith(FRAME_MAGIC):
        own = zstandard.ZstdDecompressor().decompress(own)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
    rest = memoryview(data)[8 + size :]
    while rest:
        one = reader.decompressobj()
        yield one.decompress(rest)
        rest = memoryview(one.unused_data)


def _store(uri: str):
    """The file system and path of a URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def with_revisits(df: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``df`` with __refers_to: the largest id of those with an equal payload of at least ``least_bytes`` bytes, null for that row itself and for payloads that stand once.

    Payloads are compared by SHA-1 and length. Equal ones need not meet in one task: the largest id is a partial aggregate, and the join back may be split where it is skewed.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    keyed = df.withColumns({"__sha1": F.sha1(payload), "__bytes": F.octet_length(payload)})
    groups = keyed.filter(F.col("__bytes") >= least_bytes).groupBy(F.col("__sha1").alias("__s"), F.col("__bytes").alias("__b")).agg(F.max(id_col).alias("__last"), F.count("*").alias("__n")).filter("__n > 1")
    joined = keyed.join(groups, (F.col("__sha1") == F.col("__s")) & (F.col("__bytes") == F.col("__b")), "left")
    return joined.select(*[keyed[c] for c in df.columns], F.when(~F.col(id_col).eqNullSafe(F.col("__last")), F.col("__last")).alias("__refers_to"))


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Archives of all rows under ``folder``; returns the manifest (path, records, bytes), staged."""
    rows = with_revisits(df.select(id_col, url_col, payload_col), id_col, payload_col, least_bytes)
    rows = rows.select(*[F.col(c).cast("string").alias(n) for c, n in ((id_col, "key"), (url_col, "url"), (payload_col, "payload"), ("__refers_to", "refers_to"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            data = archive(kept)
            store, at = _store(folder)
            name = f"{at}/{hashlib.sha1(data).hexdigest()}.warc.zst"
            store.create_dir(at, recursive=True)
            with store.open_output_stream(draft := f"{name}.{uuid.uuid4().hex}", compression=None) as f:
                f.write(data)
            store.move(draft, name)
            made = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "records": pa.array([len(kept)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})
            kept.clear()
            return made

        kept: list[bytes] = []
        held = 0
        for batch in batches:
            for r in batch.to_pylist():
                payload = (r["payload"] or "").encode()
                kept.append(record("response" if r["refers_to"] is None else "revisit", r["key"] or "", r["url"] or "", payload, digest(payload), r["refers_to"]))
                held += len(kept[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush()
                    held = 0
        if kept:
            yield flush()

    small_batches(df.sparkSession)
    return staged(rows.mapInArrow(tidy(run), "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """All records of the archives that ``manifest`` names: record_type, key, url, payload_digest, payload_bytes, refers_to (keys), payload. A payload that does not match its digest fails."""
    fields = T.StructType([T.StructField(n, t) for n, t in (("record_type", T.StringType()), ("key", T.StringType()), ("url", T.StringType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _store(path)
                with store.open_input_stream(at, compression=None) as f:
                    data = f.read()
                rows: list[dict] = []
                held = 0
                for raw in opened(data):
                    head, body = parsed(raw)
                    kind, sha1 = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(body) != sha1 or len(body) != int(head["X-Payload-Length"])):
                        raise ValueError(f"{path}: payload of {head['X-Row-Id']} does not match its digest")
                    rows.append({"record_type": kind, "key": head["X-Row-Id"] or None, "url": head["WARC-Target-URI"], "payload_digest": sha1, "payload_bytes": int(head["X-Payload-Length"]), "refers_to": head.get("X-Refers-To-Row-Id") or None, "payload": body if kind == "response" else None})
                    held += len(body)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, fields_arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields_arrow)

    fields_arrow = pa.schema([("record_type", pa.string()), ("key", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
    return manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(tidy(run), fields)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """What :func:`read` finds in archives written of ``df`` to the shared folder."""
    return read(write(df, new_path(df.sparkSession, "archives"), id_col, url_col, payload_col, least_bytes))
