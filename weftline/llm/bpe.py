"""BPE encoding and decoding by a backtracking encoder.

A text is cut at special tokens and by the vocabulary's split pattern. For each cut, one pass of an
Aho-Corasick automaton over all tokens gives the longest token that begins at each byte. The encoder
goes on from the longest match, keeps it if it may follow the token before, else tries the next
shorter token, and steps back where none is left; positions that led nowhere are marked, so each is
left once and the time is linear. Two tokens may stand side by side if undoing their merges, later
merge first, never shows a merge across the border that would have come earlier. The tokens found are
exactly those of merging by rank. Decoding gathers token bytes by a table of offsets.

Rows: null and empty texts have no tokens and decode to the empty text. Any other columns pass
through; the columns named by ``ids_col``, ``count_col`` or ``decoded_col`` replace those of that name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.staging import small_batches, tidy

#: The split pattern of byte-level BPE vocabularies, white space as Unicode lists it.
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: What a process keeps of cuts and of pairs, each; full caches begin anew.
CACHE_ENTRIES = 150_000


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merges, pieces and tables of a byte-level BPE file in the JSON form of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        spelled = lambda s: bytes(letters[c] for c in s)
        ids = {spelled(k): v for k, v in file["model"]["vocab"].items()}
        singles = [bytes([b]) for b in range(256)]
        merges = [tuple(map(spelled, m if isinstance(m, list) else m.split(" "))) for m in file["model"]["merges"]]
        #: Tokens by rank: the bytes, then the merges in their order. Ranks, not ids, say which merge comes first.
        self.pieces = singles + [a + b for a, b in merges]
        rank = {}
        for r, p in enumerate(self.pieces):
            rank.setdefault(p, r)
        self.split = [(r, r) for r in range(256)] + [(rank[a], rank[b]) for a, b in merges]
        self.merged = {(rank[a], rank[b]): rank[a + b] for a, b in merges}
        self.sizes = [len(p) for p in self.pieces]
        self.packed = [ids[p].to_bytes(4, "little") if p in ids else b"" for p in self.pieces]
        self.shorter = [next((rank[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in rank), None) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, r in rank.items():
            self.automaton.add_word(p.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.findall = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave these two tokens next to each other."""
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        before, merged, split = 1 << 60, self.merged, self.split
        while True:
            if merged.get((left, right), before) < before:
                fits = False
                break
            # The later of the two merges is undone; what it formed bounds the merges across the border from here on.
            undo_left = left > right
            if (left if undo_left else right) < 256:
                fits = True
                break
            if undo_left:
                before, left = left, split[left][1]
            else:
                before, right = right + 1, split[right][0]
        if len(self.fits) > CACHE_ENTRIES:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of one cut, packed as little-endian 32-bit integers."""
        longest: list[int | None] = [None] * (len(piece) + 1)
        sizes, shorter = self.sizes, self.shorter
        for last, r in self.automaton.iter(piece.decode("latin-1")):
            at = last + 1 - sizes[r]
            if (best := longest[at]) is None or sizes[best] < sizes[r]:
                longest[at] = r
        open_at = bytearray(b"\1") * (len(piece) + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token is not None and not (open_at[at + sizes[token]] and (not taken or self.side_by_side(taken[-1], token))):
                token = shorter[token]
            if token is None:  # nothing fits here: back to the token before, whose end is closed now
                open_at[at] = 0
                token = taken.pop()
                at -= sizes[token]
            else:
                taken.append(token)
                at += sizes[token]
                token = longest[at]
        return b"".join(map(self.packed.__getitem__, taken))

    def _ordinary(self, text: str) -> bytes:
        known = self.known
        parts = self.findall(text)
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        if len(known) > CACHE_ENTRIES:
            known.clear()
        out = []
        for p in parts:
            if (e := known.get(p)) is None:
                e = self.encode_piece(p.encode())
                if len(p) <= 64:
                    known[p] = e
            out.append(e)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        if self.special_at is None or not self.special_at.search(text):
            return self._ordinary(text)
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self._ordinary(p) for i, p in enumerate(self.special_at.split(text)))


class Offsets:
    """What decoding needs: all tokens' bytes in a row, and where each begins. A few MB, beside an encoder's tables."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        by_id = {v: bytes(letters[c] for c in k) for k, v in file["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in file.get("added_tokens", [])}
        rows = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(rows), np.uint8)

    def decode(self, packed: bytes, block: int = 1 << 18) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD. Unknown ids give nothing."""
        ids = np.frombuffer(packed, "<u4")
        ids = ids[ids < len(self.lengths)]
        out = []
        for k in range(0, len(ids), block):
            n = self.lengths[part := ids[k : k + block]]
            ends = np.cumsum(n)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.offsets[part] - ends + n, n)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}
_offsets: dict[str, Offsets] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per process; each worker reads the file from its own disk or a shared one."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def offsets(path: str) -> Offsets:
    if path not in _offsets:
        _offsets[path] = Offsets(path)
    return _offsets[path]


def _forget() -> None:
    """Caches end with their task; the tables stay."""
    for own in _loaded.values():
        own.known.clear()
        own.fits.clear()


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def _schema(df: DataFrame, *new: T.StructField) -> T.StructType:
    names = {f.name for f in new}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *new])


def encode(df: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """``df`` with ``ids_col`` (binary: little-endian 32-bit ids, special tokens' strings in the text included) and ``count_col``.

    Narrow: no shuffle; memory is that of one batch and a bounded cache of cuts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(vocabulary_path)
        for batch in batches:
            packed = [own.encode(t or "") for t in batch.column(text_col).to_pylist()]
            yield _with(batch, **{ids_col: pa.array(packed, pa.binary()), count_col: pa.array([len(p) // 4 for p in packed], pa.int64())})

    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run, _forget), _schema(df, T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType())))


def decode(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with ``decoded_col``, the text of ``ids_col``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = offsets(vocabulary_path)
        for batch in batches:
            yield _with(batch, **{decoded_col: pa.array([own.decode(p or b"") for p in batch.column(ids_col).to_pylist()], pa.string())})

    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), _schema(df, T.StructField(decoded_col, T.StringType())))
