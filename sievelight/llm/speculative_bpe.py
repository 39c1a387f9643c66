"""Byte-level BPE encoding and decoding: speculate with greedy longest match, verify all neighbouring pairs, repair only the words that fail."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .common import base

#: The published split pattern of byte-level BPE, for which a faster form is known.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces of text that a Python worker remembers; then it forgets all.
MEMO = 500_000

#: Letters up to U+024F.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: A character for which the general pattern is needed.
NOT_LATIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
#: What the published pattern comes to where letters, digits and white space are those of Latin texts.
LATIN_PIECES = re.compile(rf" ?[{LATIN}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")


class Codec:
    """Encodes as the library does, with the file's added tokens recognised inside texts."""

    def __init__(self, file: str, pattern: str):
        import regex

        self.bpe = vocabulary.load(file)
        self.general = regex.compile(pattern)
        self.latin = pattern == PATTERN
        self.special = re.compile("|".join(map(re.escape, sorted(self.bpe.specials, key=len, reverse=True)))) if self.bpe.specials else None
        self.memo: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return (LATIN_PIECES if self.latin and not NOT_LATIN.search(text) else self.general).findall(text)

    def learn(self, pieces: list[str]) -> None:
        self.memo.update(zip(pieces, self.bpe.encode_words([p.encode("utf-8", "surrogatepass") for p in pieces]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        plan: list[list[str | int]] = []
        for text in texts:
            parts: list[str | int] = []
            at = 0
            for m in self.special.finditer(text) if self.special and any(s in text for s in self.bpe.specials) else ():
                parts += [*self.pieces(text[at : m.start()]), self.bpe.specials[m[0]]]
                at = m.end()
            plan.append([*parts, *self.pieces(text[at:])] if at else self.pieces(text))
        memo = self.memo
        seen = set().union(*plan)
        unknown = [w for w in seen if w not in memo]
        if len(memo) + len(unknown) > MEMO:
            memo, unknown = {}, list(seen)
            self.memo = memo
        self.learn([w for w in unknown if isinstance(w, str)])
        memo.update((t, np.array([t], "<u4").tobytes()) for t in unknown if isinstance(t, int))
        return [b"".join([memo[w] for w in parts]) for parts in plan]

    def decode(self, ids: bytes) -> str:
        """The bytes of all tokens in a row, as UTF-8 with replacement characters for what isn't."""
        table = self.bpe.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def batches(rows: list, sizes: list[int], most: int = 4_000_000) -> Iterator[list]:
    """Runs of rows whose sizes sum to about ``most``, so that long texts don't meet in memory."""
    run, total = [], 0
    for row, size in zip(rows, sizes, strict=True):
        if run and total + size > most:
            yield run
            run, total = [], 0
        run.append(row)
        total += size
    if run:
        yield run


def encode_documents(df: DataFrame, file: str, pattern: str, key: str = "doc_id", text: str = "text", digests: bool = True) -> DataFrame:
    """One row per row of ``df``: key, n_tokens, and ids_sha256 and decoded_sha256 (``digests``) or ids (array of int).

    Whole texts are encoded; null is empty, and an empty text has no tokens and the digests of nothing.
    Repeated rows and null keys pass through.  A partition is worked on in runs of about 4 million
    characters; what a worker remembers is bounded by MEMO.
    """
    fields = "n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    rows = base(df, key, text)

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(file, pattern)
        for table in tables:
            texts = [t or "" for t in table.column(1).to_pylist()]
            out: list[bytes] = []
            shas: list[str] = []
            for run in batches(texts, [len(t) for t in texts]):
                ids = codec.encode(run)
                if digests:
                    shas += [hashlib.sha256(codec.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
                    out += [(len(x) // 4, hashlib.sha256(x).hexdigest()) for x in ids]
                else:
                    out += [(len(x) // 4, np.frombuffer(x, "<u4").tolist()) for x in ids]
            columns = [table.column(0), pa.array([n for n, _ in out], pa.int64())]
            if digests:
                columns += [pa.array([s for _, s in out], pa.string()), pa.array(shas, pa.string())]
            else:
                columns += [pa.array([s for _, s in out], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, *(x.split(" ")[0] for x in fields.split(", "))]
    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(work, f"`{key}` {kind}, {fields}")


def decode_documents(df: DataFrame, file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of the array column ``ids``; null ids give null."""

    @F.pandas_udf("string")
    def decoded(values):
        bpe = vocabulary.load(file)
        return values.map(lambda v: None if v is None else b"".join([bpe.bytes[i] for i in v]).decode("utf-8", "replace"))

    return df.withColumn(to, decoded(F.col(ids)))
