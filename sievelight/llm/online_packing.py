"""Packing documents into token sequences with a fixed number of open windows a partition.

Each task keeps at most ``windows`` open windows.  Full sequences are cut off a long document at once; what
remains goes, whole, into the open window that it fills best; when it fits nowhere the fullest window is emitted
and a new one opened.  The windows left over at the end of each task are merged once more, among a bounded
number of tasks' leftovers, by the same rule.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .common import base, written

#: Distinct pieces that a Python worker remembers; then it forgets all.
MEMO = 150_000
#: Open windows of a task, and the number of tasks whose leftovers meet in one.
WINDOWS, MEET = 64, 16


#: Letters up to U+024F, and a character beyond them, for which the general way is needed.
LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f"
NOT_LATIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
#: What the file's split pattern comes to in lower-case Latin texts.
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LATIN}]+|[0-9]|[^\s{LATIN}0-9]+")


class WordIds:
    """Ids of whole texts as the tokenizers library gives them, by the distinct pieces of many texts at once.

    Texts with characters beyond Latin, or with an opening of a special token, go to the library itself.
    """

    def __init__(self, file: str):
        self.file = file
        self.bpe = vocabulary.load_word_end(file)
        self.memo: dict[str, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded when a text first needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.file)
        out.no_truncation()
        out.no_padding()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lower = [t.lower() for t in texts]
        plan = [None if NOT_LATIN.search(t) or "<|" in t else PIECES.findall(t) for t in lower]
        seen = set().union(*(p for p in plan if p))
        unknown = [w for w in seen if w not in self.memo]
        if len(self.memo) + len(unknown) > MEMO:
            self.memo, unknown = {}, list(seen)
        memo = self.memo
        memo.update(zip(unknown, self.bpe.encode_words([w.encode() for w in unknown]), strict=True))
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") if p is None else np.frombuffer(b"".join([memo[w] for w in p]), "<u4") for t, p in zip(texts, plan, strict=True)]


@functools.lru_cache(maxsize=1)
def word_ids(file: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(file)


def batches(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


class Packer:
    """The open windows.  ``emit`` gets the items of a closed one."""

    def __init__(self, size: int, windows: int, emit: Callable[[list], None]):
        self.size, self.most, self.emit = size, windows, emit
        self.free = np.empty(0, np.int64)
        self.open: list[list] = []

    def add(self, length: int, item) -> None:
        if length >= self.size:
            self.emit([item])
            return
        fits = np.flatnonzero(self.free >= length)
        if len(fits):
            at = int(fits[np.argmin(self.free[fits])])
            self.open[at].append(item)
            self.free[at] -= length
            if self.free[at] == 0:
                self.close(at)
            return
        if len(self.open) >= self.most:
            self.close(int(np.argmin(self.free)))
        self.open.append([item])
        self.free = np.append(self.free, self.size - length)

    def close(self, at: int) -> None:
        self.emit(self.open.pop(at))
        self.free = np.delete(self.free, at)

    def rest(self) -> list[list]:
        left, self.open, self.free = self.open, [], np.empty(0, np.int64)
        return left


def pack(df: DataFrame, file: str, size: int = 2048, end_id: int = 1, windows: int = WINDOWS, meet: int = MEET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone.  Repeated rows and null
    keys are documents of their own.  Pieces of a sequence stand one behind another from offset 0; a
    sequence is padded to ``size``, or not at all where its length is a power of two.  No rows give none.

    Tokenising and packing are one pass over the partitions as they are read, with no shuffle; its result, a narrow
    table, is written to the shared folder.  Only the pieces of leftover windows, at most ``windows`` a task,
    are shuffled, ``meet`` tasks' leftovers together.
    """
    rows = base(df, key, text)
    kind = dict(rows.dtypes)[key]
    fields = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def first(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(file)
        task = TaskContext.get().partitionId()
        closed: list[tuple[list, bool]] = []
        packer = Packer(size, windows, lambda items: closed.append((items, True)))
        sequence = task << 36

        def drained() -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for items, full in closed:
                offset = 0
                for doc, start, length, crc, tokens in items:
                    out.append((doc, start, length, crc, tokens, sequence, offset, not full))
                    offset += length
                sequence += 1
            closed.clear()
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [key_type, *[pa.int64()] * 6, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, *fields, "leftover"])

        key_type = None
        for table in tables:
            key_type = table.column(0).type
            docs, texts = table.column(0).to_pylist(), [t or "" for t in table.column(1).to_pylist()]
            for at, end in batches(texts):
                for doc, found in zip(docs[at:end], ids.encode(texts[at:end]), strict=True):
                    whole = np.append(found, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(whole), size):
                        piece = whole[start : start + size]
                        packer.add(len(piece), (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(whole)))
                yield drained()
        if key_type is not None:
            closed += [(items, False) for items in packer.rest()]
            yield drained()

    schema = f"`{key}` {kind}, " + ", ".join(f"`{f}` bigint" for f in fields)
    packed = written(rows.mapInArrow(first, schema + ", leftover boolean"))

    def again(table: pa.Table) -> pa.Table:
        """Merges the leftover windows of some tasks; a window moves as a whole."""
        runs: dict[int, list[dict]] = {}
        for row in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            runs.setdefault(row["sequence_id"], []).append(row)
        merged: list[list] = []
        packer = Packer(size, len(runs) or 1, merged.append)
        for run in sorted(runs.values(), key=lambda run: (-sum(r["length"] for r in run), run[0]["sequence_id"])):
            packer.add(sum(r["length"] for r in run), run)
        out = []
        for parts in [*merged, *packer.rest()]:
            offset = 0
            for row in (r for run in parts for r in run):
                out.append(row | {"sequence_id": parts[0][0]["sequence_id"], "offset": offset})
                offset += row["length"]
        return pa.Table.from_pylist(out, table.schema)

    left = packed.filter("leftover").drop("leftover")
    group = F.shiftright(F.col("sequence_id"), 36 + (meet - 1).bit_length())
    merged = left.groupBy(group).applyInArrow(again, schema)
    return packed.filter("not leftover").drop("leftover").unionByName(merged)


def padding(packed: DataFrame, size: int = 2048) -> DataFrame:
    """One row: sequences, tokens, padding tokens by the rule above."""
    lengths = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return lengths.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(size - F.col("n"))).alias("padding"))
