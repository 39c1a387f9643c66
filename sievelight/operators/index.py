"""The stored full-text index: built when chunks change, read by term when a query comes.

Postings lie in partitions by a hash of the term, sorted by term inside, so that a query reads the few row groups with its terms.
A row has the postings of a term in some hundred chunks: each task inverts its own chunks and writes them, so nothing is dealt out and
the disk holds little besides the index. Lengths and corpus statistics are kept, too; nothing is tokenised when a query comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strings
from ..functions.text import index_tokens
from ..lexicon import CHINESE, LanguagePack
from . import chunking, fulltext

BUCKETS = 64
#: Characters of tokens that are inverted at once, which bounds a worker's memory.
BLOCK = 4_000_000
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
BLOCKS = "term string, steps array<bigint>, fields array<tinyint>, tfs array<int>, positions array<int>"
POSTINGS = "chunk_id bigint, field string, term string, tf bigint, positions array<int>"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """Chunks, and postings, lengths and statistics of their fields."""

    spark: SparkSession
    root: str
    pack: LanguagePack = CHINESE

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/chunks")

    def chunks(self) -> DataFrame:
        """The chunks; their search text, which follows from what is stored, is only made where it is read."""
        return self._told().drop("length", "own", *chunking.TOLD)

    def _told(self) -> DataFrame:
        stored = self.stored()
        wanted = stored.select("*", "own.*").withColumn("search_text", chunking.search_text(self.pack))
        return wanted.select(*(c for c in wanted.columns if c != "token_count"), "token_count")

    def lengths(self) -> DataFrame:
        return self.stored().select("chunk_id", "length")

    def corpus(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/corpus")

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of a few terms: partitions and row groups are pruned by literals."""
        rows = self.spark.read.parquet(f"{self.root}/postings")
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term")).alias("b")).distinct().collect()  # as many rows as a query has terms
        rows = rows.filter(F.col("bucket").isin([r["b"] for r in wanted]) & F.col("term").isin(terms))
        return unblocked(rows, list(fulltext.CHUNK_WEIGHTS))


def blocks(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(term, steps, fields, tfs, positions): fulltext.postings() of a stretch of rows by term, without a shuffle.

    The n-th posting is of the id that the first n steps add up to and the n-th field (a place in ``fields``), and has the next of
    the positions, as many as the n-th frequency.
    """

    def inverted(rows: list[tuple]) -> pa.RecordBatch:
        found: dict[str, tuple[list, list, list, list]] = {}
        last: dict[str, int] = {}
        for k, *told in rows:
            for f, tokens in enumerate(told):
                places: dict[str, list[int]] = {}
                for i, term in enumerate(tokens.split(" ") if tokens else ()):
                    if term in places:
                        places[term].append(i)
                    else:
                        places[term] = [i]
                for term, at in places.items():
                    if (block := found.get(term)) is None:
                        block = found[term] = ([], [], [], [])
                    steps, of, tfs, positions = block
                    steps.append(k - last.get(term, 0))
                    last[term] = k
                    of.append(f)
                    tfs.append(len(at))
                    positions += at
        columns = zip(*found.values(), strict=True) if found else ((), (), (), ())
        kinds = (pa.int64(), pa.int8(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(list(c), pa.list_(t)) for c, t in zip(columns, kinds, strict=True))], names=["term", "steps", "fields", "tfs", "positions"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True):
                    rows.append(row)
                    size += sum(map(len, row[1:]))
                    if size > BLOCK:
                        yield inverted(rows)
                        rows, size = [], 0
        if rows:
            yield inverted(rows)

    return df.select(F.col(key).cast("bigint"), *(F.array_join(index_tokens(F.col(f)), " ").alias(f) for f in fields)).mapInArrow(work, BLOCKS)


def unblocked(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(chunk_id, field, term, tf, positions) of blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, steps, of, tfs, positions = batch.columns
            counts = steps.value_lengths().to_numpy()
            flat, ends = steps.flatten().to_numpy(), np.cumsum(counts)
            sums = np.cumsum(flat)
            before = np.repeat(np.concatenate(([0], sums[ends[:-1] - 1])), counts)
            tf = tfs.flatten().to_numpy()
            places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(tf))), pa.int32()), positions.flatten())
            whose = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(sums - before), pa.array(fields).take(of.flatten()), terms.take(whose), pa.array(tf.astype("int64")), places], names=["chunk_id", "field", "term", "tf", "positions"])

    return rows.select("term", "steps", "fields", "tfs", "positions").mapInArrow(lambda batches: work(b for b in batches if b.num_rows), POSTINGS)


def own() -> Column:
    """What the index has of a chunk's document."""
    return F.struct(*chunking.TOLD)


def build(docs: DataFrame, chunks: DataFrame, root: str, pack: LanguagePack = CHINESE) -> Index:
    """Writes the index of ``chunks`` (of ``chunking.indexed``) to ``root``; ``own`` of their documents is joined unless they have it."""
    spark, fields = docs.sparkSession, list(fulltext.CHUNK_WEIGHTS)
    if "own" not in chunks.columns:
        chunks = chunks.join(docs.select(F.col("id").alias("document_id"), own().alias("own")), "document_id").select(*chunks.columns, "own")
    made = Index(spark, root, pack)
    texts = {"title": F.col("own.title"), "search_text": F.col("search_text"), "chunk_text": F.col("chunk_text"), "source": F.col("own.source"), "topics": F.array_join(F.coalesce("own.topics", strings()), " ")}
    length = sum((F.size(index_tokens(texts[f])) for f in fields), F.lit(0)).cast("bigint")
    chunks.withColumn("length", length).drop("search_text").write.options(**STORED).parquet(f"{root}/chunks")
    posted = blocks(made._told().select("chunk_id", *(texts[f].alias(f) for f in fields)), "chunk_id", fields).withColumn("bucket", bucket(F.col("term")))
    posted.sortWithinPartitions("bucket", "term").write.options(**STORED).partitionBy("bucket").parquet(f"{root}/postings")
    made.lengths().agg(F.count(F.lit(1)).alias("n_rows"), F.avg("length").alias("average")).write.parquet(f"{root}/corpus")
    return made


def refreshed(index: Index, docs: DataFrame, changed: DataFrame, root: str, chunked) -> Index:
    """A new index at ``root`` in which the documents of ``changed`` (id) have new chunks, made by ``chunked(docs)``; the others' stay."""
    from .store import replace_chunks

    again = chunked(docs.join(changed.select("id").distinct(), "id", "left_semi"))
    gone = index.chunks().join(changed.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti")
    return build(docs, replace_chunks(gone, again.select(*gone.columns)), root, index.pack)
