"""Exact de-duplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its content says so (after a letter-independent end pattern, with a least
and a greatest length), so equal texts have equal chunks.  Chunks go once through a shuffle, already
deduplicated on the map side, where each 64-bit chunk identifier is verified: one identifier, one
chunk text.  From then on a document is the ordered list of its verified identifiers, and lists, not
texts, are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_CHARS, by_rows, marked, one_each, written

#: Least and greatest code points of a chunk.
LEAST, MOST = 512, 2048
#: A chunk ends behind the first of these beyond the least length, or else at the greatest length.
ENDS = "[.!?,;:|]"


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANK_CHARS, "")


def chunks(norm: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The content-defined chunks of a normalised text, in order; together they are the text."""
    pattern = rf"(?s).{{{least},{most}}}?(?<={ENDS})|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(df: DataFrame, key: str, text: str, identify: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """One row per row of ``df``: key, _mark, _mark2, n_chars (of the original), text_sha256, recipe (verified identifiers, array of strings or longs).

    Where verification finds an identifier with several chunk texts, the documents that hold one get
    the identifier and the chunk's rank among these texts; all others keep the plain list.
    """
    rows = marked(df, key, text).select(key, "_mark", "_mark2", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    parts = chunks(normalised(F.col("_text")))
    dictionary = rows.select(F.explode(parts).alias("chunk")).select(identify(F.col("chunk")).alias("id"), "chunk").distinct()
    doubtful = written(dictionary.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    plain = rows.select(
        key,
        "_mark",
        "_mark2",
        F.length("_text").cast("bigint").alias("n_chars"),
        F.sha2(F.encode(normalised(F.col("_text")), "UTF-8"), 256).alias("text_sha256"),
        F.transform(parts, identify).alias("recipe"),
    )
    if doubtful.isEmpty():
        return plain
    # several texts share an identifier: number them, and refine the lists that hold one
    ranks = dictionary.join(doubtful, "id").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))
    told = rows.withColumn("_row", F.monotonically_increasing_id())
    told = written(told)
    places = told.select("_row", F.posexplode(parts).alias("pos", "chunk")).withColumn("id", identify(F.col("chunk")))
    refined = places.join(ranks, ["id", "chunk"], "left").groupBy("_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("rank", F.lit(0)).alias("rank")))), lambda x: F.concat_ws(":", x["id"], x["rank"])).alias("recipe")
    )
    return told.join(refined, "_row", "left").select(
        key,
        "_mark",
        "_mark2",
        F.length("_text").cast("bigint").alias("n_chars"),
        F.sha2(F.encode(normalised(F.col("_text")), "UTF-8"), 256).alias("text_sha256"),
        F.coalesce("recipe", F.array().cast("array<string>")).alias("recipe"),
    )


def _grouped(df: DataFrame, key: str, text: str, identify: Callable[[Column], Column]) -> DataFrame:
    """exact_groups() with _mark and _mark2 of every row; ``kept`` holds for the rows of one key and one text of a group."""
    lists = written(recipes(df, key, text, identify))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), "_mark", "_mark2")).alias("best")
    groups = lists.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size"))
    # concat() hides the aggregate's partitioning from the planner: only an exchange right below the join can be split
    groups = groups.select(F.concat("recipe", F.array().cast(lists.schema["recipe"].dataType)).alias("_recipe"), "best", "group_size")
    joined = lists.join(groups, F.col("recipe") == F.col("_recipe"))
    kept = F.col("best.key").eqNullSafe(F.col(key)) & (F.col("best._mark") == F.col("_mark")) & (F.col("best._mark2") == F.col("_mark2"))
    return joined.select(key, "_mark", "_mark2", F.col("best.key").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", identify: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """One row per row of ``df``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same without blanks; null counts as empty, and empty texts are a group of
    their own.  Of a group the row with the most code points in the original, then the smallest key, stays (null keys are
    last; of several texts with one key, that of the least hash).  Rows that repeat key and text count each in group_size; all of
    those are marked kept or none.  A very long text is a list of chunks like any other.  An empty table gives none.

    A group of copies is counted with map-side partial aggregates.  The way back joins the list of a
    group to its documents; the join deals both sides anew, so that AQE can split a group that holds a
    third of all rows.
    """
    return _grouped(df, key, text, identify).drop("_mark", "_mark2")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns as they are; of rows that repeat key and text, one stays."""
    gone = written(_grouped(df, key, text, chunk_id).filter("not kept").select(key, "_mark", "_mark2"))
    return one_each(by_rows(df, gone, key, text, keep=False), key, text)


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
