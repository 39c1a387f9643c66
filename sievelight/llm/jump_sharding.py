"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key walks through a sequence of rising bucket numbers that its own pseudo-random generator gives;
the shard among ``n`` is the last number below ``n``.  So one walk gives the shard for every count up
to ``n + 1``, and a further shard takes rows only into itself.  There is no ring table.

The generator is ``state * 2862933555777941757 + 1`` modulo 2^64; as ANSI arithmetic raises on
overflow, it is computed in DECIMAL(38), which holds every product.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import base, row_count

MULTIPLIER = 2862933555777941757
TWO_64 = 1 << 64


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _next_state(state: Column) -> Column:
    product = state.cast("decimal(20,0)") * _whole(MULTIPLIER)
    return F.pmod(product + _whole(1), _whole(TWO_64)).cast("decimal(20,0)")


def _unsigned(key: Column) -> Column:
    signed = F.coalesce(key, F.lit(-1)).cast("decimal(20,0)")
    return F.when(signed < 0, (signed + _whole(TWO_64)).cast("decimal(20,0)")).otherwise(signed)


def jump_walk(key: Column, n: int) -> Column:
    """An array of the buckets visited by ``key`` below ``n``, rising from 0; null keys walk as -1."""
    start = F.struct(_unsigned(key).alias("s"), F.lit(0).cast("bigint").alias("j"), F.array().cast("array<bigint>").alias("seen"))

    def step(acc: Column, _: Column) -> Column:
        s = _next_state(acc["s"])
        top = F.floor(s / _whole(1 << 33)).cast("bigint") + 1
        # the quotient of integers below 2^53 is rounded once; the floor of it is what the published double arithmetic gives
        j = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / top.cast("double"))).cast("bigint")
        walked = F.struct(s.alias("s"), j.alias("j"), F.concat(acc["seen"], F.array(acc["j"])).alias("seen"))
        return F.when(acc["j"] < n, walked).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda acc: acc["seen"])


def jump_shard(key: Column, n: int) -> Column:
    """The shard (int, 0 to n - 1) of a long key."""
    return F.element_at(jump_walk(key, n), -1).cast("int")


def assign_shards(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", rows_per_block: int = 4096) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 8; a null text counts as none (its CRC is 0), a null
    key is placed as -1 and keeps its null.  ``slot`` numbers the rows of a shard from 0 without gaps
    in the order (MD5 of the key, key, size, CRC), so it doesn't depend on partitions; equal
    rows take neighbouring slots.  An empty table gives an empty table.

    Numbering is two-level: rows are numbered inside (shard, block), blocks being equal slices of the
    MD5's range with about ``rows_per_block`` rows over all shards, and a block's start is the running total of
    the counts before it.  No task holds a shard.  All hot groups (source, equal texts) are spread, as
    only the key decides.
    """
    rows = base(df, key, text)
    blocks = 1 << max(0, math.ceil(math.log2(max(1, row_count(rows.select(key))) / rows_per_block)))
    order = F.md5(F.coalesce(F.col(key), F.lit(-1)).cast("string"))
    walk = jump_walk(F.col(key), shards + 1)
    utf8 = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")

    def placed(out: DataFrame) -> DataFrame:
        return out.select(
            "*",
            F.element_at(F.filter("_walk", lambda b: b < shards), -1).cast("int").alias("shard"),
            F.element_at("_walk", -1).cast("int").alias("grown_shard"),
            F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint") / F.lit((1 << 32) // blocks)).cast("bigint").alias("_block"),
        ).drop("_walk")

    keyed = rows.select(F.col(key), (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint") + 8).alias("size"), F.crc32(utf8).alias("text_crc32"), order.alias("_order"), walk.alias("_walk"))
    sized = placed(keyed)
    counts = placed(rows.select(F.col(key), order.alias("_order"), walk.alias("_walk"))).groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("_order", key, "size", "text_crc32")
    numbered = sized.withColumn("_row", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "_block"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_row") - 1).cast("bigint").alias("slot"), "grown_shard"
    )


def oracle(shards: int = 24) -> str:
    """The same in DuckDB, with a 128-bit walk written as a recursive query."""
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, text,
         CASE WHEN coalesce(doc_id, -1) < 0 THEN CAST(coalesce(doc_id, -1) AS HUGEINT) + 18446744073709551616 ELSE CAST(doc_id AS HUGEINT) END AS k
  FROM documents),
walk(rid, s, b, j) AS (
  SELECT rid, k, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM d
  UNION ALL
  SELECT rid, s2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((s2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT rid, j, (s * {MULTIPLIER} + 1) % 18446744073709551616 AS s2 FROM walk WHERE j <= {shards})),
entries AS (
  SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) t(i)),
entry_list AS (SELECT list(c ORDER BY i) AS tab FROM entries),
crcs AS (
  SELECT rid, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
           lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) AS text_crc32
  FROM d, entry_list),
shards AS (
  SELECT rid, max(b) FILTER (WHERE b < {shards}) AS shard, max(b) AS grown_shard FROM walk WHERE b <= {shards} GROUP BY rid)
SELECT d.doc_id, d.size, d.shard, d.slot, d.grown_shard, 'key' AS law, d.text_crc32 FROM (
  SELECT d.doc_id, d.size, CAST(s.shard AS INTEGER) AS shard, CAST(s.grown_shard AS INTEGER) AS grown_shard,
         row_number() OVER (PARTITION BY s.shard ORDER BY md5(CAST(coalesce(d.doc_id, -1) AS VARCHAR)), d.doc_id, d.size, c.text_crc32) - 1 AS slot,
         c.text_crc32
  FROM d JOIN shards s USING (rid) JOIN crcs c USING (rid)) d
"""
