"""Mutations of the base tables as functions from snapshots to snapshots, and a store of versioned snapshots.

No statement changes rows in place: each returns the new table, and a writer puts it beside the old one and moves a pointer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of the rows of a key, the one that comes first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, batch: DataFrame, key: str = "url", sequence: str = "seq", ident: str = "id", digest: str = "content_hash", kept: str = "ai_metadata") -> DataFrame:
    """``old`` with the batch's rows inserted or, by ``key``, updated.

    The last of a batch's rows of one key wins.  A row keeps its id; new ones are numbered behind the greatest in
    the order of their keys, by two-level numbering (offsets of key ranges).  ``kept`` survives an update only if the digest is the same.
    """
    columns = old.columns
    fresh = last_per_key(batch, key, [F.desc(sequence)]).select(*(F.col(c).alias(f"n_{c}") for c in columns if c != ident))
    both = old.join(fresh, old[key] == F.col(f"n_{key}"), "full_outer")
    is_new, is_hit = old[key].isNull(), F.col(f"n_{key}").isNotNull()
    top = old.agg(F.coalesce(F.max(ident), F.lit(0))).first()[0]
    out = {}
    for c in columns:
        if c == ident:
            continue
        value = F.when(is_hit, F.col(f"n_{c}")).otherwise(old[c])
        if c == kept:
            value = F.when(is_new, F.col(f"n_{c}")).when(is_hit & ~old[digest].eqNullSafe(F.col(f"n_{digest}")), F.col(f"n_{c}")).otherwise(old[c])
        out[c] = value
    merged = both.select(old[ident].alias(ident), *(v.alias(c) for c, v in out.items()))
    known, new = merged.filter(F.col(ident).isNotNull()), merged.filter(F.col(ident).isNull()).drop(ident)
    return known.unionByName(numbered(new, key, ident, top)).select(*columns)


def numbered(df: DataFrame, key: str, ident: str, after: int) -> DataFrame:
    """``df`` with ids from ``after + 1`` in the order of the first characters of the key's hash, then the key; no task sees all rows."""
    hashed = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(4096)))
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most 4096 counts: one small task
    before = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return hashed.withColumn("_row", row).join(F.broadcast(before), "_bucket").withColumn(ident, (F.col("_before") + F.col("_row") + after).cast("bigint")).drop("_bucket", "_row", "_before")


def without_duplicates(docs: DataFrame, ident: str = "id", same: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """Of the documents alike in ``same``, the one with the least id."""
    keep = docs.groupBy(*same).agg(F.min(ident).alias(ident)).select(ident)
    return docs.join(keep, ident, "left_semi")


def delete_by_keys(keys: DataFrame, docs: DataFrame, key: str, ident: str, dependents: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The documents without those of ``keys``, and every dependent table without theirs."""
    left = docs.join(keys, key, "left_anti")
    gone = docs.join(keys, key, "left_semi").select(F.col(ident).alias("_gone"))
    return {"documents": left} | {name: table.join(gone, F.col(column) == F.col("_gone"), "left_anti") for name, (table, column) in dependents.items()}


def orphans(docs: DataFrame, members: DataFrame, ident: str = "id", member: str = "document_id") -> DataFrame:
    """The documents of no collection."""
    return docs.join(members.select(F.col(member).alias("_m")), F.col(ident) == F.col("_m"), "left_anti")


def missing_children(docs: DataFrame, chunks: DataFrame, ident: str = "id", parent: str = "document_id") -> DataFrame:
    """The documents without chunks."""
    return docs.join(chunks.select(F.col(parent).alias("_p")).distinct(), F.col(ident) == F.col("_p"), "left_anti")


def stale_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks whose derived columns are missing."""
    return chunks.filter((F.trim(F.coalesce("search_text", F.lit(""))) == "") | (F.coalesce(F.size("chunk_tags"), F.lit(0)) <= 0) | (F.coalesce("token_count", F.lit(0)) <= 0))


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """``chunks`` with all chunks of the documents of ``fresh`` replaced."""
    return chunks.join(fresh.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def replace_members(members: DataFrame, collection_id: int, document_ids: DataFrame) -> DataFrame:
    """The memberships with one collection's replaced; repeated ids count once."""
    fresh = document_ids.toDF("document_id").distinct().select(F.lit(collection_id).cast("bigint").alias("collection_id"), "document_id")
    return members.filter(F.col("collection_id") != collection_id).unionByName(fresh)


def insert_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` and those rows whose key it lacks, the first of each."""
    return table.unionByName(rows.join(table.select(*key), key, "left_anti").dropDuplicates(key))


def unique_slug(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, slug): ``base``, ``base-2``, ``base-3``, … past those taken.  ``existing`` (slug); ``wanted`` (name)."""
    base = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("collection"))
    stem = F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 1)
    number = F.coalesce(F.expr("try_cast(regexp_extract(slug, '^(.*?)(?:-([0-9]+))?$', 2) as int)"), F.lit(1))
    taken = existing.select(stem.alias("base"), number.alias("n")).groupBy("base").agg(F.max("n").alias("taken"))
    order = Window.partitionBy("base").orderBy("name")
    rows = wanted.select("name", base.alias("base")).withColumn("row", F.row_number().over(order)).join(taken, "base", "left")
    n = F.coalesce("taken", F.lit(0)) + F.col("row")
    return rows.select("name", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("slug"))


def date_repair(docs: DataFrame, url: str = "url", column: str = "publish_date") -> DataFrame:
    """Dates told by the URL replace the stored ones; demonstration documents go."""
    from ..functions.dates import from_url

    return docs.filter(~F.contains(F.col(url), F.lit("/demo/"))).withColumn(column, F.coalesce(from_url(F.col(url)), F.col(column)))


def evolved(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``df`` with the columns (name: type, default) that it lacks."""
    return df.select("*", *(F.lit(default).cast(kind).alias(name) for name, (kind, default) in columns.items() if name not in df.columns))


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows with one of the keys."""
    return df.join(keys, key, "left_semi")


def with_attachments(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents that have attachments, newest first."""
    out = docs.filter(F.size("attachments") > 0).orderBy(F.desc_nulls_last("publish_date"), F.desc("id"))
    return out.limit(limit) if limit is not None else out


def empty_bodies(docs: DataFrame, most: int = 40, least_attached: int = 80) -> DataFrame:
    """Documents with hardly any body nor attachment text: those to fetch again."""
    attached = F.aggregate(F.coalesce("attachments", F.array().cast(docs.schema["attachments"].dataType)), F.lit(0), lambda n, a: n + F.length(F.coalesce(a["text"], F.lit(""))))
    return docs.filter((F.length(F.coalesce("body", F.lit(""))) <= most) & (attached < least_attached))


def rescued(docs: DataFrame, fetched: DataFrame, least: int = 80) -> DataFrame:
    """``docs`` with the body of ``fetched`` (id, body) where that is at least ``least`` long."""
    new = fetched.filter(F.length("body") >= least).select(F.col("id").alias("_id"), F.col("body").alias("_body"))
    return docs.join(new, docs["id"] == F.col("_id"), "left").select(*(F.coalesce("_body", docs["body"]).alias("body") if c == "body" else docs[c] for c in docs.columns))


class Snapshots:
    """Tables as immutable versions under a folder; the pointer is the newest ``_CURRENT-n`` marker."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self, name: str) -> int:
        fs, path = self._files()
        there = path(f"{self.root}/{name}")
        if not fs.exists(there):
            return 0
        return max([int(s.getPath().getName().rpartition("-")[2]) for s in fs.listStatus(there) if s.getPath().getName().startswith("_CURRENT-")], default=0)

    def read(self, name: str) -> DataFrame:
        n = self.version(name)
        if not n:
            raise LookupError(f"no table {name!r} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/v={n}")

    def write(self, name: str, df: DataFrame) -> int:
        """A new version; readers see it only once its marker stands, so a failed write leaves the old one."""
        n = self.version(name) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={n}")
        fs, path = self._files()
        fs.create(path(f"{self.root}/{name}/_CURRENT-{n}")).close()
        return n
