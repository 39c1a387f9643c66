"""Statistics, data-quality audit, and the evaluation harness."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import age_days, from_url
from ..functions.text import compact


def collection_rollup(collections: DataFrame, sources: DataFrame, members: DataFrame, docs: DataFrame, default_slug: str = "default") -> DataFrame:
    """Each collection with its counts of sources and documents and the newest date; each side is aggregated before it is joined."""
    n_sources = sources.groupBy("collection_id").agg(F.countDistinct("id").alias("n_sources"))
    inside = members.join(docs.select(F.col("id").alias("document_id"), "publish_date"), "document_id").groupBy("collection_id").agg(F.countDistinct("document_id").alias("n_documents"), F.max("publish_date").alias("latest"))
    out = collections.join(n_sources, collections["id"] == n_sources["collection_id"], "left").drop("collection_id").join(inside, collections["id"] == inside["collection_id"], "left").drop("collection_id")
    return out.fillna(0, ["n_sources", "n_documents"]).orderBy(F.when(F.col("slug") == default_slug, 0).otherwise(1), "id")


def index_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, documents with attachments, attachments, those with text, chunks."""
    items = F.coalesce(F.col("attachments"), F.array().cast(docs.schema["attachments"].dataType))
    one = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.size(items) > 0).alias("with_attachments"), F.coalesce(F.sum(F.size(items)), F.lit(0)).alias("attachments"), F.coalesce(F.sum(F.size(F.filter(items, lambda a: F.length(F.trim(F.coalesce(a["text"], F.lit("")))) > 0))), F.lit(0)).alias("attachments_with_text"))
    return one.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def source_summary(docs: DataFrame, source: str = "source", day: str = "publish_date") -> DataFrame:
    out = docs.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count_if(F.col(day).isNull()).alias("missing_dates"))
    return out.orderBy(F.desc("n"), F.desc("last_date"), source)


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """One row: n, least, median (truncated), mean, 95th percentile (nearest rank), greatest; by partial aggregates over exact counts."""
    rows = df.select(value.alias("v")).filter("v is not null")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.floor(F.median("v")).cast("bigint").alias("median"), F.avg("v").alias("mean"), F.expr("percentile_disc(0.95) within group (order by v)").alias("p95"), F.max("v").alias("greatest"))


def top_values(df: DataFrame, value: Column, most: int = 20) -> DataFrame:
    """The most common values, ties by value."""
    return df.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def duplicate_groups(df: DataFrame, key: Column) -> DataFrame:
    return df.select(key.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def date_quality(docs: DataFrame, as_of: date) -> DataFrame:
    """One row: dates missing, in the future, over two and four years old, other than the URL's year."""
    age, told = age_days(F.col("publish_date"), as_of), from_url(F.col("url"))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("publish_date").isNull()).alias("missing"), F.count_if(age < 0).alias("future"), F.count_if(age > 730).alias("over_2y"), F.count_if(age > 1460).alias("over_4y"), F.count_if(F.year(told) != F.year("publish_date")).alias("url_mismatch"))


def text_quality(docs: DataFrame, boilerplate: Column) -> DataFrame:
    n = F.length(compact(F.col("body")))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(n < 120).alias("short"), F.count_if(n < 40).alias("very_short"), F.count_if((F.length("body") >= 120) & (boilerplate >= 3)).alias("boilerplate"))


def chunk_quality(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("chunk_text") < 20).alias("short"), F.count_if(F.trim(F.coalesce("search_text", F.lit(""))) == "").alias("blank"), F.count_if(F.coalesce("token_count", F.lit(0)) <= 0).alias("no_tokens"), F.count_if(F.coalesce(F.size("chunk_tags"), F.lit(0)) <= 0).alias("untagged"))


def samples(df: DataFrame, issue: Column, order: str, most: int = 8) -> DataFrame:
    """The first rows of each issue."""
    return df.withColumn("issue", issue).filter("issue is not null").withColumn("_n", F.row_number().over(Window.partitionBy("issue").orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def verdict(missing_dates: float, attachment_text: float, topics_empty: float, audience: float) -> tuple[int, list[str]]:
    """A score out of 100 and the targets missed: dates missing at most 3 %, attachments with text at least 80 %, topics empty at most 25 %, audience tags at least 25 %."""
    missed = [name for name, bad in (("dates", missing_dates > 0.03), ("attachment text", attachment_text < 0.8), ("topics", topics_empty > 0.25), ("audience", audience < 0.25)) if bad]
    return 100 - 25 * len(missed), missed


def dynamic(text: Column, as_of: date) -> Column:
    """``$TODAY`` and ``$YEAR`` filled in."""
    return F.replace(F.replace(text, F.lit("$TODAY"), F.lit(as_of.isoformat())), F.lit("$YEAR"), F.lit(str(as_of.year)))


def eval_checks(cases: DataFrame, results: DataFrame, as_of: date) -> DataFrame:
    """One row per case with its checks and ``passed``.

    ``cases`` (id, expected_intent, expected_terms, forbidden_terms, expected_top_terms, max_top_age_days); ``results`` (id, intent, n_hits, hit_text,
    top_text, top_date, confidence).  A case of intent unknown passes with no hits.
    """
    none = F.array().cast("array<string>")
    has = lambda hay, terms, every: (F.forall if every else F.exists)(F.coalesce(F.col(terms), none), lambda t: F.contains(F.coalesce(F.col(hay), F.lit("")), t))
    rows = cases.join(results, "id", "left")
    rows = rows.withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    checks = {
        "intent_ok": F.col("intent").eqNullSafe(F.col("expected_intent")),
        "has_hits": F.col("n_hits") > 0,
        "terms_ok": (F.coalesce(F.size("expected_terms"), F.lit(0)) <= 0) | has("hit_text", "expected_terms", False),
        "top_terms_ok": has("top_text", "expected_top_terms", True),
        "clean": ~has("hit_text", "forbidden_terms", False),
        "fresh": F.col("max_top_age_days").isNull() | F.coalesce(age_days(F.col("top_date"), as_of) <= F.col("max_top_age_days"), F.lit(False)),
    }
    rows = rows.select("*", *(c.alias(n) for n, c in checks.items()))
    unknown = F.col("expected_intent") == "unknown"
    every = F.col("intent_ok") & F.col("has_hits") & F.col("terms_ok") & F.col("top_terms_ok") & F.col("clean") & F.col("fresh")
    return rows.select("id", "expected_intent", *checks, F.when(unknown, F.col("intent_ok") & (F.col("n_hits") == 0)).otherwise(every).alias("passed"))


def eval_summary(checked: DataFrame, group: str = "expected_intent") -> DataFrame:
    return checked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), (F.count_if("passed") / F.count(F.lit(1))).alias("pass_rate"))


def embedding_coverage(chunks: DataFrame, provider: str, model: str) -> DataFrame:
    """One row: chunks, those without a vector, those whose vector has another signature."""
    from ..functions.vectors import is_current

    missing = F.col("embedding").isNull()
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing"), F.count_if(~missing & ~is_current(F.col("embedding"), provider, model)).alias("stale"))


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


def latencies(results: DataFrame, group: str, value: str) -> DataFrame:
    """Of each group: n, mean, median, greatest, and the value at place ``int(0.95 n)``; from exact counts of distinct values, so a large group isn't gathered."""
    counts = results.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(group).orderBy(value))
    total = F.sum("_c").over(Window.partitionBy(group))
    rows = counts.select(group, F.col(value).alias("_v"), "_c", upto.alias("_upto"), total.alias("_n"))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col("_v")))
    middle = (at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor((F.col("_n") + 2) / 2))) / 2
    return rows.groupBy(group).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), middle.alias("median"), F.max("_v").alias("greatest"), at(F.greatest(F.lit(1), F.floor(F.col("_n") * 0.95))).alias("p95"))
