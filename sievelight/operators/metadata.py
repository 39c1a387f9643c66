"""Document metadata that an outside model gives: normalising, flattening, choosing what to fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, deduped

# The list fields, how many entries each keeps, and the kinds of time points.
CAPS = {"topics": 8, "keywords": 24, "business_actions": 12, "audience": 16, "official_terms": 20, "answerable_questions": 12}
TIME_KINDS = ["publish", "deadline", "start", "end", "event", "other"]
DDL = "topics array<string>, keywords array<string>, business_actions array<string>, audience array<string>, official_terms array<string>, answerable_questions array<string>, attachment_summaries array<struct<name:string,summary:string,purpose:string>>, time_points array<struct<type:string,date:string,text:string>>, confidence double, notes string"


def normalised(raw: Column, longest: int = 80) -> Column:
    """A struct of DDL from JSON text: lists deduplicated, cut and capped, kinds coerced, confidence clamped; malformed JSON is all empty."""
    told = F.from_json(raw, DDL)
    none = F.array().cast("array<string>")
    lists = [F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(told[name], none), lambda t: collapsed(t, longest)), lambda t: t != "")), 1, cap).alias(name) for name, cap in CAPS.items()]
    summaries = F.slice(F.coalesce(F.transform(told["attachment_summaries"], lambda a: F.struct(collapsed(a["name"], 160).alias("name"), collapsed(a["summary"], 400).alias("summary"), collapsed(a["purpose"], 120).alias("purpose"))), F.array().cast("array<struct<name:string,summary:string,purpose:string>>")), 1, 12)
    kind = lambda t: F.when(F.array_contains(F.array(*map(F.lit, TIME_KINDS)), F.lower(t["type"])), F.lower(t["type"])).otherwise("other")
    times = F.slice(F.coalesce(F.transform(told["time_points"], lambda t: F.struct(kind(t).alias("type"), t["date"].alias("date"), collapsed(t["text"], 160).alias("text"))), F.array().cast("array<struct<type:string,date:string,text:string>>")), 1, 12)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(told["confidence"], F.lit(0.0))))
    return F.struct(*lists, summaries.alias("attachment_summaries"), times.alias("time_points"), sure.alias("confidence"), collapsed(told["notes"], 300).alias("notes"))


def terms(metadata: Column, most: int = 80) -> Column:
    """All terms of a metadata struct, compacted, each once."""
    none = F.array().cast("array<string>")
    order = ["topics", "keywords", "business_actions", "audience", "answerable_questions", "official_terms"]
    told = F.flatten(F.transform(F.coalesce(metadata["attachment_summaries"], F.array().cast("array<struct<name:string,summary:string,purpose:string>>")), lambda a: F.array(a["name"], a["summary"], a["purpose"])))
    return deduped(F.concat(*(F.coalesce(metadata[n], none) for n in order), told), most)


def search_text(metadata: Column, longest: int = 1800) -> Column:
    return F.substring(F.array_join(terms(metadata), " "), 1, longest)


def candidates(docs: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Documents without metadata or without topics in it, newest first."""
    raw = F.trim(F.coalesce("ai_metadata", F.lit("")))
    empty = raw.isin("", "{}") | (F.coalesce(F.size(F.from_json("ai_metadata", DDL)["topics"]), F.lit(0)) <= 0)
    out = docs.filter(empty).orderBy(F.desc_nulls_last("publish_date"), F.desc("id"))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def updated(docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """``docs`` with the metadata of ``fresh`` (id, ai_metadata) in place of theirs."""
    new = fresh.select(F.col("id").alias("_id"), F.col("ai_metadata").alias("_new"))
    columns = [F.coalesce("_new", "ai_metadata").alias(c) if c == "ai_metadata" else docs[c] for c in docs.columns]
    return docs.join(new, docs["id"] == F.col("_id"), "left").select(*columns)
