"""Assistants over a base of facts: slots from the question, facts by full text, grouped answers with rule warnings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lexicon import CHINESE, LanguagePack
from . import fulltext

FACT_WEIGHTS = {"fact_text": 1.5, "quote": 2.0, "slot": 0.5}


@dataclass(frozen=True)
class Service:
    """One assistant: what to read from a question, which words to add to it, what to ask for and to warn of."""

    name: str
    slots: dict[str, str] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    added_terms: list[str] = field(default_factory=list)
    fact_slots: list[str] = field(default_factory=list)
    warnings: list[tuple[str, str, str]] = field(default_factory=list)  # slot, pattern, warning


def filled(service: Service, question: str, given: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """The slots given or read from the question, and the required ones that are missing."""
    out = {k: v for k, v in (given or {}).items() if v}
    for slot, pattern in service.slots.items():
        if slot not in out and (m := re.search(pattern, question)):
            out[slot] = m[1] if m.groups() else m[0]
    return out, [s for s in service.required if s not in out]


def warnings(service: Service, slots: dict[str, str]) -> list[str]:
    return [text for slot, pattern, text in service.warnings if re.search(pattern, slots.get(slot, ""))]


def search_facts(facts: DataFrame, service: Service, question: str, limit: int = 12, pack: LanguagePack = CHINESE) -> DataFrame:
    """``facts`` (id, service_type, slot, fact_text, quote, url) for a question: the best by full text, topped up by slot, each once."""
    own = facts.filter(F.col("service_type") == service.name)
    words = " ".join([*re.findall(pack.tokens, question)[:8], *service.added_terms[:4]])
    phrases = fulltext.queries_frame(facts.sparkSession, {0: words}, pack)
    fields = list(FACT_WEIGHTS)
    ranks = fulltext.bm25(fulltext.postings(own, "id", fields), fulltext.lengths(own, "id", fields), phrases, "id", FACT_WEIGHTS)
    found = ranks.select("id", F.lit(0).alias("channel"), "rank")
    topped = own.filter(F.col("slot").isin(service.fact_slots)).select("id", F.lit(1).alias("channel"), F.lit(0.0).alias("rank"))
    once = found.unionByName(topped).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("channel", "rank"))).filter("_n = 1")
    best = once.orderBy("channel", "rank", "id").limit(limit).drop("_n")
    return own.join(F.broadcast(best), "id").orderBy("channel", "rank", "id")


def by_slot(facts: DataFrame) -> DataFrame:
    """(slot, facts): the facts of a search grouped, best first."""
    return facts.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "rank", "id", "fact_text"))), lambda x: x["fact_text"]).alias("facts"))


def sources(facts: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` distinct (url, quote) of a search."""
    once = facts.withColumn("_n", F.row_number().over(Window.partitionBy("url", "quote").orderBy("channel", "rank", "id"))).filter("_n = 1")
    return once.orderBy("channel", "rank", "id").limit(most).select("url", "quote")


def stats(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("service_type").alias("services"))
