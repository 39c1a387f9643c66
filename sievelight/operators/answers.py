"""Answers from outside models: reading their JSON, combining readers, ranking references, putting addresses right."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tasks of the readers by slot and intent, in order, and what a review's verdict is worth.
TASK_SLOTS = [("deadline", ["time", "deadline"]), ("eligibility", ["eligibility"]), ("process", ["process"]), ("material", ["material", "attachment"]), ("comparison", ["comparison"])]
TASK_INTENTS = {"deadline_query": "deadline", "eligibility_query": "eligibility", "process_guide": "process", "attachment_query": "material"}
VERDICTS = {"direct": 0.95, "partial": 0.65, "weak": 0.35}


def salvaged(text: str | None) -> dict:
    """The JSON object in a model's reply: whole, fenced, between the outermost braces, or, if it broke off, its ``final_answer``; else the plain text."""
    plain = (text or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", plain, re.S)
    outer = plain[plain.find("{") : plain.rfind("}") + 1] if "{" in plain else ""
    for candidate in (plain, fenced[1] if fenced else "", outer):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    m = re.search(r'"final_answer"\s*:\s*"((?:[^"\\]|\\.)*)', plain, re.S)
    if m:
        try:
            return {"final_answer": json.loads(f'"{m[1]}"')}
        except ValueError:
            return {"final_answer": m[1].rstrip("\\")}
    return {"final_answer": plain} if plain and not plain.startswith("{") else {}


def reader_tasks(intent: str, slots: list[str], most: int = 3) -> list[str]:
    """What the readers look for."""
    wanted = [task for task, names in TASK_SLOTS if set(names) & set(slots)]
    if (own := TASK_INTENTS.get(intent)) and own not in wanted:
        wanted.insert(0, own)
    return (wanted or ["general"])[:most]


def combined(results: DataFrame) -> DataFrame:
    """One row per query from ``results`` (query_id, task_order, facts array, confidence): the facts in task order, and the joint confidence.

    High needs a high reader and none at low; low, if none has facts; medium otherwise.
    """
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("task_order", "facts"))), lambda x: x["facts"]))
    any_high, any_low = F.bool_or(F.col("confidence") == "high"), F.bool_or(F.col("confidence") == "low")
    out = results.groupBy("query_id").agg(ordered.alias("facts"), any_high.alias("_h"), any_low.alias("_l"))
    level = F.when(F.size("facts") == 0, "low").when(F.col("_h") & ~F.col("_l"), "high").otherwise("medium")
    return out.withColumn("confidence", level).drop("_h", "_l")


def fact_confidence(facts: DataFrame, group: str) -> DataFrame:
    """(group, confidence) from fact cards: high with a direct fact of high confidence, low without any direct or medium one."""
    direct_high = F.bool_or(F.col("is_direct") & (F.col("confidence") == "high"))
    some = F.bool_or(F.col("is_direct") | F.col("confidence").isin("high", "medium"))
    return facts.groupBy(group).agg(F.when(direct_high, "high").when(some, "medium").otherwise("low").alias("confidence"))


def ranked_refs(answers: DataFrame) -> DataFrame:
    """(id, ref, place) from ``answers`` (id, used_refs, ranked_refs, reviews array of (ref, verdict, score)): used ones, ranked ones, then by review."""
    worth = F.lit(0.0)
    for name, value in VERDICTS.items():
        worth = F.when(F.col("x.verdict") == name, value).otherwise(worth)
    none = F.array().cast("array<string>")
    listed = [answers.select("id", F.posexplode(F.coalesce(c, none)).alias("n", "ref"), F.lit(k).alias("kind")).withColumn("worth", F.lit(1.0)) for k, c in enumerate(("used_refs", "ranked_refs"))]
    reviewed = answers.select("id", F.posexplode("reviews").alias("n", "x")).select("id", "n", F.col("x.ref").alias("ref"), F.lit(2).alias("kind"), F.coalesce("x.score", worth).alias("worth")).filter("worth > 0")
    rows = listed[0].unionByName(listed[1]).unionByName(reviewed)
    best = Window.partitionBy("id", "ref").orderBy("kind", F.desc("worth"), "n")
    once = rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("kind", F.desc("worth"), "n", "ref"))).select("id", "ref", "place")


def canonical_references(answer: str, urls: list[str], heading: str = "参考信息源") -> str:
    """In the block under ``heading`` the address of line ``[n]`` becomes the n-th hit's."""
    head, mark, tail = answer.partition(heading)
    if not mark:
        return answer

    def line(m: re.Match) -> str:
        n = int(m[1])
        return re.sub(r"https?://\S+", lambda _: urls[n - 1], m[0]) if 1 <= n <= len(urls) else m[0]

    return head + mark + re.sub(r"(?m)^.*?\[(\d+)\].*$", line, tail)


def packed_blocks(blocks: Column, budget: int, least: int = 120) -> Column:
    """Blocks joined by blank lines up to ``budget``; the one that overflows is cut if ``least`` characters are left, and the rest go."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(acc: Column, block: Column) -> Column:
        joined = F.when(acc["out"] == "", block).otherwise(F.concat(acc["out"], F.lit("\n\n"), block))
        left = F.lit(budget) - F.length(acc["out"]) - 2
        cut = F.when(left >= least, F.concat(acc["out"], F.when(acc["out"] == "", "").otherwise("\n\n"), F.substring(block, F.lit(1), left))).otherwise(acc["out"])
        return F.when(acc["full"], acc).when(F.length(joined) <= budget, F.struct(joined.alias("out"), F.lit(False).alias("full"))).otherwise(F.struct(cut.alias("out"), F.lit(True).alias("full")))

    return F.aggregate(blocks, start, step, lambda acc: acc["out"])
