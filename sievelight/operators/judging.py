"""Applying outside judgements to ranked hits, packing evidence into budgets, checking answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RERANK_PRIORITY = {"strong": 4, "relevant": 3, "weak": 2, "irrelevant": 1, "wrong_topic": 0}
EVIDENCE_PRIORITY = {"direct": 3, "supporting": 2, "weak": 1, "stale": 0, "wrong": 0}


def priority(label: Column, order: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, value in order.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def repaired_score(score: Column) -> Column:
    """Percentages to shares, clamped to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(score > 1, score / 100).otherwise(score)))


def label_of(score: Column) -> Column:
    return F.when(score >= 0.82, "strong").when(score >= 0.55, "relevant").when(score >= 0.25, "weak").otherwise("irrelevant")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def apply_rerank(hits: DataFrame, judgements: DataFrame, group: str | None = None) -> DataFrame:
    """``hits`` (id, score, local_rank, …) with new_rank: judged ones by label, judged score, own score, then order; the others behind.

    ``judgements`` (id, label, ai_score, seq): the first of an id counts, ids that no hit has don't.
    """
    keys = [group] if group else []
    judged = first_per(judgements, [*keys, "id"], ["seq"])
    prio = priority(F.col("label"), RERANK_PRIORITY)
    joined = hits.join(judged.select(*keys, "id", "label", "ai_score"), [*keys, "id"], "left")
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc_nulls_last(prio), F.desc_nulls_last(repaired_score(F.col("ai_score"))), F.when(prio.isNotNull(), -F.col("score")), "local_rank")
    return joined.withColumn("new_rank", F.row_number().over(order))


def apply_judgements(hits: DataFrame, judgements: DataFrame, limit: int, group: str | None = None) -> DataFrame:
    """Like apply_rerank() with evidence labels; a judgement not to keep costs one level, and the best ``limit`` stay (of each ``group``, if given)."""
    keys = [group] if group else []
    judged = first_per(judgements, [*keys, "id"], ["seq"])
    level = F.greatest(F.lit(0), priority(F.col("label"), EVIDENCE_PRIORITY) - F.when(F.col("keep"), 0).otherwise(1))
    joined = hits.join(judged.select(*keys, "id", "label", "confidence", "keep"), [*keys, "id"], "left")
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc_nulls_last(level), F.desc_nulls_last("confidence"), F.desc("score"), "local_rank")
    return joined.withColumn("new_rank", F.row_number().over(order)).withColumn("accepted", F.col("new_rank") <= limit)


def judgement_report(applied: DataFrame, group: str) -> DataFrame:
    """(group, judged, accepted, rejected) of apply_judgements()."""
    return applied.groupBy(group).agg(F.count_if(F.col("label").isNotNull()).alias("judged"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def annotated(note: Column, label: Column, score: Column, can_answer: Column, reason: Column) -> Column:
    """A hit's note with what the reranker says of it in front."""
    from ..functions.text import collapsed

    told = F.array_join(F.filter(F.transform(F.slice(can_answer, 1, 5), lambda s: collapsed(s, 20)), lambda s: s != ""), "、")
    why = collapsed(reason, 120)
    parts = [F.format_string("AI重排：%s，匹配度 %.2f", label, score), F.when(told != "", F.concat(F.lit("可回答："), told)), F.when(why != "", F.concat(F.lit("原因："), why)), F.nullif(note, F.lit(""))]
    return F.when(label.isNull(), note).otherwise(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "；"))


def client_order(hits: DataFrame, mode: str, group: str) -> DataFrame:
    """``hits`` (score, publish_date) with ``place`` in the order of a client: ``relevance`` (score, then date) or ``time`` (date, then score); no date is the oldest."""
    day = F.coalesce(F.unix_date("publish_date"), F.lit(0))
    order = [F.desc("score"), F.desc(day)] if mode == "relevance" else [F.desc(day), F.desc("score")]
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order, "id")))


def within_budget(df: DataFrame, group: list[str], order: list, text: str, budget: int) -> DataFrame:
    """Rows in order until the texts' lengths pass the budget; the first always stays, and what follows an overflow goes."""
    window = Window.partitionBy(*group).orderBy(*order)
    total = F.sum(F.length(text)).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_total", total).withColumn("_place", F.row_number().over(window)).filter((F.col("_place") == 1) | (F.col("_total") <= budget)).drop("_total", "_place")


def with_quota(df: DataFrame, group: list[str], kind: str, order: list, most: int, quotas: dict[str, int]) -> DataFrame:
    """The best rows of each group, at most ``most`` and no more of a kind than its quota; those over a quota are skipped."""
    of_kind = F.row_number().over(Window.partitionBy(*group, kind).orderBy(*order))
    allowed = F.lit(most)
    for name, quota in quotas.items():
        allowed = F.when(F.col(kind) == name, quota).otherwise(allowed)
    inside = df.withColumn("_k", of_kind).filter(F.col("_k") <= allowed)
    return inside.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_place") <= most).drop("_k", "_place")


def focused_windows(docs: DataFrame, key: str, text: str, terms: list[str], before: int = 180, after: int = 360, most: int = 3, budget: int = 1500) -> DataFrame:
    """(key, start, score, stretch): around the first hit of each term, by the number of terms inside."""
    listed = F.array(*(F.lit(t.lower()) for t in terms[:28]))
    at = docs.select(key, F.col(text).alias("_text"), F.explode(listed).alias("term")).withColumn("at", F.instr(F.lower("_text"), F.col("term"))).filter("at > 0")
    start = F.greatest(F.lit(1), F.col("at") - before)
    rows = at.select(key, start.alias("start"), F.substring(F.col("_text"), start, F.col("at") - start + after).alias("stretch")).distinct()
    inside = F.size(F.filter(listed, lambda t: F.contains(F.lower("stretch"), t)))
    scored = rows.withColumn("score", inside)
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "start", "stretch"))).filter(F.col("_n") <= most).drop("_n")
    return within_budget(best, [key], [F.desc("score"), F.col("start")], "stretch", budget)


def fact_cards(facts: DataFrame, most: int = 14, considered: int = 28, group: str | None = None) -> DataFrame:
    """Cleaned facts (seq, slot, claim, source_ref, quote, is_direct, confidence, evidence_type): complete ones, each (slot, ref, quote) once, direct and sure ones first; of each ``group``, if given."""
    keys = [group] if group else []
    from ..functions.text import compact

    rows = facts.filter(F.col("seq") < considered).filter((F.trim(F.coalesce("source_ref", F.lit(""))) != "") & (F.trim(F.coalesce("claim", F.lit(""))) != ""))
    rows = rows.withColumn("quote", F.coalesce(F.nullif(F.trim("quote"), F.lit("")), F.col("claim"))).withColumn("_q", compact(F.col("quote")))
    once = first_per(rows, [*keys, "slot", "source_ref", "_q"], ["seq"]).drop("_q")
    sure = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    kind = F.when(F.col("evidence_type").isin("attachment_table_row", "title"), 2).when(F.col("evidence_type") == "body", 1).otherwise(0)
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("is_direct"), F.desc(sure), F.desc(kind), "seq")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def evidence_type(quote: Column, title: Column, attachments: Column, kind: Column, body: Column) -> Column:
    """Where a quote stands: in the title, an attachment's name, a table row, an attachment, the body, or nowhere."""
    from ..functions.text import compact

    q = compact(quote)
    named = F.exists(attachments, lambda a: F.contains(compact(a["name"]), q) | F.contains(q, compact(a["name"])))
    return F.when(q == "", "none").when(F.contains(compact(title), q), "title").when(named, "attachment_name").when(kind.isin("attachment_table_row", "attachment_text"), kind).when(F.contains(compact(body), q), "body").otherwise("none")


# What an address in an answer is, and what stands for one that no hit has.
ADDRESS, REMOVED = r"https?://[^\s)）\]】>,，。；;\"']+", "[未收录链接已移除]"


def allowed_urls(answers: DataFrame, hits: DataFrame, answer: str = "answer") -> DataFrame:
    """``answers`` (id, answer) with every address replaced that no hit or attachment has, and ``n_removed``.  ``hits`` (id, url, attachments)."""
    none = F.array().cast("array<string>")
    urls = hits.select("id", F.explode(F.concat(F.array("url"), F.transform("attachments", lambda a: a["url"]))).alias("u")).filter("u <> ''").groupBy("id").agg(F.collect_set("u").alias("_allowed"))
    rows = answers.join(urls, "id", "left")
    said = F.regexp_extract_all(F.coalesce(F.col(answer), F.lit("")), F.lit(ADDRESS), F.lit(0))
    good = lambda u: F.array_contains(F.coalesce("_allowed", none), F.regexp_replace(u, r"\.+$", ""))
    mended = F.transform(said, lambda u: F.when(good(u), u).otherwise(REMOVED))
    between = F.split(F.coalesce(F.col(answer), F.lit("")), ADDRESS, -1)
    whole = F.array_join(F.flatten(F.zip_with(between, mended, lambda t, u: F.array(t, F.coalesce(u, F.lit(""))))), "")
    removed = F.size(F.array_distinct(F.filter(said, lambda u: ~good(u))))
    return rows.withColumn("n_removed", removed).withColumn(answer, whole).drop("_allowed")


def restricted_evidence(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """``evidence`` (answer_id, source_id, quote) of hits only, with their title, url and source in place of what the model said."""
    own = hits.select(F.col("id").alias("source_id"), "title", "url", "source")
    return evidence.select("answer_id", "source_id", "quote").join(own, "source_id")


def cited_first(hits: DataFrame, citations: DataFrame, group: str | None = None) -> DataFrame:
    """``hits`` (id, rank) with the cited ones (id, cite_rank) first, otherwise as they were; within each ``group``, if given."""
    keys = [group] if group else []
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.asc_nulls_last("cite_rank"), "rank")
    return hits.join(citations, [*keys, "id"], "left").withColumn("new_rank", F.row_number().over(order))


def warnings(hits: DataFrame, as_of, top: int = 5) -> DataFrame:
    """One row: whether a top hit is over two years old, and whether one's deadline is past."""
    first = hits.filter(F.col("rank") <= top)
    old = F.coalesce(F.datediff(F.lit(as_of), F.col("publish_date")) > 730, F.lit(False))
    late = F.coalesce(F.col("deadline") < F.lit(as_of), F.lit(False))
    return first.agg(F.coalesce(F.bool_or(old), F.lit(False)).alias("has_old"), F.coalesce(F.bool_or(late), F.lit(False)).alias("has_past_deadline"))
