"""The search: five recall channels, a transparent score, best-of per document, de-duplication, filters, top-k.

``docs`` have id, url, title, body, source, category, publish_date, deadline, topics, keywords, attachments (array of struct with name),
applicable_colleges, applicable_grades, student_types; ``chunks`` have chunk_id, document_id, heading, chunk_text, chunk_kind, attachment_name,
search_text, chunk_tags and, for the vector channel, embedding (array of double).
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import snippet, texts
from ..functions.vectors import dot
from ..lexicon import CHINESE, LanguagePack
from ..plans import query_plan as plans
from ..plans.query_plan import QueryPlan, UserProfile
from . import fulltext
from .index import Index

#: Limits of the channels.
QUERIES, LIKE_HITS, SCANNED_VECTORS, VECTOR_HITS, LEAST_SIMILARITY = 16, 30, 1200, 24, 0.18
HIT = "document_id bigint, chunk_id bigint, base double, snippet string, channel int, place bigint"


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def in_collection(docs: DataFrame, members: DataFrame | None, collection_id: int | None) -> DataFrame:
    """The documents of a collection, before any channel runs."""
    if collection_id is None or members is None:
        return docs
    return docs.join(members.filter(F.col("collection_id") == collection_id).select(F.col("document_id").alias("id")), "id", "left_semi")


def fulltext_channel(docs: DataFrame, chunks: DataFrame, queries: list[str], pack: LanguagePack = CHINESE, index: Index | None = None) -> DataFrame:
    """Up to 60 chunks for each of the first 16 query strings, from the stored ``index`` if there is one."""
    own = docs.select(F.col("id").alias("document_id"), "title", "source", F.array_join(_list("topics"), " ").alias("topics"))
    fields = list(fulltext.CHUNK_WEIGHTS)
    phrases = fulltext.queries_frame(docs.sparkSession, dict(enumerate(queries[:QUERIES])), pack)
    if index is None:
        joined = chunks.select("chunk_id", "document_id", "search_text", "chunk_text").join(own, "document_id")
        ranks = fulltext.bm25(fulltext.postings(joined, "chunk_id", fields, phrases), fulltext.lengths(joined, "chunk_id", fields), phrases, "chunk_id", fulltext.CHUNK_WEIGHTS)
    else:
        terms = sorted({t for q in queries[:QUERIES] for p in fulltext.query_phrases(q, pack) for t in p})
        found = index.postings(terms)
        ranks = fulltext.bm25(found, index.lengths(), phrases, "chunk_id", fulltext.CHUNK_WEIGHTS, index.corpus())
        # chunks of other collections neither count nor rank
        ranks = ranks.join(chunks.select("chunk_id", "document_id").join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    terms = texts([(fulltext.query_phrases(q, pack) or [[q]])[0][0] for q in queries[:QUERIES]])
    # at most HITS rows for each of QUERIES strings: fit to broadcast to the texts
    hits = F.broadcast(fulltext.top_hits(ranks, "chunk_id").select("query_id", "chunk_id", "rank", "place"))
    told = chunks.select("chunk_id", "document_id", "chunk_text").join(hits, "chunk_id")
    told = docs.select(F.col("id").alias("document_id"), "body").join(F.broadcast(told), "document_id")
    shown = fulltext.hit_snippet(F.col("chunk_text"), F.col("body"), F.get(terms, F.col("query_id").cast("int")))
    return told.select("document_id", "chunk_id", fulltext.base_score(F.col("rank")).alias("base"), shown.alias("snippet"), F.lit(0).alias("channel"), (F.col("query_id") * 1000 + F.col("place")).alias("place"))


def like_channel(docs: DataFrame, terms: list[str], columns: list[str], channel: int, in_title: float, elsewhere: float, most: int = LIKE_HITS, attachments: bool = False) -> DataFrame:
    """For each term the newest documents that have it in one of the columns; ASCII case doesn't count, ``%`` and ``_`` are wildcards."""
    if not terms:
        return docs.sparkSession.createDataFrame([], HIT)
    flat = docs.select("*", *(F.array_join(_list(c), " ").alias(f"_{c}") for c in columns if dict(docs.dtypes)[c].startswith("array<string")))
    if attachments:
        flat = flat.withColumn("_attachments", F.coalesce(F.to_json("attachments"), F.lit("")))
    names = [f"_{c}" if f"_{c}" in flat.columns else c for c in columns] + (["_attachments"] if attachments else [])

    def met(term: str) -> Column:
        # a backslash is no escape in the terms; % and _ stay live
        pattern = F.lit("%" + term.replace("\\", "\\\\") + "%")
        return reduce(lambda a, b: a | b, (F.ilike(F.coalesce(F.col(f"`{c}`"), F.lit("")), pattern) for c in names))

    # the terms that a row has are few; only these make rows
    held = F.filter(F.array(*(F.when(met(t), F.struct(F.lit(i).alias("n"), F.lit(t).alias("term"))) for i, t in enumerate(terms))), lambda x: x.isNotNull())
    flat = flat.select("*", held.alias("_held")).filter(F.size("_held") > 0).select("*", F.explode("_held").alias("t"))
    newest = Window.partitionBy("t.n").orderBy(F.desc_nulls_last("publish_date"), F.desc("id"))
    hits = flat.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)
    base = F.when(F.contains(_text("title"), F.col("t.term")), in_title).otherwise(elsewhere)
    return hits.select(F.col("id").alias("document_id"), F.lit(None).cast("bigint").alias("chunk_id"), base.alias("base"), snippet(F.col("body"), F.col("t.term")).alias("snippet"), F.lit(channel).alias("channel"), (F.col("t.n") * 1000 + F.col("place")).cast("bigint").alias("place"))


def profile_channel(docs: DataFrame, terms: list[str], recalled: DataFrame, limit: int) -> DataFrame:
    """The first ``2 * limit`` documents that have a profile term, if other channels found fewer than ``max(4, limit // 2)``."""
    found = like_channel(docs, terms, ["source", "title", "body", "applicable_colleges", "applicable_grades", "student_types"], 3, 0.7, 0.7)
    first = found.orderBy("place").limit(2 * limit)
    enough = recalled.select("document_id").distinct().limit(max(4, limit // 2)).agg((F.count(F.lit(1)) >= max(4, limit // 2)).alias("_enough"))
    return first.join(F.broadcast(enough), ~F.col("_enough"), "left_semi")  # one row on that side


def latest_channel(docs: DataFrame, limit: int) -> DataFrame:
    newest = docs.orderBy(F.desc_nulls_last("publish_date"), F.desc("id")).limit(limit)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("publish_date"), F.desc("id")))
    return newest.select(F.col("id").alias("document_id"), F.lit(None).cast("bigint").alias("chunk_id"), F.lit(1.0).alias("base"), F.substring("body", 1, 180).alias("snippet"), F.lit(2).alias("channel"), place.cast("bigint").alias("place"))


def vector_channel(docs: DataFrame, chunks: DataFrame, vector: list[float], attachment_query: bool = False, scanned: int | None = SCANNED_VECTORS, kept: int = VECTOR_HITS) -> DataFrame:
    """The chunks most similar to the query vector among the newest ``scanned`` (None: among all)."""
    rows = chunks.filter("embedding is not null").join(docs.select(F.col("id").alias("document_id"), "attachments"), "document_id")
    rows = rows.orderBy(F.desc("chunk_id")).limit(scanned) if scanned else rows
    similar = rows.withColumn("similarity", dot(F.col("embedding"), F.array(*map(F.lit, vector)))).filter(F.col("similarity") > LEAST_SIMILARITY)
    best = similar.orderBy(F.desc("similarity"), "chunk_id").limit(kept)
    kind = F.when(F.col("chunk_kind") == "attachment_text", -0.35).when(F.col("chunk_kind") == "attachment_table_row", 0.15).otherwise(0.0)
    wanted = F.when(F.lit(attachment_query) & (F.size("attachments") > 0), 0.25).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "chunk_id"))
    return best.select("document_id", "chunk_id", F.greatest(F.lit(0.1), F.col("similarity") * 4 + kind + wanted).alias("base"), F.substring("chunk_text", 1, 180).alias("snippet"), F.lit(4).alias("channel"), place.cast("bigint").alias("place"))


def _any(hay: Column, terms: list[str]) -> Column:
    return F.exists(texts(terms), lambda t: F.contains(hay, t)) if terms else F.lit(False)


def _hits(hay: Column, terms: list[str]) -> Column:
    return F.filter(texts(terms), lambda t: F.contains(hay, t))


def audience_match(values: Column, wanted: str | None) -> Column:
    """Whether one of the values contains the wanted one or is contained in it."""
    if not wanted:
        return F.lit(False)
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: (v != "") & (F.contains(v, F.lit(wanted)) | F.contains(F.lit(wanted), v)))


def feature_score(plan: QueryPlan, profile: UserProfile, as_of: date, pack: LanguagePack = CHINESE, authority: Column | None = None) -> Column:
    """The score of a hit (doc and chunk columns, base, snippet): a sum of column expressions, all in one projection."""
    names = F.coalesce(F.array_join(F.transform("attachments", lambda a: F.coalesce(a["name"], F.lit(""))), " "), F.lit(""))
    titleish = F.concat_ws(" ", _text("title"), _text("heading"), _text("attachment_name"), names)
    metadata = F.concat_ws(" ", _text("source"), _text("category"), *(F.array_join(_list(c), " ") for c in ("topics", "keywords", "chunk_tags")))
    body = F.concat_ws(" ", _text("snippet"), _text("chunk_text"))
    title, intent = _text("title"), plan.intent
    zero = F.lit(0.0)
    parts: list[Column] = [F.col("base")]
    when = lambda cond, yes, no=0.0: F.when(cond, F.lit(float(yes))).otherwise(F.lit(float(no)))
    capped = lambda most, value: F.least(F.lit(float(most)), value)
    if plan.normalized_query:
        parts.append(when(F.contains(title, F.lit(plan.normalized_query)), 5.0))
    specific = plans.specific_terms(plan, pack)
    if specific:
        in_title, in_body = _hits(titleish, specific), _hits(body, specific)
        only_meta = F.size(F.array_except(F.array_except(_hits(metadata, specific), in_title), in_body))
        n_title, n_body = F.size(in_title), F.size(in_body)
        parts += [capped(5.0, n_title * 1.8), capped(2.4, n_body * 0.6), capped(1.2, only_meta * 0.35)]
        if intent in ("find_document", "attachment_query"):
            parts.append(F.when(n_title > 0, capped(4.0, n_title * 1.5)).when(n_body > 0, -5.0).otherwise(-6.0))
        elif intent in ("deadline_query", "process_guide", "eligibility_query"):
            parts.append(when((n_title == 0) & (n_body == 0), -1.5))
    coverage = plans.coverage_terms(plan, pack)
    if coverage:
        in_title, in_body = _hits(titleish, coverage), _hits(body, coverage)
        only_meta = F.array_except(F.array_except(_hits(metadata, coverage), in_title), in_body)
        covered = F.size(F.array_union(F.array_union(in_title, in_body), only_meta))
        parts.append(capped(4.5, F.size(in_title) * 1.3 + F.size(in_body) * 0.9 + F.size(only_meta) * 0.35))
        if len(coverage) >= 2:
            miss = -1.8 if intent in ("answer_question", "process_guide", "deadline_query", "eligibility_query") else 0.0
            parts.append(F.when(covered >= 2, capped(3.2, (covered - 1) * 1.1)).otherwise(F.lit(miss)))
        parts.append(when((_text("chunk_kind") == "attachment_table_row") & (covered >= 2), 0.8))
    for term in plans.query_strings(plan, pack, 12)[:8]:
        generic = plans.is_generic(term, pack)
        parts += [when(F.contains(title, F.lit(term)), 0.6 if generic else 2.0), when(F.array_contains(_list("keywords"), term), 0.3 if generic else 1.4)]
    if topic := plan.one("topic"):
        terms = plans.topic_terms(topic, pack)
        none = -2.5 if intent in ("deadline_query", "process_guide", "eligibility_query") else 0.0
        parts.append(F.when(_any(titleish, terms), 3.0).when(_any(body, terms), 1.2).when(_any(metadata, terms), 0.5).otherwise(F.lit(none)))
    if action := plan.one("action"):
        generic = plans.is_generic(action, pack)
        parts.append(F.when(F.contains(title, F.lit(action)), 0.4 if generic else 1.2).when(F.contains(F.concat_ws(" ", titleish, metadata, body), F.lit(action)), 0.1 if generic else 0.4).otherwise(0.0))
    import re

    asked = " ".join([plan.normalized_query, *plan.sub_questions, *plan.retrieval_keywords, *plan.expanded_queries, *(v for v in plan.entities.values() if isinstance(v, str))])
    if not re.search(pack.contact_query_pattern, asked):
        shown = F.concat_ws(" ", title, _text("heading"), _text("attachment_name"), _text("snippet"), _text("chunk_text"))
        parts.append(when(F.rlike(shown, F.lit(pack.contact_pattern)), -3.0))
    if pack.office:
        parts.append(when(_text("source") == pack.office, 0.9))
    if authority is not None:
        parts.append(F.when(authority.isNotNull(), capped(2.5, authority * 0.35)).otherwise(zero))
    if plan.authority_preference:
        parts.append(when(F.contains(_text("source"), F.lit(plan.authority_preference)), 2.2))
    if intent == "attachment_query":
        parts.append(when(F.coalesce(F.size("attachments"), F.lit(0)) > 0, 2.0))
    is_row = _text("chunk_kind") == "attachment_table_row"
    parts.append(when(is_row & _any(body, specific), 1.3))
    if intent in ("eligibility_query", "attachment_query", "answer_question"):
        parts.append(when(is_row, 0.4))
    recency = dates.recency_bonus(F.col("publish_date"), as_of)
    if intent == "latest_updates":
        parts += [recency * 2, when(F.rlike(title, F.lit(pack.notice_pattern)), 2.2, -1.2)]
    else:
        parts.append(recency)
    if intent == "deadline_query":
        parts.append(dates.deadline_bonus(F.col("deadline"), as_of))
    parts.append(dates.scope_score(F.col("publish_date"), title, plan.time_scope, as_of))
    for column, name, bonus in (("applicable_colleges", "college", 2.5), ("applicable_grades", "grade", 1.8), ("student_types", "student_type", 1.2)):
        parts.append(when(audience_match(F.col(column), getattr(profile, name)), bonus))
    for column, name, bonus in (("applicable_colleges", "college", 2.0), ("applicable_grades", "grade", 1.5), ("student_types", "student_type", 1.5)):
        wanted = plan.filters.get(name)
        if isinstance(wanted, str) and wanted:
            fits = audience_match(F.col(column), wanted)
            parts.append(when(fits, bonus))
            if name == "student_type":
                parts.append(when(~fits & (F.coalesce(F.size(column), F.lit(0)) > 0), -3.0))
    return reduce(lambda a, b: a + b, parts)


def best_per_document(scored: DataFrame) -> DataFrame:
    """The best hit of each document; ties go to the earlier channel and place."""
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), "channel", "place", "chunk_id")
    return scored.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def title_dedupe(hits: DataFrame) -> DataFrame:
    """The best hit of each title (case and blanks don't count; without a title, of the snippet's start)."""
    from ..functions.text import compact

    key = F.lower(compact(F.col("title")))
    key = F.when(key == "", F.substring(_text("snippet"), 1, 120)).otherwise(key)
    order = Window.partitionBy("_key").orderBy(F.desc("score"), "channel", "place", "document_id")
    return hits.withColumn("_key", key).withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_key")


def exclude(hits: DataFrame, terms: list[str]) -> DataFrame:
    """Without the hits that have an excluded term."""
    if not terms:
        return hits
    names = F.array_join(F.transform("attachments", lambda a: F.coalesce(a["name"], F.lit(""))), " ")
    hay = F.concat_ws(" ", _text("title"), _text("source"), _text("category"), _text("snippet"), F.array_join(_list("keywords"), " "), names)
    return hits.filter(~_any(hay, terms))


def relevance_note(plan: QueryPlan, pack: LanguagePack = CHINESE) -> Column:
    """Up to four reasons for a hit."""
    title, shown = _text("title"), _text("snippet")
    terms = plans.query_strings(plan, pack, 12)[:8]
    first = lambda hay: F.get(_hits(hay, terms), F.lit(0))
    reasons = [
        F.when(_any(title, terms), F.concat(F.lit("标题包含“"), first(title), F.lit("”"))),
        F.when(_any(shown, terms), F.concat(F.lit("正文片段包含“"), first(shown), F.lit("”"))),
        F.when(_text("chunk_kind") == "attachment_table_row", F.lit("命中附件表格行")),
    ]
    if plan.intent == "deadline_query":
        reasons.append(F.coalesce(F.concat(F.lit("提取到截止日期 "), F.col("deadline").cast("string")), F.concat(F.lit("发布时间为 "), F.col("publish_date").cast("string"))))
    if plan.intent == "attachment_query":
        reasons.append(F.when(F.size("attachments") > 0, F.lit("包含附件/下载材料")))
    if topic := plan.one("topic"):
        hay = F.concat_ws(" ", title, shown, F.array_join(_list("topics"), " "), F.array_join(_list("keywords"), " "))
        reasons.append(F.when(_any(hay, plans.topic_terms(topic, pack)), F.lit(f"主题匹配：{topic}")))
    if plan.authority_preference:
        reasons.append(F.when(F.contains(_text("source"), F.lit(plan.authority_preference)), F.lit(f"权威来源偏好：{plan.authority_preference}")))
    if plan.time_scope:
        reasons.append(F.lit(f"时间范围：{plan.time_scope}"))
    return F.array_join(F.slice(F.filter(F.array(*reasons), lambda r: r.isNotNull()), 1, 4), "；")


def search(
    docs: DataFrame,
    chunks: DataFrame,
    plan: QueryPlan,
    as_of: date,
    profile: UserProfile | None = None,
    limit: int = 10,
    members: DataFrame | None = None,
    collection_id: int | None = None,
    query_vector: list[float] | None = None,
    authority: DataFrame | None = None,
    pack: LanguagePack = CHINESE,
    index: Index | None = None,
) -> DataFrame:
    """The ranked hits of a plan: document and chunk columns, base, score, note, rank.

    Channels produce narrow hits; texts are joined back to at most a few hundred of them for scoring.
    """
    profile = profile or UserProfile()
    docs = in_collection(docs, members, collection_id)
    queries = plans.query_strings(plan, pack)
    channels = [
        fulltext_channel(docs, chunks, queries, pack, index),
        like_channel(docs, plans.like_terms(plan, pack), ["title", "body", "topics", "keywords"], 1, 2.0, 0.8, attachments=True),
    ]
    if plan.intent == "profile_query":
        channels.append(profile_channel(docs, plans.profile_terms(plan, profile), reduce(DataFrame.unionByName, channels), limit))
    if query_vector and plan.intent not in ("latest_updates", "unknown"):
        channels.append(vector_channel(docs, chunks, query_vector, plan.intent == "attachment_query"))
    recalled = reduce(DataFrame.unionByName, channels)
    if plan.intent == "latest_updates" and recalled.isEmpty():
        recalled = latest_channel(docs, limit)
    full = recalled.join(docs.withColumnRenamed("id", "document_id"), "document_id")
    own = ["chunk_id", "heading", "chunk_text", "chunk_kind", "attachment_name", "chunk_tags"]
    full = full.join(chunks.select(*own), "chunk_id", "left")
    weight = None
    if authority is not None:
        full = full.join(F.broadcast(authority.select("source", F.col("authority_weight").cast("double"))), "source", "left")
        weight = F.col("authority_weight")
    scored = full.withColumn("score", feature_score(plan, profile, as_of, pack, weight))
    hits = exclude(title_dedupe(best_per_document(scored)), plan.exclude_terms).filter(~F.contains(_text("url"), F.lit("/demo/")))
    top = hits.orderBy(F.desc("score"), "channel", "place", "document_id").limit(limit)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "channel", "place", "document_id"))
    return top.withColumn("rank", rank).withColumn("score", F.round("score", 4)).withColumn("note", relevance_note(plan, pack))
