"""Registered queries of judging, evidence and answers, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import AS_OF, DOCS, documents, query, table
from .functions.text import texts
from .operators import answers, assistant, judging, quality
from .sources import attachments

HITS = """hits AS (SELECT source, doc_id AS id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS local_rank FROM documents)"""


def _hits(spark, sf):
    from pyspark.sql import Window

    local = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), local.alias("local_rank"))


@query("SELECT doc_id, s, CASE WHEN s >= 0.82 THEN 'strong' WHEN s >= 0.55 THEN 'relevant' WHEN s >= 0.25 THEN 'weak' ELSE 'irrelevant' END AS label FROM (SELECT doc_id, least(1.0, greatest(0.0, CASE WHEN r > 1 THEN r / 100 ELSE r END))::DOUBLE AS s FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id % 120 AS DOUBLE) WHEN 1 THEN (doc_id % 100) / 100.0 ELSE -1.0 END::DOUBLE AS r FROM documents))")
def score_repair(spark, sf):
    n = F.col("doc_id")
    raw = F.when(n % 3 == 0, (n % 120).cast("double")).when(n % 3 == 1, (n % 100) / 100.0).otherwise(-1.0)
    s = judging.repaired_score(raw)
    return table(spark, sf, "documents").select("doc_id", s.alias("s"), judging.label_of(s).alias("label"))


JUDGED = f"""{HITS}, j AS (SELECT d.source, l.doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 3 WHEN quality = 1 THEN 2 ELSE 0 END AS prio, (l.doc_id % 7) / 7.0 AS confidence, l.doc_id % 4 <> 0 AS keep FROM labels l JOIN documents d USING (doc_id)),
a AS (SELECT h.source, h.id, j.prio IS NOT NULL AS judged, row_number() OVER (PARTITION BY h.source ORDER BY greatest(0, prio - CASE WHEN keep THEN 0 ELSE 1 END) * CASE WHEN prio IS NULL THEN NULL ELSE 1 END DESC NULLS LAST, confidence DESC NULLS LAST, score DESC, local_rank) AS new_rank FROM hits h LEFT JOIN j ON h.source = j.source AND h.id = j.id)"""


def _judged(spark, sf):
    docs = table(spark, sf, "documents")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "direct").when(F.col("quality") == 1, "supporting").otherwise("wrong")
    judged = table(spark, sf, "labels").join(docs.select("doc_id", "source"), "doc_id").select("source", F.col("doc_id").alias("id"), label.alias("label"), ((F.col("doc_id") % 7) / 7.0).alias("confidence"), (F.col("doc_id") % 4 != 0).alias("keep"), F.lit(0).alias("seq"))
    return judging.apply_judgements(_hits(spark, sf), judged, 8, "source")


@query(f"WITH {JUDGED} SELECT source, id, CAST(new_rank AS INTEGER) AS new_rank, new_rank <= 8 AS accepted FROM a")
def judgement_apply(spark, sf):
    return _judged(spark, sf).select("source", "id", "new_rank", "accepted")


@query(f"WITH {JUDGED} SELECT source, count(*) FILTER (WHERE judged) AS judged, count(*) FILTER (WHERE new_rank <= 8) AS accepted, count(*) FILTER (WHERE new_rank > 8) AS rejected FROM a GROUP BY source")
def judgement_report(spark, sf):
    return judging.judgement_report(_judged(spark, sf), "source")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source ELSE 'AI重排：strong，匹配度 0.50' || CASE WHEN doc_id % 2 = 0 THEN '；可回答：time、' || lang ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '；原因：good hit' ELSE '' END || '；' || source END AS note FROM documents")
def rerank_notes(spark, sf):
    n = F.col("doc_id")
    label = F.when(n % 5 != 0, "strong")
    can = F.when(n % 2 == 0, F.array(F.lit(" time "), "lang")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", judging.annotated(F.col("source"), label, F.lit(0.5), can, F.when(n % 3 == 0, F.lit("good \n hit"))).alias("note"))


@query("SELECT source, doc_id AS id, mode, CAST(row_number() OVER (PARTITION BY source, mode ORDER BY CASE WHEN mode = 'relevance' THEN score ELSE day END DESC, CASE WHEN mode = 'relevance' THEN day ELSE score END DESC, doc_id) AS INTEGER) AS place FROM (SELECT source, doc_id, n_chars % 50 AS score, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 19000 + doc_id % 40 END AS day FROM documents), (VALUES ('relevance'), ('time')) m(mode)")
def client_sort(spark, sf):
    n = F.col("doc_id")
    hits = table(spark, sf, "documents").select("source", n.alias("id"), (F.col("n_chars") % 50).alias("score"), F.when(n % 9 != 0, F.date_from_unix_date((n % 40 + 19000).cast("int"))).alias("publish_date"))
    both = [judging.client_order(hits, mode, "source").withColumn("mode", F.lit(mode)) for mode in ("relevance", "time")]
    return both[0].unionByName(both[1]).select("source", "id", "mode", "place")


@query("SELECT conv_id, id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN id % 3 = 0 THEN -id END NULLS LAST, id) AS INTEGER) AS new_rank FROM (SELECT conv_id, turn AS id FROM conversations)")
def cited_first(spark, sf):
    hits = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("rank"))
    cites = hits.filter("id % 3 = 0").select("conv_id", "id", (-F.col("id")).alias("cite_rank"))
    return judging.cited_first(hits, cites, "conv_id").select("conv_id", "id", "new_rank")


FACTS = """f AS (SELECT conv_id, turn AS seq, role AS slot, CASE WHEN turn % 5 = 4 THEN ' ' ELSE 'r' || (turn % 2) END AS source_ref, substr(text, 1, 12) AS claim, CASE WHEN turn % 3 = 0 THEN '' ELSE substr(text, 1, 8) END AS quote, turn % 2 = 0 AS is_direct,
  CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE turn % 4 WHEN 0 THEN 'body' WHEN 1 THEN 'title' ELSE 'none' END AS evidence_type FROM conversations)"""


def _facts(spark, sf):
    t = F.col("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", t.alias("seq"), F.col("role").alias("slot"), F.when(t % 5 == 4, " ").otherwise(F.concat(F.lit("r"), t % 2)).alias("source_ref"), F.substring("text", 1, 12).alias("claim"), F.when(t % 3 == 0, "").otherwise(F.substring("text", 1, 8)).alias("quote"), (t % 2 == 0).alias("is_direct"),
        F.when(t % 3 == 0, "high").when(t % 3 == 1, "medium").otherwise("low").alias("confidence"), F.when(t % 4 == 0, "body").when(t % 4 == 1, "title").otherwise("none").alias("evidence_type"),
    )


@query(f"""WITH {FACTS}, c AS (SELECT *, coalesce(nullif(trim(quote), ''), claim) AS q FROM f WHERE seq < 28 AND trim(source_ref) <> '' AND trim(claim) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, slot, source_ref, regexp_replace(q, '\\s+', '', 'g') ORDER BY seq) AS rn FROM c),
p AS (SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id ORDER BY is_direct DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, CASE evidence_type WHEN 'title' THEN 2 WHEN 'body' THEN 1 ELSE 0 END DESC, seq) AS place FROM o WHERE rn = 1)
SELECT conv_id, seq, CAST(place AS INTEGER) AS place FROM p WHERE place <= 14""")
def fact_cards(spark, sf):
    return judging.fact_cards(_facts(spark, sf), group="conv_id").select("conv_id", "seq", "place")


@query(f"WITH {FACTS} SELECT conv_id, CASE WHEN bool_or(is_direct AND confidence = 'high') THEN 'high' WHEN bool_or(is_direct OR confidence IN ('high', 'medium')) THEN 'medium' ELSE 'low' END AS confidence FROM f GROUP BY conv_id")
def fact_confidence(spark, sf):
    return answers.fact_confidence(_facts(spark, sf), "conv_id")


@query(f"WITH {FACTS} SELECT conv_id AS query_id, string_agg(claim, '|' ORDER BY seq) AS facts, CASE WHEN bool_or(confidence = 'high') AND NOT bool_or(confidence = 'low') THEN 'high' ELSE 'medium' END AS confidence FROM f GROUP BY conv_id")
def readers_combined(spark, sf):
    results = _facts(spark, sf).select(F.col("conv_id").alias("query_id"), F.col("seq").alias("task_order"), F.array("claim").alias("facts"), "confidence")
    return answers.combined(results).select("query_id", F.array_join("facts", "|").alias("facts"), "confidence")


@query("""WITH t AS (SELECT doc_id, text, substr(string_split(text, chr(10))[1], 1, 80) AS title, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN substr(text, 3, 10) WHEN 2 THEN 'form' WHEN 3 THEN substr(text, 120, 20) ELSE 'nowhere to be found' END AS quote, CASE WHEN doc_id % 7 = 0 THEN 'attachment_text' ELSE 'body' END AS kind FROM documents),
c AS (SELECT *, regexp_replace(quote, '\\s+', '', 'g') AS q FROM t)
SELECT doc_id, CASE WHEN q = '' THEN 'none' WHEN contains(regexp_replace(title, '\\s+', '', 'g'), q) THEN 'title' WHEN contains('form.pdf', q) OR contains(q, 'form.pdf') THEN 'attachment_name' WHEN kind = 'attachment_text' THEN kind WHEN contains(regexp_replace(text, '\\s+', '', 'g'), q) THEN 'body' ELSE 'none' END AS type FROM c""")
def evidence_type(spark, sf):
    n = F.col("doc_id")
    title = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80)
    quote = F.when(n % 5 == 0, "").when(n % 5 == 1, F.substring("text", 3, 10)).when(n % 5 == 2, "form").when(n % 5 == 3, F.substring("text", 120, 20)).otherwise("nowhere to be found")
    kind = F.when(n % 7 == 0, "attachment_text").otherwise("body")
    named = F.array(F.struct(F.lit("form.pdf").alias("name")))
    return table(spark, sf, "documents").select("doc_id", judging.evidence_type(quote, title, named, kind, F.col("text")).alias("type"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'see https://example.org/' || doc_id || '. and [未收录链接已移除] (https://f.org/a)' ELSE 'see [未收录链接已移除] and [未收录链接已移除] (https://f.org/a)' END AS answer, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n_removed FROM documents""")
def answer_urls(spark, sf):
    n = F.col("doc_id")
    own = F.concat(F.lit("https://example.org/"), n)
    said = table(spark, sf, "documents").select(n.alias("id"), F.concat(F.lit("see "), own, F.lit(". and http://bad.org/x (https://f.org/a)")).alias("answer"))
    hits = table(spark, sf, "documents").select(n.alias("id"), F.when(n % 3 == 0, own).otherwise("").alias("url"), F.array(F.struct(F.lit("https://f.org/a").alias("url"))).alias("attachments"))
    return judging.allowed_urls(said, hits)


@query(f"WITH {DOCS} SELECT l.quality AS answer_id, l.doc_id AS source_id, docs.title, docs.url FROM labels l JOIN docs ON docs.id = l.doc_id WHERE docs.id % 2 = 0")
def answer_evidence(spark, sf):
    told = table(spark, sf, "labels").select(F.col("quality").alias("answer_id"), F.col("doc_id").alias("source_id"), F.lit("q").alias("quote"))
    return judging.restricted_evidence(told, documents(spark, sf).filter("id % 2 = 0")).select("answer_id", "source_id", "title", "url")


@query("""WITH b AS (SELECT source, doc_id, length(substr(text, 1, 300)) AS n FROM documents), r AS (SELECT source, doc_id, n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM b WHERE true),
t AS (SELECT source, k, n, sum(n + 2) OVER (PARTITION BY source ORDER BY k) - 2 AS upto FROM r WHERE k <= 12), s AS (SELECT source, min(k) FILTER (WHERE upto > 1500) AS over, max(upto) AS whole FROM t GROUP BY source),
f AS (SELECT s.source, s.over, s.whole, coalesce(t.upto, 0) AS before FROM s LEFT JOIN t ON t.source = s.source AND t.k = s.over - 1)
SELECT source, CAST(CASE WHEN over IS NULL THEN whole WHEN 1500 - before - 2 >= 120 THEN CASE WHEN before = 0 THEN 1498 ELSE 1500 END ELSE before END AS INTEGER) AS n FROM f""")
def context_blocks(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.substring("text", 1, 300).alias("t"))
    # at most 12 blocks of each source
    listed = judging.with_quota(rows.withColumn("k", F.lit("any")), ["source"], "k", [F.col("doc_id")], 12, {}).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]).alias("b"))
    return listed.select("source", F.length(answers.packed_blocks(F.col("b"), 1500)).alias("n"))


@query(f"WITH {DOCS}, r AS (SELECT source, publish_date, deadline, row_number() OVER (PARTITION BY source ORDER BY id) AS rank FROM docs) SELECT coalesce(bool_or(date_diff('day', publish_date, DATE '2024-02-01') > 730), false) AS has_old, coalesce(bool_or(deadline < DATE '2024-02-01'), false) AS has_past_deadline FROM r WHERE rank <= 5")
def answer_warnings(spark, sf):
    from pyspark.sql import Window

    hits = documents(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("id")))
    return judging.warnings(hits, AS_OF)


@query("SELECT event_type AS service_type, count(*) AS facts FROM events GROUP BY event_type")
def service_facts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("service_type")).agg(F.count(F.lit(1)).alias("facts"))


@query("SELECT count(*) AS facts, count(DISTINCT event_type) AS services FROM events")
def assistant_stats(spark, sf):
    return assistant.stats(table(spark, sf, "events").withColumnRenamed("event_type", "service_type"))


@query("SELECT event_type AS kind, CASE WHEN user_id % 2 = 0 THEN 'ok' ELSE 'too_large' END AS status, count(*) AS n FROM events GROUP BY ALL")
def attachment_counters(spark, sf):
    read = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, "ok").otherwise("too_large").alias("status"))
    return attachments.outcome_counts(read)


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS with_attachments, CAST((SELECT sum(doc_id % 3) FROM documents) AS BIGINT) AS attachments, CAST((SELECT sum(CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 ELSE 0 END) FROM documents) AS BIGINT) AS attachments_with_text, (SELECT count(*) FROM lineitem) AS chunks")
def index_stats(spark, sf):
    n = F.col("doc_id")
    one = F.struct(F.when(n % 2 == 0, "text").otherwise(" ").alias("text"))
    docs = table(spark, sf, "documents").select(F.array_repeat(one, (n % 3).cast("int")).alias("attachments"))
    return quality.index_stats(docs, table(spark, sf, "lineitem"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'r1,r2,r3' WHEN doc_id % 4 = 1 THEN 'r2,r3' WHEN doc_id % 4 = 2 THEN 'r3,r4' ELSE 'r5,r4' END AS refs FROM documents")
def ranked_refs(spark, sf):
    n = F.col("doc_id") % 4
    none = F.array().cast("array<string>")
    review = lambda *x: F.array(*(F.struct(F.lit(r).alias("ref"), F.lit(v).alias("verdict"), F.lit(None).cast("double").alias("score")) for r, v in x))
    used = F.when(n == 0, texts(["r1"])).otherwise(none)
    ranked = F.when(n <= 1, texts(["r2", "r3"])).otherwise(none)
    reviews = F.when(n == 2, review(("r4", "weak"), ("r3", "direct"), ("r9", "none"))).when(n == 3, review(("r4", "weak"), ("r5", "partial"), ("r4", "none"))).otherwise(review(("r3", "direct"), ("r2", "weak"), ("r1", "none")))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), used.alias("used_refs"), ranked.alias("ranked_refs"), reviews.alias("reviews"))
    placed = answers.ranked_refs(rows).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "ref"))).alias("l"))
    return placed.select(F.col("id").alias("doc_id"), F.array_join(F.transform("l", lambda x: x["ref"]), ",").alias("refs"))
