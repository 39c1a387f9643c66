"""Registered queries of fields, terms, vectors and statistics, with the same in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .catalogue import AS_OF, DOCS, documents, query, table
from .catalogue_rules import QS, _sql, queries_table
from .functions import dates, text, vectors
from .functions.text import texts
from .lexicon import LATIN
from .operators import cleaning, enrich, metadata, quality, search, store

#: Lines that dates, deadlines and cleaning rules are tried on, chosen by the document's number.
LINES = ["发布时间：2024-3-5", "报名截至2023年12月31日止", "2024/02/30", "no date", "2021.1.1 x 2022.2.2", "请于2024年5月6日之前提交", "截止日期为2024-07-08", "English", "Home About Contact Login", "Home...", "|", "Copyright 2024", "a plain line of text that says something", "二、办理流程", "（见附件", "说明："]
PICK = f"{_sql(LINES)}[1 + doc_id % {len(LINES)}]"
DATE = r"(20[0-9]{2})[-./年]([0-9]{1,2})[-./月]([0-9]{1,2})"


def lines_table(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.get(texts(LINES), (F.col("doc_id") % len(LINES)).cast("int")).alias("line"), F.get(texts(LINES), ((F.col("doc_id") + 5) % len(LINES)).cast("int")).alias("next"))


def _date(of: str) -> str:
    part = lambda k: f"lpad(regexp_extract({of}, '{DATE}', {k}), 2, '0')"
    return f"CASE WHEN regexp_matches({of}, '{DATE}') THEN TRY_CAST(regexp_extract({of}, '{DATE}', 1) || '-' || {part(2)} || '-' || {part(3)} AS DATE) END"


@query(f"SELECT id, CAST({_date('line')} AS VARCHAR) AS day FROM (SELECT doc_id AS id, {PICK} AS line FROM documents)")
def date_parse(spark, sf):
    return lines_table(spark, sf).select("id", dates.parsed(F.col("line")).cast("string").alias("day"))


LATE = r"(?:截止|截至)[^\n]{0,20}?(20[0-9]{2}[-./年][0-9]{1,2}[-./月][0-9]{1,2})"
BEFORE = r"(20[0-9]{2}[-./年][0-9]{1,2}[-./月][0-9]{1,2})[^\n]{0,12}?(?:截止|之前|前)"


@query(f"SELECT id, CAST(coalesce({_date(f'regexp_extract(line, {chr(39)}{LATE}{chr(39)}, 1)')}, {_date(f'regexp_extract(line, {chr(39)}{BEFORE}{chr(39)}, 1)')}) AS VARCHAR) AS deadline FROM (SELECT doc_id AS id, {PICK} AS line FROM documents)")
def deadline_dates(spark, sf):
    return lines_table(spark, sf).select("id", enrich.deadline(F.col("line")).cast("string").alias("deadline"))


BOTH = "q || ' ' || identity"


@query(f"""WITH {QS} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({BOTH}, '{enrich.COLLEGES}'), lambda c: c NOT IN ('各学院', '相关学院', '所在学院', '学生所在学院')))), ',') AS colleges,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({BOTH}, '20[0-9]{{2}} *级|大[一二三四五六]|研[一二三]|博士[一二三四五]'), lambda g: replace(g, ' ', '')))), ',') AS grades FROM qs""")
def audience_fields(spark, sf):
    both = F.concat("q", F.lit(" "), "identity")
    return queries_table(spark, sf).select("id", F.array_join(enrich.colleges(both), ",").alias("colleges"), F.array_join(enrich.grades(both), ",").alias("grades"))


TYPES = ["本科生", "研究生", "硕士", "博士", "留学生"]


@query(f"WITH {QS} SELECT id, array_to_string(list_filter({_sql(TYPES)}, lambda t: contains({BOTH}, t)), ',') AS types FROM qs")
def student_types(spark, sf):
    return queries_table(spark, sf).select("id", F.array_join(enrich.in_lexicon(F.concat("q", F.lit(" "), "identity"), TYPES), ",").alias("types"))


PATHS = {"/en/": "english", "page=": "paged", "/fr/": "french"}


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(url, '{p}') THEN '{n}'" for p, n in PATHS.items()) + " ELSE right(url, 40) END AS category FROM pages")
def page_category(spark, sf):
    return table(spark, sf, "pages").select("page_id", enrich.category(F.col("url"), F.col("url"), PATHS).alias("category"))


@query(f"WITH {DOCS} SELECT id FROM docs WHERE title <> '' AND length(body) >= 30 AND (publish_date IS NULL OR date_diff('day', publish_date, DATE '2024-02-01') <= 730)")
def recency_cut(spark, sf):
    docs = documents(spark, sf).filter((F.col("title") != "") & (F.length("body") >= 30))
    return docs.filter(F.col("publish_date").isNull() | (dates.age_days(F.col("publish_date"), AS_OF) <= 730)).select("id")


@query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n, substr(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 120) AS shown FROM documents")
def plain_texts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(text.compact(t)).alias("n"), text.collapsed(t, 120, tags=True).alias("shown"))


@query(f"""WITH {QS}, t AS (SELECT id, list_concat(list_concat(regexp_extract_all(q, '20[0-9]{{2}}(?:-[0-9]{{4}})?学年|20[0-9]{{2}}级|20[0-9]{{2}}届|20[0-9]{{2}}'), regexp_extract_all(q, '[A-Za-z][A-Za-z0-9_-]{{1,}}')), list_filter(regexp_extract_all(q, '[一-鿿]{{2,12}}'), lambda r: length(r) <= 6)) AS l FROM qs)
SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS terms FROM t""")
def title_terms(spark, sf):
    return queries_table(spark, sf).select("id", F.array_join(text.deduped(text.title_terms(F.col("q"))), ",").alias("terms"))


@query(f"""WITH {QS}, r AS (SELECT id, unnest(regexp_extract_all(q, '[一-鿿]{{2,24}}')) AS run, generate_subscripts(regexp_extract_all(q, '[一-鿿]{{2,24}}'), 1) AS i FROM qs),
g AS (SELECT id, i * 1000 AS pl, run AS term FROM r WHERE length(run) <= 8 UNION ALL SELECT id, i * 1000 + n * 100 + k, substr(run, k, n) FROM r, range(2, 5) x(n), range(1, 25) y(k) WHERE k + n - 1 <= length(run)),
f AS (SELECT id, term, min(pl) AS pl FROM g GROUP BY ALL)
SELECT id, coalesce(grams, '') AS grams FROM qs LEFT JOIN (SELECT id, string_agg(term, ' ' ORDER BY pl) AS grams FROM f GROUP BY id) USING (id)""")
def run_grams(spark, sf):
    return queries_table(spark, sf).select("id", F.array_join(text.deduped(text.run_terms(F.col("q"), text.CJK + "{2,24}")), " ").alias("grams"))


@query(f"SELECT id, " + "(" + " + ".join(f"CAST(contains(line, '{t}') AS INTEGER)" for t in LATIN.nav_terms) + ") AS n_terms, line IN ('Home', 'About', 'Contact', 'Sitemap', 'Login', 'English') OR (" + " + ".join(f"CAST(contains(line, '{t}') AS INTEGER)" for t in LATIN.nav_terms) + ") >= 4 OR (length(line) <= 24 AND ((" + " + ".join(f"CAST(contains(line, '{t}') AS INTEGER)" for t in LATIN.nav_terms) + f") >= 1 OR suffix(line, '...'))) AS is_nav FROM (SELECT doc_id AS id, {PICK} AS line FROM documents)")
def navigation_lines(spark, sf):
    return lines_table(spark, sf).select("id", cleaning.nav_terms(F.col("line"), LATIN).alias("n_terms"), cleaning.is_navigation(F.col("line"), LATIN).alias("is_nav"))


PARTED = "list_filter(list_transform(string_split(replace(text, '. ', chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]{2,}', ' ', 'g'))), lambda x: x <> '')"


@query(f"""WITH l AS (SELECT doc_id, {PARTED} AS l FROM documents), f AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(x, '(?:(?i)all rights reserved)|(?:(?i)copyright)')), true) AS p FROM l)
SELECT doc_id, CAST(CASE WHEN coalesce(p, 0) = 0 THEN len(l) ELSE p - 1 END AS INTEGER) AS n_lines FROM f""")
def footer_cut(spark, sf):
    lines = text.normalised_lines(F.replace("text", F.lit(". "), F.lit("\n")))
    return table(spark, sf, "documents").select("doc_id", F.size(cleaning.above_footer(lines, LATIN)).alias("n_lines"))


A, B = "regexp_replace(l, '\\s+', '', 'g')", "regexp_replace(r, '\\s+', '', 'g')"


@query(f"""WITH p AS (SELECT doc_id AS id, {PICK} AS l, {_sql(LINES)}[1 + (doc_id + 5) % {len(LINES)}] AS r FROM documents)
SELECT id, CASE WHEN {A} = '' OR {B} = '' OR regexp_matches({B}, '^(?:[一二三四五六七八九十]+、|附件[0-9]*[:：]|第[0-9]+页[:：])') THEN false WHEN length({A}) <= 12 AND regexp_matches(l, '[：:]$') AND NOT regexp_matches(r, '^[）)、]') THEN false
  WHEN regexp_matches(l, '{cleaning.OPEN_END}') OR regexp_matches(r, '{cleaning.GLUED_START}') OR regexp_matches({A}, '^(?:[0-9]{{1,4}}(?:-[0-9]{{1,4}})?|[0-9]{{1,2}}[:：][0-9]{{2}}~?[0-9]*)$') THEN true
  WHEN regexp_matches(l, '[。！？；;]$') THEN false ELSE length({B}) <= 6 OR length({A}) <= 18 END AS joins FROM p""")
def line_joins(spark, sf):
    return lines_table(spark, sf).select("id", cleaning.joins(F.col("line"), F.col("next")).alias("joins"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]{2,}', ' ', 'g'))), lambda x: x <> '') AS l, regexp_replace(substr(string_split(text, chr(10))[1], 1, 80), '\\s+', '', 'g') AS t FROM documents),
p AS (SELECT *, list_position(list_transform(l, lambda x: t <> '' AND contains(regexp_replace(x, '\\s+', '', 'g'), t)), false) AS p FROM l)
SELECT doc_id, CAST(CASE WHEN coalesce(p, 0) = 0 THEN 0 ELSE len(l) - p + 1 END AS INTEGER) AS n_lines FROM p""")
def head_cut(spark, sf):
    lines = text.normalised_lines(F.col("text"))
    title = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80)
    return table(spark, sf, "documents").select("doc_id", F.size(cleaning.below_head(lines, title)).alias("n_lines"))


@query(f"WITH {DOCS} SELECT id, sha256(substr('标题 ' || title || chr(10) || '网址 ' || url || chr(10) || '来源 ' || source || chr(10) || '栏目 ' || category || chr(10) || '正文 ' || body, 1, 2400)) AS digest FROM docs")
def embedding_text(spark, sf):
    listed = {"标题": "title", "网址": "url", "来源": "source", "栏目": "category", "正文": "body"}
    return documents(spark, sf).select("id", F.sha2(F.encode(vectors.embedding_text({k: F.col(c) for k, c in listed.items()}), "UTF-8"), 256).alias("digest"))


@query("""SELECT doc_id, array_to_string(['tion', lang], ',') AS topics, round(CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 3 = 1 THEN 0.0 ELSE 0.25 END, 6)::DOUBLE AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'deadline' ELSE 'other' END AS kind, 'tion,' || lang || ',' || source AS terms FROM documents""")
def metadata_normalise(spark, sf):
    n = F.col("doc_id")
    raw = F.format_string('{"topics": ["tion", " %s ", "tion"], "audience": ["%s"], "confidence": %s, "time_points": [{"type": "%s", "date": "d", "text": "t"}], "extra": 1}', F.col("lang"), F.col("source"), F.when(n % 3 == 0, "7").when(n % 3 == 1, "-2").otherwise("0.25"), F.when(n % 2 == 0, "DEADLINE").otherwise("sometime"))
    made = table(spark, sf, "documents").select("doc_id", metadata.normalised(raw).alias("m"))
    return made.select("doc_id", F.array_join("m.topics", ",").alias("topics"), "m.confidence", F.get("m.time_points", F.lit(0))["type"].alias("kind"), F.array_join(metadata.terms(F.col("m")), ",").alias("terms"))


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: round(x / n, 6))), 4) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)")
def vector_normalise(spark, sf):
    unit = vectors.normalised(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


CHANNEL = "SELECT vec_id, vec_id % 97 AS doc, CASE vec_id % 3 WHEN 0 THEN 'body' WHEN 1 THEN 'attachment_text' ELSE 'attachment_table_row' END AS kind, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY vec_id DESC LIMIT 400"


@query(f"WITH c AS ({CHANNEL}), b AS (SELECT * FROM c WHERE s > 0.18 ORDER BY s DESC, vec_id LIMIT 24) SELECT doc AS document_id, vec_id AS chunk_id, round(greatest(0.1, s * 4 + CASE kind WHEN 'attachment_text' THEN -0.35 WHEN 'attachment_table_row' THEN 0.15 ELSE 0 END + CASE WHEN doc % 2 = 0 THEN 0.25 ELSE 0 END), 5) AS base FROM b")
def vector_recall(spark, sf):
    rows = table(spark, sf, "embeddings")
    wanted = [float(x) for x in rows.filter("vec_id = 1").first()["embedding"]]
    kind = F.when(F.col("vec_id") % 3 == 0, "body").when(F.col("vec_id") % 3 == 1, "attachment_text").otherwise("attachment_table_row")
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 97).alias("document_id"), kind.alias("chunk_kind"), F.lit("text").alias("chunk_text"), "embedding")
    docs = spark.range(97).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("attachments"))
    return search.vector_channel(docs, chunks, wanted, True, 400).select("document_id", "chunk_id", F.round("base", 5).alias("base"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 5 = 0) AS missing, count(*) FILTER (WHERE vec_id % 5 <> 0 AND vec_id % 7 = 0) AS stale FROM embeddings")
def embedding_coverage(spark, sf):
    signed = F.struct(F.lit("hash").alias("provider"), F.lit("m").alias("model"), F.lit(vectors.DIMENSIONS).alias("dim"), F.when(F.col("vec_id") % 7 == 0, 1).otherwise(vectors.VERSION).alias("version"), F.col("embedding").alias("vector"))
    rows = table(spark, sf, "embeddings").select(F.when(F.col("vec_id") % 5 != 0, signed).alias("embedding"))
    return quality.embedding_coverage(rows, "hash", "m")


@query(f"WITH {DOCS} SELECT id FROM docs ORDER BY publish_date DESC NULLS LAST, id DESC LIMIT 12")
def latest_recall(spark, sf):
    return search.latest_channel(documents(spark, sf), 12).select(F.col("document_id").alias("id"))


@query(f"WITH {DOCS}, h AS (SELECT id, row_number() OVER (ORDER BY publish_date DESC, id DESC) AS place FROM docs WHERE source ILIKE '%src3%' OR title ILIKE '%src3%' OR body ILIKE '%src3%') SELECT id FROM h WHERE place <= 20")
def profile_recall(spark, sf):
    docs = documents(spark, sf)
    nothing = docs.limit(0).select(F.col("id").alias("document_id"))
    return search.profile_channel(docs, ["src3"], nothing, 10).select(F.col("document_id").alias("id"))


@query(f"WITH {DOCS} SELECT id FROM docs WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def collection_scope(spark, sf):
    members = table(spark, sf, "labels").select(F.col("quality").cast("bigint").alias("collection_id"), F.col("doc_id").alias("document_id"))
    return search.in_collection(documents(spark, sf), members, 1).select("id")


@query(f"WITH {DOCS}, s AS (SELECT id, body, strpos(body, 'the') AS p FROM docs) SELECT id, CASE WHEN p = 0 THEN substr(body, 1, 180) ELSE replace(substr(body, greatest(1, p - 80), p - greatest(1, p - 80) + 103), 'the', '<mark>the</mark>') END AS shown FROM s")
def match_snippet(spark, sf):
    return documents(spark, sf).select("id", text.snippet(F.col("body"), F.lit("the")).alias("shown"))


@query("SELECT doc_id, replace(replace('$TODAY ' || lang || ' $YEAR', '$TODAY', '2024-02-01'), '$YEAR', '2024') AS term FROM documents")
def dynamic_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", quality.dynamic(F.concat(F.lit("$TODAY "), "lang", F.lit(" $YEAR")), AS_OF).alias("term"))


@query("SELECT lang AS issue, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE n_chars < 400) WHERE rn <= 8")
def issue_samples(spark, sf):
    return quality.samples(table(spark, sf, "documents").filter("n_chars < 400"), F.col("lang"), "doc_id").select("issue", "doc_id")


@query("SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def chunks_per_document(spark, sf):
    return quality.chunks_per_document(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id")))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS greatest, max(value) FILTER (WHERE rn = greatest(1, CAST(floor(n * 0.95) AS BIGINT))) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def eval_latencies(spark, sf):
    out = quality.latencies(table(spark, sf, "events"), "event_type", "value")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query(f"WITH {DOCS} SELECT id, CAST(publish_date AS VARCHAR) AS day FROM docs WHERE id % 11 <> 0")
def date_repair(spark, sf):
    docs = documents(spark, sf).withColumn("url", F.when(F.col("id") % 11 == 0, F.lit("https://x.org/demo/1")).otherwise(F.concat(F.lit("https://x.org/"), F.date_format("publish_date", "yyyy/MMdd"), F.lit("/a.htm"))))
    return store.date_repair(docs.withColumn("publish_date", F.lit(date(2000, 1, 1)))).select("id", F.col("publish_date").cast("string").alias("day"))


@query("SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, 'old' AS chunk_text FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 4 = 0")
def chunks_replaced(spark, sf):
    old = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("chunk_index"), F.lit("old").alias("chunk_text"))
    fresh = table(spark, sf, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("new").alias("chunk_text"))
    return store.replace_chunks(old, fresh)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1, 2)")
def stale_chunks(spark, sf):
    n = F.col("doc_id") % 4
    rows = table(spark, sf, "documents").select("doc_id", F.when(n == 0, " ").otherwise("x").alias("search_text"), F.when(n == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))).alias("chunk_tags"), F.when(n == 2, 0).otherwise(3).alias("token_count"))
    return store.stale_chunks(rows).select("doc_id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 2 ORDER BY doc_id % 1600, doc_id DESC LIMIT 50 OFFSET 10")
def metadata_candidates(spark, sf):
    n = F.col("doc_id") % 3
    raw = F.when(n == 0, None).when(n == 1, '{"topics": []}').otherwise('{"topics": ["a"]}')
    docs = documents(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), raw.cast("string").alias("ai_metadata")), "id")
    return metadata.candidates(docs, 50, 10).select("id")


@query("SELECT doc_id AS id, CASE WHEN quality IS NOT NULL THEN 'q' || quality ELSE source END AS ai_metadata FROM documents LEFT JOIN labels USING (doc_id)")
def metadata_update(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("ai_metadata"))
    return metadata.updated(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), "quality").alias("ai_metadata")))


@query("SELECT doc_id AS id FROM documents WHERE n_chars < 200 AND doc_id % 4 = 0 AND doc_id % 8 <> 0")
def empty_bodies(spark, sf):
    n = F.col("doc_id")
    docs = table(spark, sf, "documents").filter("n_chars < 200").select(n.alias("id"), F.when(n % 4 == 0, F.lit("short")).otherwise(F.repeat(F.lit("x"), 50)).alias("body"), F.array(F.struct(F.when(n % 8 == 0, F.repeat(F.lit("y"), 90)).otherwise(F.lit("z")).alias("text"))).alias("attachments"))
    return store.empty_bodies(docs).select("id")


@query("SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS category, CAST(0 AS INTEGER) AS views FROM documents")
def schema_evolution(spark, sf):
    return store.evolved(table(spark, sf, "documents").select("doc_id", "lang"), {"category": ("string", None), "views": ("int", 0)})


@query("SELECT page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 7 = 0)")
def key_lookup(spark, sf):
    pages = table(spark, sf, "pages")
    return store.by_keys(pages, pages.filter("page_id % 7 = 0").select("url"), "url").select("page_id")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE id % 3 = 0 ORDER BY publish_date DESC NULLS LAST, id DESC LIMIT 30")
def documents_with_attachments(spark, sf):
    docs = documents(spark, sf).withColumn("attachments", F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    return store.with_attachments(docs, 30).select("id")


@query("SELECT name, 'base-' || g || CASE WHEN rn = 1 THEN '' ELSE '-' || rn END AS slug FROM (SELECT 'Base ' || (doc_id % 5) || repeat('!', CAST(doc_id // 5 AS INTEGER)) AS name, CAST(doc_id % 5 AS VARCHAR) AS g, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY 'Base ' || (doc_id % 5) || repeat('!', CAST(doc_id // 5 AS INTEGER))) AS rn FROM documents WHERE doc_id < 40)")
def unique_slugs(spark, sf):
    names = table(spark, sf, "documents").filter("doc_id < 40").select(F.concat(F.lit("Base "), F.col("doc_id") % 5, F.repeat(F.lit("!"), F.floor(F.col("doc_id") / 5).cast("int"))).alias("name"))
    return store.unique_slug(spark.createDataFrame([], "slug string"), names)

