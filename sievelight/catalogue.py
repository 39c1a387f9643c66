"""The registered queries of the search engine and SQL that gives the same rows.

``documents`` stands in for a collection's documents: the title is the first line's start, dates follow from the id.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, text, vectors
from .functions.lineage import fresh_folder
from .lexicon import LATIN
from .operators import chunking, cleaning, enrich, fulltext, index, judging, quality, search, store
from .plans.query_plan import QueryPlan, UserProfile
from .sources import pages as web
from .streaming import tasks

AS_OF = date(2024, 2, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The adapter in SQL.
DOCS = """docs AS (
  SELECT doc_id AS id, substr(string_split(text, chr(10))[1], 1, 80) AS title, 'https://example.org/' || doc_id AS url, source, lang AS category,
         text AS body, DATE '2024-01-01' - CAST(doc_id % 1600 AS INTEGER) AS publish_date,
         CASE WHEN doc_id % 5 = 0 THEN DATE '2024-01-01' - CAST(doc_id % 1600 AS INTEGER) + 30 END AS deadline
  FROM documents)"""
RECENCY = "CASE WHEN {d} IS NULL THEN 0.0 WHEN date_diff('day', {d}, {a}) < 0 THEN 0.2 ELSE greatest(0.0, 1.5 - log10(date_diff('day', {d}, {a}) + 1)) END::DOUBLE"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    day = F.date_sub(F.lit(date(2024, 1, 1)), (F.col("doc_id") % 1600).cast("int"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80).alias("title"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id")).alias("url"),
        "source",
        F.col("lang").alias("category"),
        F.col("text").alias("body"),
        day.alias("publish_date"),
        F.when(F.col("doc_id") % 5 == 0, F.date_add(day, 30)).alias("deadline"),
        none.alias("topics"),
        none.alias("keywords"),
        F.array().cast("array<struct<name:string,url:string,text:string,pages:array<struct<page:int,text:string>>>>").alias("attachments"),
        none.alias("applicable_colleges"),
        none.alias("applicable_grades"),
        F.array("lang").alias("student_types"),
    )


@query("SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS average FROM documents")
def doc_stats(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("average"))


@query(f"WITH {DOCS} SELECT source, count(*) AS n, CAST(min(publish_date) AS VARCHAR) AS first_date, CAST(max(publish_date) AS VARCHAR) AS last_date, count(*) FILTER (WHERE publish_date IS NULL) AS missing_dates FROM docs GROUP BY source")
def source_summary(spark, sf):
    out = quality.source_summary(documents(spark, sf))
    return out.withColumn("first_date", F.col("first_date").cast("string")).withColumn("last_date", F.col("last_date").cast("string"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + greatest(1, len(regexp_extract_all(text, '[一-鿿]')) // 2) AS BIGINT) AS n_tokens FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query(f"WITH {DOCS} SELECT id, sha256(url || chr(10) || title || chr(10) || body || chr(10) || '[]') AS content_hash FROM docs")
def content_hash(spark, sf):
    return documents(spark, sf).select("id", enrich.content_hash(F.col("url"), F.col("title"), F.col("body")).alias("content_hash"))


@query(f"WITH {DOCS} SELECT min(id) AS id FROM docs GROUP BY title, body")
def dup_docs_keep_min(spark, sf):
    return store.without_duplicates(documents(spark, sf)).select("id")


@query("SELECT sha256(substr(text, 1, 1200)) AS prefix, count(*) AS n FROM documents GROUP BY substr(text, 1, 1200) HAVING count(*) > 1")
def dup_prefix(spark, sf):
    return quality.duplicate_groups(table(spark, sf, "documents"), F.substring("text", 1, 1200)).select(F.sha2(F.encode("value", "UTF-8"), 256).alias("prefix"), "n")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_children(spark, sf):
    return store.missing_children(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def orphans(spark, sf):
    return store.orphans(table(spark, sf, "documents"), table(spark, sf, "labels").filter("quality = 1"), "doc_id", "doc_id").select("doc_id")


@query(f"""WITH {DOCS}, t AS (
  SELECT id, title, unnest(regexp_extract_all(title || chr(10) || substr(body, 1, 12000), '[A-Za-z][A-Za-z0-9_-]{{1,}}|20[0-9]{{2}}级|20[0-9]{{2}}|[一-鿿]{{2,8}}')) AS term, generate_subscripts(regexp_extract_all(title || chr(10) || substr(body, 1, 12000), '[A-Za-z][A-Za-z0-9_-]{{1,}}|20[0-9]{{2}}级|20[0-9]{{2}}|[一-鿿]{{2,8}}'), 1) AS pos FROM docs),
w AS (SELECT id, term, CAST(sum(CASE WHEN contains(title, term) THEN 3 ELSE 1 END) AS BIGINT) AS weight, min(pos) AS f FROM t WHERE term NOT IN ('the', 'and', 'for', 'with') GROUP BY id, term)
SELECT id, term, weight, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, f, term) AS INTEGER) AS place FROM w) WHERE place <= 24""")
def keyword_topn(spark, sf):
    return enrich.keywords(documents(spark, sf), "id", "title", "body", LATIN)


@query("""SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS n_chars
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]{2,}', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)""")
def body_lines(spark, sf):
    lines = text.normalised_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.aggregate(lines, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("n_chars"))


@query("SELECT doc_id, CAST(" + " + ".join(f"CAST(contains(text, '{t}') AS INTEGER)" for t in LATIN.boilerplate_terms) + " AS INTEGER) AS score FROM documents")
def boilerplate_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.boilerplate_score(F.col("text"), LATIN).alias("score"))


@query()
def clean_body(spark, sf):
    return documents(spark, sf).select("id", cleaning.clean_body(F.col("body"), F.col("title"), LATIN).alias("body"))


@query()
def chunk_documents(spark, sf):
    return chunking.chunk_documents(documents(spark, sf), LATIN)


@query()
def index_chunks(spark, sf):
    return chunking.indexed(documents(spark, sf), LATIN)


@query("""SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_total FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(strip_accents(lower(text)), '[^\\pL\\pN]+')) AS term FROM documents) WHERE term <> '' GROUP BY ALL) GROUP BY term""")
def postings(spark, sf):
    index = fulltext.term_counts(table(spark, sf, "documents"), "doc_id", ["text"])
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_total"))


def benchmark_queries(spark, sf) -> dict[int, str]:
    """The first four words of every benchmark item: the query set, a table of tens of rows."""
    rows = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 4), " ").alias("q"))
    return {r["item_id"]: r["q"] for r in rows.collect()}


@query(f"""WITH {DOCS},
f AS (SELECT id, 'title' AS field, title AS v, 4.0 AS w FROM docs UNION ALL SELECT id, 'body', body, 1.0 FROM docs),
tok AS (SELECT id, field, w, unnest(string_split_regex(strip_accents(lower(v)), '[^\\pL\\pN]+')) AS term FROM f),
tf AS (SELECT id, term, sum(w) AS f FROM tok WHERE term <> '' GROUP BY id, term),
len AS (SELECT docs.id, count(tok.id) AS length FROM docs LEFT JOIN tok ON tok.id = docs.id AND tok.term <> '' GROUP BY docs.id),
corpus AS (SELECT count(*) AS n_rows, avg(length) AS average FROM len),
q AS (SELECT DISTINCT item_id, lower(unnest(list_slice(regexp_extract_all(text, '[A-Za-z]+'), 1, 4))) AS term FROM benchmark),
hit AS (SELECT item_id, q.term, id, f FROM q JOIN tf USING (term)),
n AS (SELECT item_id, term, count(*) AS n_with FROM hit GROUP BY ALL),
s AS (SELECT item_id, hit.id, -sum(CASE WHEN ln((n_rows - n_with + 0.5) / (n_with + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n_with + 0.5) / (n_with + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / average))) AS rank
  FROM hit JOIN n USING (item_id, term) JOIN len ON len.id = hit.id, corpus GROUP BY ALL)
SELECT item_id, id, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rank, 6), id) AS place FROM s) WHERE place <= 60""")
def bm25_topk(spark, sf):
    docs = documents(spark, sf)
    weights = {"title": 4.0, "body": 1.0}
    asked = benchmark_queries(spark, sf)
    phrases = fulltext.queries_frame(spark, asked, LATIN)
    several = any(len(p) > 1 for q in asked.values() for p in fulltext.query_phrases(q, LATIN))
    made = fulltext.postings if several else fulltext.term_counts
    ranks = fulltext.bm25(made(docs, "id", list(weights), phrases), fulltext.lengths(docs, "id", list(weights)), phrases, "id", weights)
    return fulltext.top_hits(ranks.withColumn("rank", F.round("rank", 6)), "id").select(F.col("query_id").alias("item_id"), "id", "rank")


LIKE = ["tion", "the", "license", "100%", "de_la"]


@query(f"WITH {DOCS}, t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(LIKE)) + """) v(n, term)),
h AS (SELECT n, id, CASE WHEN contains(title, term) THEN 2.0 ELSE 0.8 END::DOUBLE AS base, row_number() OVER (PARTITION BY n ORDER BY publish_date DESC, id DESC) AS place
  FROM docs, t WHERE title ILIKE '%' || term || '%' OR body ILIKE '%' || term || '%')
SELECT id AS document_id, base, CAST(n * 1000 + place AS BIGINT) AS place FROM h WHERE place <= 30""")
def like_recall(spark, sf):
    return search.like_channel(documents(spark, sf), LIKE, ["title", "body"], 1, 2.0, 0.8).select("document_id", "base", "place")


VECTOR_SIMS = "SELECT e.vec_id, e.label, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _similar(spark, sf) -> DataFrame:
    vectors_table = table(spark, sf, "embeddings")
    wanted = vectors_table.filter("vec_id = 0").select("embedding").first()[0]
    return vectors_table.withColumn("s", vectors.dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in wanted))))


@query(f"WITH v AS ({VECTOR_SIMS}) SELECT vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (ORDER BY round(s, 6) DESC, vec_id) AS rn FROM v WHERE s > 0.18) WHERE rn <= 24")
def vector_topk(spark, sf):
    return _similar(spark, sf).filter("s > 0.18").select("vec_id", F.round("s", 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(24)


@query(f"WITH v AS ({VECTOR_SIMS}) SELECT label, count(*) AS n FROM v WHERE s > 0.18 GROUP BY label")
def vector_threshold(spark, sf):
    return _similar(spark, sf).filter("s > 0.18").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS token FROM documents),
c AS (SELECT doc_id, token, count(*) AS n FROM t WHERE length(token) >= 2 GROUP BY ALL),
s AS (SELECT doc_id, CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % 128 AS dim, sum(CASE WHEN CAST('0x' || substr(sha256(token), 9, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END * ln(1 + n)) AS w FROM c GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM s GROUP BY doc_id)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(round(w / norm, 6), 3) AS value FROM s JOIN n USING (doc_id) WHERE norm > 0 AND abs(round(w / norm, 6)) >= 0.01""")
def hash_embed_dims(spark, sf):
    made = vectors.hash_embeddings(table(spark, sf, "documents"), "doc_id", "text")
    flat = made.select("doc_id", F.posexplode("vector").alias("dim", "value"))
    return flat.filter("abs(value) >= 0.01").select("doc_id", "dim", F.round("value", 3).alias("value"))


@query("""SELECT document_id, chunk_id, score FROM (SELECT l_orderkey AS document_id, l_linenumber AS chunk_id, CAST(l_extendedprice AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_extendedprice AS DOUBLE) DESC, l_suppkey % 5, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def best_per_doc(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_extendedprice").cast("double").alias("score"), (F.col("l_suppkey") % 5).alias("channel"), F.col("l_linenumber").alias("place"))
    return search.best_per_document(hits).select("document_id", "chunk_id", "score")


@query(f"WITH {DOCS} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(regexp_replace(title, '\\s+', '', 'g')) ORDER BY length(body) DESC, id) AS rn FROM docs WHERE title <> '') WHERE rn = 1")
def title_dedupe(spark, sf):
    hits = documents(spark, sf).filter("title <> ''").select(F.col("id").alias("document_id"), "title", F.lit("").alias("snippet"), F.length("body").alias("score"), F.lit(0).alias("channel"), F.lit(0).alias("place"))
    return search.title_dedupe(hits).select(F.col("document_id").alias("id"))


@query(f"WITH {DOCS} SELECT id FROM docs WHERE NOT contains(title || ' ' || source || ' ' || category, 'src1') AND NOT contains(title || ' ' || source || ' ' || category, 'tion')")
def exclude_filter(spark, sf):
    return search.exclude(documents(spark, sf).withColumn("snippet", F.lit("")), ["src1", "tion"]).select("id")


ORDER_DAY = "CAST(o_orderdate AS DATE)"


@query(f"SELECT o_orderkey, round({RECENCY.format(d=ORDER_DAY, a=chr(68) + 'ATE ' + chr(39) + '1998-08-02' + chr(39))}, 6) AS bonus FROM orders")
def recency_bonus(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(dates.recency_bonus(F.col("o_orderdate").cast("date"), date(1998, 8, 2)), 6).alias("bonus"))


@query(f"SELECT o_orderkey, CASE WHEN d < 0 THEN -1.2 WHEN d <= 14 THEN 1.0 WHEN d <= 45 THEN 0.4 ELSE 0.0 END::DOUBLE AS bonus FROM (SELECT o_orderkey, date_diff('day', DATE '1995-06-17', {ORDER_DAY}) AS d FROM orders)")
def deadline_bonus(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.deadline_bonus(F.col("o_orderdate").cast("date"), date(1995, 6, 17)).alias("bonus"))


@query(f"""WITH r AS (SELECT o_orderkey, {ORDER_DAY} AS day, date_diff('day', {ORDER_DAY}, DATE '1998-08-02') AS age, {RECENCY.format(d=ORDER_DAY, a="DATE '1998-08-02'")} AS rec FROM orders)
SELECT o_orderkey, round(CASE WHEN age <= 730 THEN 2.4 + rec * 1.8 ELSE rec * 0.6 END + CASE WHEN age > 1460 THEN -8.0 WHEN age > 730 THEN -3.5 ELSE 0 END, 6)::DOUBLE AS current_score,
  round(CASE WHEN age <= 730 THEN 1.6 + rec ELSE 0 END + CASE WHEN age > 1460 THEN -8.0 WHEN age > 730 THEN -3.5 ELSE 0 END, 6)::DOUBLE AS recent_score,
  CASE WHEN year(day) = 1997 THEN 1.2 ELSE 0.0 END::DOUBLE AS year_score, round(-rec, 6) + 0.0 AS historical_score FROM r""")
def time_scope(spark, sf):
    orders = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    scored = {"current_score": "current", "recent_score": "recent_2y", "year_score": "1997", "historical_score": "historical"}
    return orders.select("o_orderkey", *((F.round(dates.scope_score(F.col("day"), F.lit(""), s, date(1998, 8, 2)), 6) + 0.0).alias(n) for n, s in scored.items()))


PLAN = QueryPlan("tion of the", "deadline_query", retrieval_keywords=["blehe", "thand"], entities={"topic": "thing"}, filters={"student_type": "en"}, time_scope="current", authority_preference="src1")


def _contains_sum(hay: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({hay}, '{t}') AS INTEGER)" for t in terms) + ")"


SPECIFIC, COVERAGE = ["tionofthe", "blehe", "thand", "thing", "en"], ["blehe", "thand", "thing", "en"]
META = "source || ' ' || category || '   '"
ONLY = lambda terms: "(" + " + ".join(f"CAST(contains(m, '{t}') AND NOT contains(title, '{t}') AND NOT contains(body, '{t}') AS INTEGER)" for t in terms) + ")"


@query(f"""WITH {DOCS}, x AS (SELECT *, {META} AS m, {RECENCY.format(d="publish_date", a="DATE '2024-02-01'")} AS rec, date_diff('day', publish_date, DATE '2024-02-01') AS age, date_diff('day', DATE '2024-02-01', deadline) AS left_days FROM docs),
y AS (SELECT *, {_contains_sum("title", SPECIFIC)} AS st, {_contains_sum("body", SPECIFIC)} AS sb, {ONLY(SPECIFIC)} AS sm,
  {_contains_sum("title", COVERAGE)} AS ct, {_contains_sum("body", COVERAGE)} AS cb, {ONLY(COVERAGE)} AS cm,
  ({" + ".join(f"CAST(contains(title, '{t}') OR contains(body, '{t}') OR contains(m, '{t}') AS INTEGER)" for t in COVERAGE)}) AS cc FROM x)
SELECT id, round(CAST(1.0 + CASE WHEN contains(title, 'tion of the') THEN 5 ELSE 0 END + least(5.0, st * 1.8) + least(2.4, sb * 0.6) + least(1.2, sm * 0.35)
  + CASE WHEN st = 0 AND sb = 0 THEN -1.5 ELSE 0 END + least(4.5, ct * 1.3 + cb * 0.9 + cm * 0.35) + CASE WHEN cc >= 2 THEN least(3.2, (cc - 1) * 1.1) ELSE -1.8 END
  + CASE WHEN contains(title, 'tion of the') THEN 2.0 ELSE 0 END + CASE WHEN contains(title, 'blehe') THEN 2.0 ELSE 0 END + CASE WHEN contains(title, 'thand') THEN 2.0 ELSE 0 END
  + CASE WHEN contains(title, 'thing') THEN 3.0 WHEN contains(body, 'thing') THEN 1.2 WHEN contains(m, 'thing') THEN 0.5 ELSE -2.5 END
  + CASE WHEN regexp_matches(title || '   ' || ' ' || body, '(phone|telephone|contact|e-mail)') THEN -3.0 ELSE 0 END
  + CASE WHEN contains(source, 'src1') THEN 2.2 ELSE 0 END + rec
  + CASE WHEN left_days IS NULL THEN 0 WHEN left_days < 0 THEN -1.2 WHEN left_days <= 14 THEN 1.0 WHEN left_days <= 45 THEN 0.4 ELSE 0 END
  + CASE WHEN age <= 730 THEN 2.4 + rec * 1.8 ELSE rec * 0.6 END + CASE WHEN age > 1460 THEN -8.0 WHEN age > 730 THEN -3.5 ELSE 0 END
  + CASE WHEN category = 'en' THEN 1.5 ELSE -3.0 END AS DOUBLE), 4) AS score FROM y""")
def feature_score(spark, sf):
    hits = documents(spark, sf).withColumn("base", F.lit(1.0)).withColumn("snippet", F.lit(""))
    hits = hits.withColumn("chunk_text", F.col("body")).withColumn("chunk_kind", F.lit("body")).withColumn("heading", F.lit("")).withColumn("attachment_name", F.lit("")).withColumn("chunk_tags", F.array().cast("array<string>"))
    return hits.select("id", F.round(search.feature_score(PLAN, UserProfile(), AS_OF, LATIN), 4).alias("score"))


_INDEXES: dict[tuple[str, str], index.Index] = {}


def stored_index(spark, sf) -> index.Index:
    """The index of the documents, built once a session, as an ingest would; it goes when the session ends."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        docs = documents(spark, sf)
        _INDEXES[key] = index.build(docs, chunking.indexed(docs, LATIN, own=index.own()), fresh_folder(spark), LATIN)
    return _INDEXES[key]


@query()
def index_build(spark, sf):
    return stored_index(spark, sf).corpus().withColumn("average", F.round("average", 6))


@query()
def search_hits(spark, sf):
    docs, stored = documents(spark, sf), stored_index(spark, sf)
    plan = QueryPlan("license of the", retrieval_keywords=["license", "tion"], expanded_queries=["the blehe"], time_scope="current")
    return search.search(docs, stored.chunks(), plan, AS_OF, limit=24, pack=LATIN, index=stored).select("rank", "document_id", "chunk_id", "score", "note")


@query("SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND (contains(n_name, 'NATION_1') OR contains('NATION_1', n_name))")
def audience_match(spark, sf):
    customers = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.filter(search.audience_match(F.array("n_name"), "NATION_1")).select("c_custkey", "n_name")


@query("""SELECT r_regionkey AS id, r_name AS slug, count(DISTINCT n_nationkey) AS n_sources, count(DISTINCT c_custkey) AS n_documents, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS latest
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def collection_rollup(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    latest = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.col("o_orderdate").cast("date")).alias("publish_date"))
    docs = customer.select(F.col("c_custkey").alias("id")).join(latest, "id", "left")
    members = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("collection_id"), F.col("c_custkey").alias("document_id"))
    out = quality.collection_rollup(table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("slug")), nation.select(F.col("n_regionkey").alias("collection_id"), F.col("n_nationkey").alias("id")), members, docs, "ASIA")
    return out.withColumn("latest", F.col("latest").cast("string"))


@query("SELECT source, kind, authority_weight FROM (VALUES ('src0', 'office', 3.0::DOUBLE)) v(source, kind, authority_weight) UNION ALL SELECT DISTINCT source, CASE WHEN contains(source, '1') THEN 'college' ELSE 'other' END, CASE WHEN contains(source, '1') THEN 2.2 ELSE 1.0 END::DOUBLE FROM documents WHERE source <> 'src0'")
def authority_profiles(spark, sf):
    from dataclasses import replace

    known = spark.createDataFrame([("src0", "office", 3.0)], "source string, kind string, authority_weight double")
    return enrich.authority_profiles(table(spark, sf, "documents"), known, replace(LATIN, college_word="1"))


JUDGED = "SELECT d.source, d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS local_rank, CASE WHEN quality = 1 AND toxic = 0 THEN 4 WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 0 END AS prio, (d.doc_id % 97) / 96.0 AS ai FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(f"SELECT source, id, CAST(row_number() OVER (PARTITION BY source ORDER BY prio DESC NULLS LAST, CASE WHEN prio IS NOT NULL THEN ai END DESC NULLS LAST, CASE WHEN prio IS NOT NULL THEN -score END NULLS FIRST, local_rank) AS INTEGER) AS new_rank FROM ({JUDGED})")
def rerank_apply(spark, sf):
    docs = table(spark, sf, "documents")
    local = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    hits = docs.select("source", F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), local.alias("local_rank"))
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "strong").when(F.col("quality") == 1, "weak").otherwise("wrong_topic")
    judged = table(spark, sf, "labels").join(docs.select("doc_id", "source"), "doc_id").select("source", F.col("doc_id").alias("id"), label.alias("label"), ((F.col("doc_id") % 97) / 96.0).alias("ai_score"), F.lit(0).alias("seq"))
    return judging.apply_rerank(hits, judged, "source").select("source", "id", "new_rank")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, lower(regexp_replace(text, '\\s+', '', 'g')) ORDER BY turn) AS rn FROM conversations) WHERE rn = 1""")
def fact_dedupe(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("_q", F.lower(text.compact(F.col("text"))))
    return judging.first_per(turns, ["conv_id", "role", "_q"], ["turn"]).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS rn, sum(length(text)) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE rn = 1 OR total <= 600")
def budget_pack(spark, sf):
    return judging.within_budget(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], "text", 600).select("conv_id", "turn")


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS k FROM conversations) WHERE k <= CASE WHEN role = 'user' THEN 2 ELSE 4 END) WHERE place <= 4""")
def quota_pack(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("n", F.length("text"))
    return judging.with_quota(rows, ["conv_id"], "role", [F.desc("n"), F.col("turn")], 4, {"user": 2}).select("conv_id", "turn")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(trim(text)), '^(it|this|that|the|of)\\b') AND prev IS NOT NULL THEN prev || ' ' || text ELSE text END AS context FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)")
def session_context(spark, sf):
    return tasks.contextual(table(spark, sf, "conversations"), "conv_id", "turn", "text", r"^(it|this|that|the|of)\b").select("conv_id", "turn", "context")


@query("SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages WHERE regexp_matches(url, '^https?://[^/]+')")
def url_normalise(spark, sf):
    parts = enrich.url_parts(F.col("url"))
    return table(spark, sf, "pages").select("page_id", enrich.normalised_url(F.col("url")).alias("u"), *(c.alias(n) for n, c in parts.items())).filter("u is not null").withColumnRenamed("u", "url")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE year(CAST(o_orderdate AS DATE)) >= 2000")
def url_date(spark, sf):
    day = F.col("o_orderdate").cast("date")
    url = F.concat(F.lit("https://example.org/"), F.date_format(day, "yyyy/MMdd"), F.lit("/c.htm"))
    return table(spark, sf, "orders").select("o_orderkey", dates.from_url(url).cast("string").alias("day")).filter("day is not null")


@query()
def page_parse(spark, sf):
    read = web.parsed(table(spark, sf, "pages"), LATIN)
    return read.select("page_id", "title", "body", F.size("links").alias("n_links"), F.size("attachments").alias("n_attachments"), "kind")


@query()
def page_links(spark, sf):
    links = web.parsed(table(spark, sf, "pages"), LATIN).select("page_id", F.explode("links").alias("link"))
    return web.allowed_links(links, "link", [], ["/admin"])


@query("SELECT user_id AS task_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def task_latest(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "ts", "event_id", F.col("event_type").alias("status"))
    return tasks.latest_state(events, "task_id", "ts", "event_id").select("task_id", "status", "event_id")


@query("SELECT user_id AS task_id, count(*) AS n_events, count(*) FILTER (WHERE event_type <> 'error') AS n_done, count(*) FILTER (WHERE event_type = 'error') AS n_failed, round(CASE WHEN count(*) FILTER (WHERE event_type <> 'error') = count(*) THEN 1.0 ELSE least(0.95, count(*) FILTER (WHERE event_type <> 'error') / count(*)) END, 6)::DOUBLE AS share FROM events GROUP BY user_id")
def task_progress(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "task_id")
    return tasks.progress(events, "task_id", F.col("event_type") != "error", F.col("event_type") == "error").withColumn("share", F.round("share", 6))


@query("SELECT count(*) AS n, min(n_chars) AS least, CAST(floor(median(n_chars)) AS BIGINT) AS median, round(avg(n_chars), 6) AS mean, CAST(quantile_disc(n_chars, 0.95) AS DOUBLE) AS p95, max(n_chars) AS greatest FROM documents")
def percentiles(spark, sf):
    out = quality.distribution(table(spark, sf, "documents"), F.col("n_chars"))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("p95", F.col("p95").cast("double"))


@query("SELECT word AS value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, value LIMIT 20")
def top_counters(spark, sf):
    return quality.top_values(table(spark, sf, "documents"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))))


@query(f"WITH {DOCS} SELECT count(*) AS n, count(*) FILTER (WHERE publish_date IS NULL) AS missing, count(*) FILTER (WHERE date_diff('day', publish_date, DATE '2024-02-01') < 0) AS future, count(*) FILTER (WHERE date_diff('day', publish_date, DATE '2024-02-01') > 730) AS over_2y, count(*) FILTER (WHERE date_diff('day', publish_date, DATE '2024-02-01') > 1460) AS over_4y, CAST(0 AS BIGINT) AS url_mismatch FROM docs")
def date_quality(spark, sf):
    return quality.date_quality(documents(spark, sf), AS_OF)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c < 120) AS short, count(*) FILTER (WHERE c < 40) AS very_short, count(*) FILTER (WHERE n_all >= 120 AND b >= 3) AS boilerplate FROM (SELECT length(regexp_replace(text, '\\s+', '', 'g')) AS c, length(text) AS n_all, " + " + ".join(f"CAST(contains(text, '{t}') AS INTEGER)" for t in LATIN.boilerplate_terms) + " AS b FROM documents)")
def text_quality(spark, sf):
    docs = documents(spark, sf)
    return quality.text_quality(docs, text.boilerplate_score(F.col("body"), LATIN))


EVAL = "SELECT item_id AS id, CASE WHEN item_id % 7 = 0 THEN 'unknown' ELSE 'answer_question' END AS expected_intent, CASE WHEN item_id % 5 = 0 THEN 'unknown' ELSE 'answer_question' END AS intent, CASE WHEN item_id % 5 = 0 THEN 0 ELSE 3 END AS n_hits, contains(text, 'tion') AS terms_ok, contains(text, 'e') AS top_terms_ok, NOT contains(text, 'zz') AS clean, item_id % 3 <> 0 AS fresh FROM benchmark"


@query(f"SELECT expected_intent, count(*) AS n, count(*) FILTER (WHERE ok) AS n_passed, round(count(*) FILTER (WHERE ok) / count(*), 6) AS pass_rate FROM (SELECT *, CASE WHEN expected_intent = 'unknown' THEN intent = expected_intent AND n_hits = 0 ELSE intent = expected_intent AND n_hits > 0 AND terms_ok AND top_terms_ok AND clean AND fresh END AS ok FROM ({EVAL})) GROUP BY expected_intent")
def eval_summary(spark, sf):
    rows = table(spark, sf, "benchmark")
    listed = lambda *t: F.array(*map(F.lit, t))
    cases = rows.select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 7 == 0, "unknown").otherwise("answer_question").alias("expected_intent"), listed("tion").alias("expected_terms"), listed("zz").alias("forbidden_terms"), listed("e").alias("expected_top_terms"), F.when(F.col("item_id") % 3 == 0, 10).otherwise(1000).alias("max_top_age_days"))
    results = rows.select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 5 == 0, "unknown").otherwise("answer_question").alias("intent"), F.when(F.col("item_id") % 5 == 0, 0).otherwise(3).alias("n_hits"), F.col("text").alias("hit_text"), F.col("text").alias("top_text"), F.lit(date(2024, 1, 1)).alias("top_date"))
    return quality.eval_summary(quality.eval_checks(cases, results, AS_OF)).withColumn("pass_rate", F.round("pass_rate", 6))


@query("""WITH old AS (SELECT doc_id AS id, 'u' || (doc_id // 2) AS url, text AS body, source AS ai_metadata FROM documents WHERE doc_id % 2 = 0),
batch AS (SELECT doc_id AS seq, 'u' || (doc_id % 700) AS url, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'new ' || doc_id END AS body FROM documents WHERE doc_id % 2 = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS rn FROM batch) WHERE rn = 1)
SELECT coalesce(o.url, n.url) AS url, o.id IS NOT NULL AS was_there, sha256(coalesce(n.body, o.body)) AS content_hash, CASE WHEN o.id IS NULL THEN NULL WHEN n.url IS NULL OR sha256(n.body) = sha256(o.body) THEN o.ai_metadata END AS ai_metadata,
  CASE WHEN o.id IS NOT NULL THEN o.id ELSE NULL END AS old_id FROM old o FULL JOIN n ON o.url = n.url""")
def upsert_merge(spark, sf):
    docs = table(spark, sf, "documents")
    old = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.expr("doc_id div 2")).alias("url"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.col("source").alias("ai_metadata"))
    body = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("new "), F.col("doc_id")))
    batch = docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("seq"), F.concat(F.lit("u"), F.col("doc_id") % 700).alias("url"), F.sha2(F.encode(body, "UTF-8"), 256).alias("content_hash"), F.lit(None).cast("string").alias("ai_metadata"))
    merged = store.upsert(old, batch)
    top = old.agg(F.max("id")).first()[0]
    there = F.col("id") <= top
    return merged.select("url", there.alias("was_there"), "content_hash", "ai_metadata", F.when(there, F.col("id")).alias("old_id"))


@query("SELECT collection_id, document_id FROM (SELECT CAST(doc_id % 3 AS BIGINT) AS collection_id, doc_id AS document_id FROM documents) WHERE collection_id <> 1 UNION ALL SELECT CAST(1 AS BIGINT), doc_id FROM labels")
def membership_replace(spark, sf):
    members = table(spark, sf, "documents").select((F.col("doc_id") % 3).alias("collection_id"), F.col("doc_id").alias("document_id"))
    return store.replace_members(members, 1, table(spark, sf, "labels").select("doc_id"))


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, CAST(-1 AS INTEGER) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_absent(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return store.insert_absent(table(spark, sf, "labels").select("doc_id", "quality"), rows, ["doc_id"])


@query("SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE d.source <> 'src0'")
def delete_cascade(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    gone = docs.filter("source = 'src0'").select("source").distinct()
    left = store.delete_by_keys(gone, docs, "source", "doc_id", {"labels": (labels, "doc_id")})
    return left["labels"].select("doc_id")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % 101 AS dst FROM supplier UNION SELECT s_suppkey, (s_suppkey * 3 + 1) % 101 FROM supplier),
r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 6)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def crawl_reachability(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("src"))
    edges = s.select("src", ((F.col("src") * 7 + 3) % 101).alias("dst")).union(s.select("src", ((F.col("src") * 3 + 1) % 101).alias("dst")))
    return web.reachable(edges, spark.range(1, 2).toDF("node"), 6)


@query("SELECT CAST(time_bucket(INTERVAL 1 hour, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tasks.windowed_counts(events, "ts", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT site, count(*) AS n_pages, count(*) FILTER (WHERE outcome = 'saved') AS n_saved, count(*) FILTER (WHERE outcome = 'error') AS n_errors, count(*) FILTER (WHERE outcome = 'skipped') AS n_skipped
FROM (SELECT user_id AS site, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'skipped' ELSE 'saved' END AS outcome FROM events) GROUP BY site""")
def crawl_report(spark, sf):
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "skipped").otherwise("saved")
    log = table(spark, sf, "events").select(F.col("user_id").alias("site"), F.col("event_id").cast("string").alias("url"), outcome.alias("outcome"), F.col("event_id").alias("seq"))
    return web.crawl_report(log).drop("errors", "skipped")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a plan over the documents through full text, term matching, scoring, de-duplication and top-k."""
    return search_hits(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_evidence, catalogue_fields, catalogue_rules  # noqa: F401  these register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
