import math
import sqlite3
from datetime import date

from pyspark.sql import functions as F

from sievelight.operators import chunking, fulltext, index, judging, quality, search, store
from sievelight.plans.query_plan import QueryPlan, UserProfile

AS_OF = date(2024, 2, 1)
DOC = "id long, url string, title string, body string, source string, category string, publish_date date, deadline date, topics array<string>, keywords array<string>, attachments array<struct<name:string,url:string,text:string,pages:array<struct<page:int,text:string>>>>, applicable_colleges array<string>, applicable_grades array<string>, student_types array<string>"


def docs(spark, *rows):
    full = [(i, f"https://x/{i}", t, b, "教务处", "c", date(2024, 1, i % 27 + 1), None, [], [], [], [], [], ["本科生"]) for i, (t, b) in enumerate(rows, 1)]
    return spark.createDataFrame(full, DOC)


def test_bm25_equals_sqlite(spark):
    rows = [("red apple", "an apple a day"), ("pear", "green pear and apple pie"), ("none", "nothing here at all"), ("apple", "apple apple apple tree")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, body, tokenize='unicode61')")
    con.executemany("insert into t(rowid, title, body) values (?, ?, ?)", [(i, *r) for i, r in enumerate(rows, 1)])
    want = dict(con.execute("select rowid, bm25(t, 4.0, 1.0) from t where t match '\"apple\" OR \"pear\"'").fetchall())
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "id long, title string, body string")
    weights = {"title": 4.0, "body": 1.0}
    phrases = fulltext.queries_frame(spark, {0: "apple pear"})
    got = {r["id"]: r["rank"] for r in fulltext.bm25(fulltext.postings(df, "id", list(weights)), fulltext.lengths(df, "id", list(weights)), phrases, "id", weights).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_phrases_match_in_a_row_only(spark):
    df = spark.createDataFrame([(1, "big_house here"), (2, "house big")], "id long, body string")
    phrases = fulltext.queries_frame(spark, {0: "big_house"})
    found = fulltext.phrase_counts(fulltext.postings(df, "id", ["body"]), phrases, "id").collect()
    assert [r["id"] for r in found] == [1]


def test_title_beats_body_and_copies_are_one(spark):
    d = docs(spark, ("转专业通知", "今年转专业安排如下，请查看。"), ("其他通知", "这里提到转专业一次，其余无关。"), ("转专业 通知", "今年转专业安排如下，请查看。"), ("食堂", "菜单"))
    plan = QueryPlan("转专业", retrieval_keywords=["转专业"])
    hits = search.search(d, chunking.indexed(d), plan, AS_OF, UserProfile(student_type="本科生")).collect()
    assert [h["title"].replace(" ", "") for h in hits][:2] == ["转专业通知", "其他通知"] and len(hits) == 2
    assert hits[0]["score"] > hits[1]["score"] and "标题包含" in hits[0]["note"]
    none = search.search(d, chunking.indexed(d), QueryPlan("转专业", exclude_terms=["其他"]), AS_OF).collect()
    assert all("其他" not in h["title"] for h in none)


def test_like_wildcards_and_case(spark):
    d = docs(spark, ("Alpha 100", "x"), ("beta", "ALPHA"), ("a_b", "y"))
    hits = search.like_channel(d, ["alpha", "a%b"], ["title", "body"], 1, 2.0, 0.8).collect()
    assert sorted((h["document_id"], h["base"]) for h in hits) == [(1, 0.8), (2, 0.8), (3, 0.8)]


def test_vector_channel(spark):
    d = docs(spark, ("a", "b"), ("c", "d"))
    chunks = spark.createDataFrame([(1, 1, "x", "body", [1.0, 0.0]), (2, 2, "y", "attachment_table_row", [0.6, 0.8]), (3, 2, "z", "body", None)], "chunk_id long, document_id long, chunk_text string, chunk_kind string, embedding array<double>")
    hits = {h["chunk_id"]: h["base"] for h in search.vector_channel(d, chunks, [0.6, 0.8]).collect()}
    assert math.isclose(hits[2], 4.15) and math.isclose(hits[1], 2.4)


def test_upsert_keeps_ids_and_metadata(spark):
    ddl = "id long, url string, body string, content_hash string, ai_metadata string"
    old = spark.createDataFrame([(1, "a", "x", "h1", "m1"), (2, "b", "y", "h2", "m2")], ddl)
    batch = spark.createDataFrame([(0, "a", "x", "h1", None), (1, "b", "z", "h0", None), (2, "b", "w", "h3", None), (3, "c", "n", "h4", None)], "seq long, url string, body string, content_hash string, ai_metadata string")
    out = {r["url"]: r for r in store.upsert(old, batch).collect()}
    assert (out["a"]["id"], out["a"]["ai_metadata"]) == (1, "m1")
    assert (out["b"]["id"], out["b"]["body"], out["b"]["ai_metadata"]) == (2, "w", None)
    assert out["c"]["id"] == 3
    again = store.upsert(store.upsert(old, batch), batch)
    assert sorted(again.collect()) == sorted(store.upsert(old, batch).collect())


def test_snapshots(spark, tmp_path):
    tables = store.Snapshots(spark, f"file://{tmp_path}")
    assert tables.write("t", spark.range(3)) == 1 and tables.write("t", spark.range(5)) == 2
    assert tables.read("t").count() == 5


def test_slugs(spark):
    have = spark.createDataFrame([("news",), ("news-3",)], "slug string")
    want = spark.createDataFrame([("News",), ("Other",)], "name string")
    assert {r["name"]: r["slug"] for r in store.unique_slug(have, want).collect()} == {"News": "news-4", "Other": "other"}


def test_reranking(spark):
    hits = spark.createDataFrame([(1, 5.0, 1), (2, 4.0, 2), (3, 3.0, 3)], "id long, score double, local_rank int")
    judged = spark.createDataFrame([(3, "strong", 90.0, 0), (3, "weak", 0.1, 1), (1, "wrong_topic", 0.9, 2), (9, "strong", 1.0, 3)], "id long, label string, ai_score double, seq int")
    assert [r["id"] for r in judging.apply_rerank(hits, judged).orderBy("new_rank").collect()] == [3, 1, 2]
    verdicts = spark.createDataFrame([(2, "direct", 0.9, True, 0), (1, "direct", 0.9, False, 1)], "id long, label string, confidence double, keep boolean, seq int")
    out = judging.apply_judgements(hits, verdicts, 2).orderBy("new_rank").collect()
    assert [r["id"] for r in out] == [2, 1, 3] and [r["accepted"] for r in out] == [True, True, False]


def test_budget_keeps_the_first_and_stops_at_the_overflow(spark):
    df = spark.createDataFrame([(1, 0, "x" * 50), (1, 1, "y"), (2, 0, "a"), (2, 1, "b" * 20), (2, 2, "c")], "g int, n int, t string")
    out = judging.within_budget(df, ["g"], [F.col("n")], "t", 10).collect()
    assert sorted((r["g"], r["n"]) for r in out) == [(1, 0), (2, 0)]


def test_urls_in_answers(spark):
    answers = spark.createDataFrame([(1, "see https://a/x and https://evil/y.")], "id long, answer string")
    hits = spark.createDataFrame([(1, "https://a/x", [])], "id long, url string, attachments array<struct<name:string,url:string>>")
    assert judging.allowed_urls(answers, hits).first()["answer"].startswith("see https://a/x and ")
    assert "evil" not in judging.allowed_urls(answers, hits).first()["answer"]


def test_stats(spark):
    d = docs(spark, ("title", ""), ("", "body"))
    row = quality.index_stats(d, chunking.chunk_documents(d)).first()
    assert (row["documents"], row["chunks"], row["attachments"]) == (2, 2, 0)
    assert quality.verdict(0.01, 0.9, 0.5, 0.3) == (75, ["topics"])


def test_index_has_all_postings_and_deals_out_no_texts(spark, tmp_path):
    d = docs(spark, ("Red apple", "an apple a day\nkeeps the doctor away"), ("pear", "green pear and apple_pie " * 400), ("", ""))
    chunks = chunking.indexed(d)
    built = index.build(d, chunking.indexed(d, own=index.own()), f"file://{tmp_path}/a")
    fields = list(fulltext.CHUNK_WEIGHTS)
    full = chunks.join(d.select(F.col("id").alias("document_id"), "title", "source", F.array_join("topics", " ").alias("topics")), "document_id")
    want = fulltext.postings(full, "chunk_id", fields)
    told = lambda rows: sorted((r["chunk_id"], r["field"], r["term"], r["tf"], tuple(r["positions"])) for r in rows.collect())
    terms = [r["term"] for r in want.select("term").distinct().collect()]
    assert told(built.postings(terms)) == told(want)
    assert sorted(built.lengths().collect()) == sorted(fulltext.lengths(full, "chunk_id", fields).collect())
    assert built.chunks().columns == chunks.columns
    assert told(index.build(d, chunks, f"file://{tmp_path}/b").postings(terms)) == told(want)
    assert "Exchange" not in chunking.indexed(d, own=index.own())._jdf.queryExecution().executedPlan().toString()
    again = index.refreshed(built, d, d.select("id").limit(1), f"file://{tmp_path}/c", chunking.indexed)
    assert told(again.postings(terms)) == told(want)


def test_phrases_of_one_term_need_no_positions(spark):
    df = spark.createDataFrame([(1, "red apple apple", "red"), (2, "green pear", "apple"), (3, "none", "")], "id long, title string, body string")
    weights = {"title": 4.0, "body": 1.0}
    phrases = fulltext.queries_frame(spark, {0: "apple pear", 1: "apple", 2: "red none"})
    ranks = [fulltext.bm25(made(df, "id", list(weights), phrases), fulltext.lengths(df, "id", list(weights)), phrases, "id", weights) for made in (fulltext.postings, fulltext.term_counts)]
    told = [sorted((r["query_id"], r["id"], round(r["rank"], 9)) for r in x.collect()) for x in ranks]
    assert told[0] == told[1] and [x[:2] for x in told[0]] == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 3)]
