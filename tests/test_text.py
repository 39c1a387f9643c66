import hashlib
import math
from datetime import date

from pyspark.sql import functions as F

from sievelight.functions import dates, text, vectors
from sievelight.lexicon import CHINESE, LATIN
from sievelight.operators import chunking, enrich
from sievelight.operators import cleaning
from sievelight.plans import query_plan as plans


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_compact_and_counts(spark):
    assert one(spark, text.compact, "a　b\tc\n") == "abc"
    assert one(spark, text.token_count, "one two 中文字符") == 4
    assert one(spark, text.token_count, None) == 1


def test_segmentation_has_ngrams(spark):
    out = one(spark, text.segmented, "本科生转专业 CET 2024级").split(" ")
    assert "CET" in out and "2024级" in out and "转专业" in out and "本科" in out and "科生转" in out
    assert len(out) == len(set(out))


def test_synonyms_take_the_most_specific_key():
    assert text.expanded("CET4 报名")[1] == "四级" and "英语四六级" not in text.expanded("CET4 报名")
    assert text.expanded("天气") == ["天气"]
    assert "CET" in text.expanded("四六级")


def test_dates(spark):
    assert one(spark, dates.parsed, "发布 2024年3月5日") == date(2024, 3, 5)
    assert one(spark, dates.parsed, "2024-13-05 2024-01-01") is None
    assert one(spark, dates.from_url, "https://x.cn/2023/0918/c1.htm") == date(2023, 9, 18)
    assert one(spark, dates.from_url, "https://x.cn/a?p=/2023/0918/") is None


def test_hash_embedding_is_unit_length(spark):
    df = spark.createDataFrame([(1, "hello world hello"), (2, ""), (3, "转专业")], "id long, t string")
    out = {r["id"]: r["vector"] for r in vectors.hash_embeddings(df, "id", "t").collect()}
    assert abs(sum(x * x for x in out[1]) - 1) < 1e-4 and sum(map(abs, out[2])) == 0 and len(out[3]) == 128


def cleaned(spark, body, title=""):
    return spark.createDataFrame([(body, title)], "b string, t string").select(cleaning.clean_body(F.col("b"), F.col("t"))).first()[0]


def test_cleaning_drops_navigation_and_footer(spark):
    body = "首页\n部门简介\n领导分工\n教务科\n办事平台\n信息通知\n关于举办学术讲座的通知\n2024-03-01\n各位同学：\n讲座将在礼堂举行，欢迎大家参加并踊跃提问。\n版权所有 某大学\n尾部"
    out = cleaned(spark, body, "关于举办学术讲座的通知")
    assert out == "各位同学：\n讲座将在礼堂举行，欢迎大家参加并踊跃提问。"


def test_cleaning_joins_fragments(spark):
    assert cleaned(spark, "报名时间为2024年3\n月\n5\n日，请大家准时参加。") == "报名时间为2024年3月5日，请大家准时参加。"
    assert cleaned(spark, "first of\ntwo") == "first of two" and cleaned(spark, None) == "" and cleaned(spark, "") == ""
    assert cleaned(spark, "第一条内容完整。\n二、下一段") == "第一条内容完整。\n二、下一段"


def test_cleaning_drops_excerpts_frames_and_repeats(spark):
    assert cleaned(spark, "正文内容在这里，说明一件事情。\n附件正文摘录：\n别的") == "正文内容在这里，说明一件事情。"
    assert cleaned(spark, "首页\n联系电话 12345") == ""
    lines = ["导师风采 管理规定", "这一行是普通的正文内容，说明情况。", "导师风采 管理规定", "这一行是普通的正文内容，说明情况。"]
    flat = spark.createDataFrame([(lines,)], "l array<string>").select(cleaning.without_repeats(F.col("l"))).first()[0]
    assert flat == [lines[0], lines[1], lines[3]]


def test_chunks_cover_the_body_and_carry_the_end():
    body = "\n".join(f"line {i} " + "x" * 90 for i in range(40))
    parts = chunking.packed(body)
    assert len(parts) > 3 and all(len(t) <= 1800 for t, _ in parts)
    for line in body.split("\n"):
        assert any(line in t for t, _ in parts)
    assert parts[1][0].startswith(parts[0][0][-160:].strip()[:40])


def test_a_closing_heading_names_the_chunk_before_it():
    body = "a" * 880 + "\n申请流程\n" + "b" * 100
    assert chunking.packed(body)[0][1] == "申请流程"


def test_table_rows():
    rows = chunking.table_rows([["姓名", "学院"], ["张三", "软件"], ["", ""]], "名单")
    assert rows[0]["text"] == "名单；第2行；姓名：张三；学院：软件" and len(rows) == 1
    assert chunking.parts("t", "b", [{"name": "f", "text": "x|y\n1|2"}])[-2][3] == "attachment_table_row"


def test_keywords(spark):
    df = spark.createDataFrame([(1, "四六级 报名", "CET 考试 2024 通知")], "id long, title string, body string")
    out = {r["term"]: r["weight"] for r in enrich.keywords(df, "id", "title", "body").collect()}
    assert out["四六级"] > out["报名"] > 0 and "通知" not in out


def test_plan_terms():
    plan = plans.QueryPlan("转专业 时间", retrieval_keywords=["转专业", "2024"], entities={"topic": "转专业"})
    assert plans.query_strings(plan) == ["转专业 时间", "转专业", "2024"]
    assert plans.specific_terms(plan) == ["转专业时间", "转专业"]
    assert plans.time_scope("19届毕业") == "2019" and plans.time_scope("近两年政策") == "recent_2y" and plans.time_scope("2023级") is None
    assert plans.normalised({}, "四六级报名").retrieval_keywords[0] == "四六级报名"
    assert plans.is_generic("通知") and not plans.is_generic("转专业", CHINESE)


def test_index_text_is_whole(spark):
    long = " ".join(f"w{n}" for n in range(3000))
    assert one(spark, text.segmented, long).split(" ")[-1] == "w2999" and len(one(spark, text.segmented, long).split(" ")) == 3000
    for made in (chunking.parts("", long, []), chunking.parts("", "", [{"name": "f", "text": long}])[1:], chunking.parts("", "", [{"name": "f", "pages": [{"page": 1, "text": long}]}])[1:]):
        assert {w for p in made for w in p[0].split(" ")} >= set(long.split(" ")) and all(len(p[0]) <= chunking.LONGEST for p in made)
    none = F.array().cast("array<string>")
    row = spark.createDataFrame([(1, "t", long + " end", [])], "id long, title string, body string, attachments array<struct<name:string,url:string,text:string,pages:array<struct<page:int,text:string>>>>")
    row = row.select("*", F.lit("s").alias("source"), F.lit("c").alias("category"), F.lit(None).cast("date").alias("publish_date"), *(none.alias(c) for c in ("topics", "keywords", "applicable_colleges", "applicable_grades", "student_types")))
    row = row.withColumn("keywords", F.split(F.lit(long), " "))
    found = [r["search_text"] for r in chunking.indexed(row).collect()]
    assert all("w2999\n标签" in t for t in found) and any("end\n分词 " in t for t in found) and all(t.index("分词 ") < t.rindex(" w2999") for t in found)


def test_the_title_is_made_once_a_row(spark):
    lines = F.split("b", "\n")
    df = spark.createDataFrame([("Some long title\n2024-01-01\nSome long title\ntext", "Some  long title"), ("text", "")], "b string, t string")
    head = df.select(cleaning.below_head(lines, F.concat("t", F.lit(" "))).alias("l"))
    assert [r["l"] for r in head.collect()] == [["Some long title", "text"], ["text"]]
    for made in (head, df.select(cleaning.clean_body(F.col("b"), F.concat("t", F.lit(" ")))), df.select(cleaning.from_title(lines, F.concat("t", F.lit(" "))))):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("concat(t#") == 1


def test_keywords_and_hashes_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "Beta title", "alpha beta alpha gamma Beta 123 2024 é_x"), (2, None, None)], "id long, title string, t string")
    words = enrich.keywords(df, "id", "title", "t", LATIN)
    assert [(r["term"], r["weight"]) for r in words.orderBy("place").collect()] == [("Beta", 6), ("title", 3), ("alpha", 2), ("beta", 1), ("gamma", 1), ("2024", 1)]
    made = vectors.hash_embeddings(df, "id", "t")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (words, made)]
    assert all("Exchange" not in p and "BatchEvalPython" in p for p in plans)
    out = {r["id"]: r["vector"] for r in made.collect()}
    weights = {}
    for token, n in {"alpha": 2, "beta": 2, "gamma": 1, "123": 1, "2024": 1, "_x": 1}.items():
        digest = hashlib.sha256(token.encode()).hexdigest()
        i = int(digest[:8], 16) % 128
        weights[i] = weights.get(i, 0) + (1 if int(digest[8:10], 16) % 2 == 0 else -1) * math.log1p(n)
    norm = math.sqrt(sum(w * w for w in weights.values()))
    assert all(abs(x - weights.get(i, 0) / norm) < 1e-6 for i, x in enumerate(out[1])) and out[2] == [0.0] * 128


def test_few_navigation_terms_are_summed(spark):
    df = spark.createDataFrame([("Home About me",), ("",), (None,)], "l string")
    made = df.select(cleaning.nav_terms(F.col("l"), LATIN).alias("n"))
    assert [r["n"] for r in made.collect()] == [2, 0, 0] and "filter(" not in made._jdf.queryExecution().optimizedPlan().toString()
    body = "Home\nAbout\nContact\nLogin\nSitemap\nHome\nA title of the page\ntext"
    assert df.limit(1).select(cleaning.from_title(F.split(F.lit(body), "\n"), F.lit("A title of the page"), LATIN).alias("x")).first()["x"] == ["A title of the page", "text"]
