"""Registered queries of the planner's rules, over a table of queries made from document numbers, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import query, table
from .functions.text import texts
from .plans import rules

#: Two halves of each query string, chosen by the document's number.
SUBJECTS = ["转专业", "2023级计算机学院本科生", "研究生成绩单", "大三上", "毕业资格", "2024年寒假", "23届保研", "天气", "清华大学", "最新通知", "四六级报名", "校历", "不要教务处，学校通知", "博士二缓考", "历年奖学金", "近两年选课", "土木和交通学院", "不要给我项目报名", "2022级2021年补考", "CET"]
ASKS = ["什么时候截止", "怎么申请", "需要什么材料", "有什么不同", "原文链接", "现在还能报名吗", "符合条件吗", "有什么重要事项", "入口在哪", "不要给我竞赛、讲座的通知", "", "逾期怎么办", "附件下载", "别看研究生院相关的公告", "名单", "hello ABC_1"]
INTENTS = ["answer_question", "unknown", "find_document", "attachment_query", "deadline_query", "process_guide", "eligibility_query", "profile_query", "latest_updates"]
IDENTITIES = ["", "大二学生", "研一 电子学院", "2022 级硕士", "留学生"]


def _sql(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


QS = f"""qs AS (SELECT doc_id AS id, {_sql(SUBJECTS)}[1 + doc_id % {len(SUBJECTS)}] || {_sql(ASKS)}[1 + (doc_id // {len(SUBJECTS)}) % {len(ASKS)}] AS q,
  {_sql(INTENTS)}[1 + doc_id % {len(INTENTS)}] AS intent, {_sql(IDENTITIES)}[1 + doc_id % {len(IDENTITIES)}] AS identity FROM documents)"""


def queries_table(spark, sf):
    pick = lambda values, at: F.get(texts(values), (at % len(values)).cast("int"))
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(n.alias("id"), F.concat(pick(SUBJECTS, n), pick(ASKS, F.floor(n / len(SUBJECTS)))).alias("q"), pick(INTENTS, n).alias("intent"), pick(IDENTITIES, n).alias("identity"))


def _m(pattern: str, of: str = "q") -> str:
    return f"regexp_matches({of}, '{pattern}')"


OFF = f"({_m(rules.OFF_TOPIC)} OR {_m(rules.OTHER_SCHOOL)})"
LOOKUP = f"({_m(rules.DOCUMENT_LOOKUP)} OR ({_m('(通知|公告|文件)')} AND NOT {_m(rules.CONTENT_QUESTION)}))"
OVER = f"""CASE WHEN {OFF} THEN 'unknown' WHEN {_m(rules.LATEST)} THEN CASE WHEN {_m(rules.LATEST_PROFILE)} THEN 'profile_query' ELSE 'latest_updates' END
  WHEN {_m(rules.COMPARISON)} THEN 'answer_question' WHEN {LOOKUP} AND NOT {_m(rules.CONTENT_QUESTION)} THEN 'find_document' WHEN {_m(rules.PROFILE_STAGE)} AND {_m(rules.PROFILE_NEED)} THEN 'profile_query' ELSE intent END"""
SAFE = f"""CASE WHEN ({OVER}) = 'unknown' AND intent = 'unknown' AND {_m(rules.SCHOOL_SEARCH)} AND NOT {OFF} THEN CASE WHEN {_m(rules.LATEST)} THEN 'latest_updates' WHEN {_m(rules.ELIGIBILITY)} THEN 'eligibility_query'
  WHEN {_m(rules.PROCESS)} THEN 'process_guide' WHEN {_m(rules.TIME_QUESTION)} OR {_m(rules.AVAILABILITY)} THEN 'deadline_query' WHEN {LOOKUP} THEN 'find_document' ELSE 'answer_question' END ELSE ({OVER}) END"""


@query(f"WITH {QS} SELECT id, {OVER} AS intent FROM qs")
def intent_override(spark, sf):
    return queries_table(spark, sf).select("id", rules.intent_override(F.col("q"), F.col("intent")).alias("intent"))


@query(f"""WITH {QS}, s AS (SELECT *, {SAFE} AS safe FROM qs)
SELECT id, safe AS intent, CASE WHEN safe IN ('unknown', 'latest_updates') THEN false WHEN {_m(rules.CONTENT_QUESTION)} OR {_m(rules.AVAILABILITY)} THEN true WHEN safe IN ('find_document', 'attachment_query') THEN false ELSE true END AS summary,
  CASE safe {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.PRESETS.items())} END AS preset FROM s""")
def safe_plan(spark, sf):
    rows = queries_table(spark, sf).withColumn("safe", rules.safe_intent(F.col("q"), F.col("intent")))
    return rows.select("id", F.col("safe").alias("intent"), rules.needs_summary(F.col("q"), F.col("safe"), F.lit(True)).alias("summary"), rules.preset(F.col("safe")).alias("preset"))


def _slot(names: list[str], pattern: str | None, intent: str | None) -> str:
    hit = " OR ".join(([_m(pattern)] if pattern else []) + ([f"intent = '{intent}'"] if intent else []))
    return f"SELECT id, {len(names)} AS n, unnest({_sql(names)}) AS slot, generate_subscripts({_sql(names)}, 1) AS k, {{}} AS rule FROM qs WHERE {hit}"


SLOT_ROWS = " UNION ALL ".join(_slot(*r).format(i) for i, r in enumerate(rules.SLOTS))


@query(f"""WITH {QS}, r AS ({SLOT_ROWS}), f AS (SELECT id, slot, min(rule * 10 + k) AS pl FROM r GROUP BY ALL), l AS (SELECT id, string_agg(slot, ',' ORDER BY pl) AS slots FROM f GROUP BY id)
SELECT id, coalesce(slots, CASE WHEN intent = 'answer_question' THEN '{",".join(rules.DEFAULT_SLOTS)}' ELSE '' END) AS slots FROM qs LEFT JOIN l USING (id)""")
def requested_slots(spark, sf):
    return queries_table(spark, sf).select("id", F.array_join(rules.slots(F.col("q"), F.col("intent")), ",").alias("slots"))


PHRASES = " UNION ALL ".join(f"SELECT id, 1000 + generate_subscripts({_sql(t)}, 1) + {i} * 100 AS pl, unnest({_sql(t)}) AS term FROM qs WHERE {_m(p)}" for i, (p, t) in enumerate(rules.PHRASE_EXCLUSIONS.items()))


@query(f"""WITH {QS}, m AS (SELECT id, unnest(regexp_extract_all(q, '{rules.NEGATIVE}', 1)) AS raw, generate_subscripts(regexp_extract_all(q, '{rules.NEGATIVE}', 1), 1) AS i FROM qs),
p AS (SELECT id, i, string_split_regex(trim(regexp_replace(raw, '(给我|相关|的|这个|这类)$', ''), ' ，,、'), '[、，,\\s]+') AS parts FROM m),
t AS (SELECT id, i * 50 + generate_subscripts(parts, 1) AS pl, trim(unnest(parts)) AS term FROM p UNION ALL {PHRASES}),
f AS (SELECT id, term, min(pl) AS pl FROM t WHERE pl >= 1000 OR (length(term) >= 2 AND term NOT IN ('通知', '公告', '信息', '结果')) GROUP BY ALL)
SELECT id, coalesce(terms, '') AS terms FROM qs LEFT JOIN (SELECT id, string_agg(term, '|' ORDER BY pl) AS terms FROM f GROUP BY id) USING (id)""")
def exclude_terms(spark, sf):
    return queries_table(spark, sf).select("id", F.array_join(rules.excluded(F.col("q")), "|").alias("terms"))


@query(f"""WITH {QS} SELECT id, CASE WHEN {_m("[0-9]{2} *届")} THEN '20' || regexp_extract(q, '([0-9]{{2}}) *届', 1) WHEN {_m("(今年|本年度|本学年|当前|现在|最新|最近)")} THEN 'current'
  WHEN len(list_filter(regexp_extract_all(q, '20[0-9]{{2}}级?'), lambda y: NOT suffix(y, '级'))) > 0 THEN list_filter(regexp_extract_all(q, '20[0-9]{{2}}级?'), lambda y: NOT suffix(y, '级'))[1][1:4]
  WHEN {_m("(近两年|两年内|最近两年)")} THEN 'recent_2y' WHEN {_m("(历史|往年|历年|以前)")} THEN 'historical' END AS scope FROM qs""")
def time_scopes(spark, sf):
    return queries_table(spark, sf).select("id", rules.time_scope(F.col("q")).alias("scope"))


def _college(of: str) -> str:
    plain = f"string_split(replace({of}, ' ', ''), '和')[-1]"
    return f"CASE WHEN coalesce({of}, '') = '' THEN NULL " + " ".join(f"WHEN {plain} = '{a}' THEN '{f}'" for a, f in rules.COLLEGE_ALIASES.items()) + f" ELSE {plain} END"


FIRST_COLLEGE = f"nullif(regexp_extract(q, '{rules.COLLEGE}', 1), '')"


@query(f"""WITH {QS} SELECT id, CASE WHEN {_m("不要教务处|别给我教务处")} THEN CASE WHEN {_m("(学校官网|学校通知|学校新闻|新闻|全校)")} THEN '学校官网' END WHEN {_m("不要学校官网|别给我学校官网")} THEN NULL WHEN contains(q, '教务处') THEN '教务处'
  WHEN contains(q, '研究生院') THEN '研究生院' WHEN {FIRST_COLLEGE} IS NOT NULL THEN {_college(FIRST_COLLEGE)} WHEN {_m("(学校官网|学校通知|全校)")} THEN '学校官网' END AS authority FROM qs""")
def authority_preference(spark, sf):
    return queries_table(spark, sf).select("id", rules.authority(F.col("q")).alias("authority"))


@query(f"""WITH {QS}, w AS (SELECT id, concat_ws(' ', nullif(trim(identity), ''), nullif(trim(q), '')) AS q, nullif(trim(identity), '') AS identity_text FROM qs),
g AS (SELECT *, replace(nullif(regexp_extract(q, '{rules.GRADE}', 1), ''), ' ', '') AS grade, replace(nullif(regexp_extract(q, '{rules.STUDENT_TYPE}', 1), ''), ' ', '') AS kind FROM w)
SELECT id, identity_text, {_college(FIRST_COLLEGE)} AS college, grade, coalesce(CASE WHEN kind IN ('硕士', '博士') THEN '研究生' ELSE kind END, CASE WHEN regexp_matches(grade, '^[研博]') THEN '研究生' WHEN starts_with(grade, '大') THEN '本科生' END) AS student_type FROM g""")
def profile_signals(spark, sf):
    rows = queries_table(spark, sf).withColumn("identity", F.concat_ws(" ", F.nullif("identity", F.lit("")), F.nullif("q", F.lit(""))))
    told = rules.profile_signals(F.col("identity"), F.lit(None).cast("string"), F.lit(""), F.lit(""))
    mine = queries_table(spark, sf).select("id", F.nullif(F.trim("identity"), F.lit("")).alias("identity_text"))
    return rows.select("id", told.alias("s")).select("id", "s.college", "s.grade", "s.student_type").join(mine, "id")


EXPANDED = " UNION ALL ".join(f"SELECT id, {i} * 100 + generate_subscripts({_sql(t)}, 1) AS pl, unnest({_sql(t)}) AS term FROM qs WHERE {_m(p)}" for i, (p, t) in enumerate(rules.EXPANSIONS.items(), 1))
TOKENS = "regexp_extract_all(q, '[A-Za-z0-9_]+|[一-鿿]{2,}')"


@query(f"""WITH {QS}, t AS (SELECT id, 0 AS pl, q AS term FROM qs UNION ALL SELECT id, 1, identity FROM qs UNION ALL {EXPANDED} UNION ALL SELECT id, 5000 + generate_subscripts({TOKENS}, 1), unnest({TOKENS}) FROM qs),
f AS (SELECT id, trim(term) AS term, min(pl) AS pl FROM t WHERE trim(term) <> '' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pl) AS rn FROM f)
SELECT id, string_agg(term, '|' ORDER BY pl) AS terms FROM n WHERE rn <= 24 GROUP BY id""")
def minimal_keywords(spark, sf):
    none = F.array().cast("array<string>")
    terms = rules.minimal_keywords(F.col("q"), none, F.array("identity"), none, F.array("q"))
    return queries_table(spark, sf).select("id", F.array_join(terms, "|").alias("terms"))


@query("SELECT intent, preset, section, CAST(pl AS INTEGER) AS place FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS intent, '{p}' AS preset, unnest({_sql(rules.SECTIONS[p])}) AS section, generate_subscripts({_sql(rules.SECTIONS[p])}, 1) - 1 AS pl" for i, p in rules.PRESETS.items()) + ")")
def output_presets(spark, sf):
    rows = spark.createDataFrame([(i,) for i in rules.PRESETS], "intent string").withColumn("preset", rules.preset(F.col("intent")))
    return rows.select("intent", "preset", F.posexplode(rules.sections(F.col("preset"))).alias("place", "section"))
