"""Planner rules over a table of queries, as column expressions: intents, slots, exclusions, scopes, audiences, expansions, presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import merged_terms, strings
from ..functions.text import found, texts
from ..lexicon import CHINESE, LanguagePack

# What a query is about, by pattern.
GRADE = r"(20\d{2}\s*级|大[一二三四五六]|研[一二三]|博士[一二三四五])"
STUDENT_TYPE = r"(本科生|研究生|硕士|博士|留学生|交换生)"
COLLEGE = r"([一-鿿]{2,20}(?:学院|书院|系))"
PROFILE_STAGE = r"(20\d{2}\s*级|大[一二三四五六](?:上|下|上学期|下学期)?|研[一二三](?:上|下)?|博士[一二三四五](?:上|下)?|本科生|研究生)"
PROFILE_NEED = r"(重要|事项|安排|有什么事|有什么事情|该看什么|要做什么|需要关注|关注什么|别错过|提醒)"
MATERIAL = r"(材料|证明|原件|复印件|申请表|附件|名单|表格|PDF|pdf|Word|word|Excel|excel)"
PROCESS = r"(怎么办|怎么申请|怎么打印|流程|步骤|材料|去哪里办|去哪办|如何|在哪|入口|系统在哪|办理|怎么报|咋报)"
ELIGIBILITY = r"(能不能|可不可以|可以.*吗|是否|符合|资格|条件|要求|大[一二三四].*能|研究生.*能|本科生.*能)"
ENTRY = r"(入口|系统|平台|网址|链接|在哪|在哪里|哪里|登录|信息门户|办事大厅|下载专区)"
EXCEPTION = r"(特殊|突发|紧急|例外|逾期|补办|报备|告知|无效|不得|不能|不予|取消|未提前|未及时)"
COMPARISON = r"(对比|不同|区别|差异|有什么不同|和.*比)"
DOCUMENT_LOOKUP = r"(原文|链接|网址|URL|url|PDF|pdf|附件|下载|通知链接|文件链接|帮我找|找一下|找一找|在哪里下载)"
CONTENT_QUESTION = r"(有什么要求|什么要求|有哪些要求|有什么不同|什么时候|啥时候|时间|能不能|可不可以|怎么|如何|流程|材料|入口|系统|截止|条件|资格|总结)"
AVAILABILITY = r"(现在|当前|还能|还可以|还来得及|截止了吗|截止没|能不能.*申请|能不能.*报名)"
LATEST = r"(最近|最新|今天|本周|这周|新发)"
LATEST_PROFILE = r"(学院|20\d{2}\s*级|大[一二三四]|本科生|研究生)"
OFF_TOPIC = r"(吃什么|吃啥|外卖|天气|电影|游戏|股票|彩票|闲聊|笑话)"
OTHER_SCHOOL = r"(南京大学|清华大学|北京大学|复旦大学|上海交通大学|浙江大学|中国科学技术大学|哈尔滨工业大学)"
SCHOOL_SEARCH = r"(教务处|研究生院|学院|书院|本科生|研究生|转专业|保研|推免|四六级|CET|报名|申请|成绩|补考|缓考|重修|毕业|学分|课程|选课|考试|校历|寒假|暑假|通知|公告|附件|表格|名单|流程|条件|要求|材料|入口|链接|下载)"
TIME_QUESTION = r"(什么时候|啥时候|何时|几号|哪天|时间|截止|DDL|ddl)"
NEGATIVE = r"(?:不要|别|排除|过滤|不看|不要给我|不是|非)([一-鿿A-Za-z0-9、，,]{2,24}?)(?:通知|公告|信息|结果|$)"
PHRASE_EXCLUSIONS = {r"不要给我项目报名|不要项目报名": ["项目报名", "项目", "交流项目", "暑期项目", "科研项目"], r"不要教务处|别给我教务处": ["教务处"], r"不要学校官网|别给我学校官网": ["学校官网"]}
COLLEGE_ALIASES = {"计算机学院": "计算机科学与工程学院", "计软智学院": "计算机科学与工程学院"}
EXPANSIONS = {
    r"(毕业审核|毕业资格|毕业审查|毕业.*链接)": ["毕业班", "选课学分核对", "毕业资格审查", "培养方案总学分", "毕业生学分"],
    r"(校历|寒假|暑假|放假|开学|报到)": ["校历", "教学日历", "学年校历", "寒假", "暑假", "开学", "报到", "教学周"],
    r"(研究生.*成绩单|成绩单.*研究生)": ["研究生", "研究生院", "成绩单", "打印", "培养", "学籍"],
    r"(转专业|接收方案|接收条件)": ["转专业", "接收条件", "信息一览表", "附件", "专业", "考核方式", "面试", "成绩要求"],
    r"计算机": ["计算机科学与工程学院", "计算机学院", "计算机科学与技术", "计算机专业基础"],
}
PRESETS = {
    "find_document": "document_list",
    "answer_question": "sourced_answer",
    "process_guide": "process_steps",
    "deadline_query": "deadline_brief",
    "eligibility_query": "eligibility_brief",
    "attachment_query": "attachment_list",
    "latest_updates": "latest_digest",
    "profile_query": "profile_digest",
    "unknown": "clarify_or_search",
}
SECTIONS = {
    "document_list": ["我找到的原文", "为什么匹配", "附件", "参考消息源"],
    "sourced_answer": ["结论", "依据", "注意事项", "参考消息源"],
    "process_steps": ["办理步骤", "所需材料", "时间/地点/入口", "注意事项", "参考消息源"],
    "deadline_brief": ["关键时间", "是否过期", "适用对象", "参考消息源"],
    "eligibility_brief": ["简短结论", "适用对象", "条件与限制", "仍需核对", "参考消息源"],
    "attachment_list": ["可下载材料", "所属通知", "适用对象", "参考消息源"],
    "latest_digest": ["最新通知", "即将截止", "可能需要关注", "参考消息源"],
    "profile_digest": ["与你最相关", "全校通用信息", "学院/年级补充", "参考消息源"],
    "clarify_or_search": ["可能相关结果", "建议补充的问题", "参考消息源"],
}
#: Slots by pattern and by intent, in their order; a slot of either kind counts.
SLOTS = [
    (["time"], TIME_QUESTION, "deadline_query"),
    (["time"], AVAILABILITY, None),
    (["process"], PROCESS, "process_guide"),
    (["material"], MATERIAL, "attachment_query"),
    (["entry"], ENTRY, None),
    (["audience", "condition"], ELIGIBILITY, "eligibility_query"),
    (["exception"], EXCEPTION, None),
    (["comparison"], COMPARISON, None),
    (["source"], None, "find_document"),
    (["audience", "time", "condition"], None, "profile_query"),
]
DEFAULT_SLOTS = ["condition", "time", "process", "material"]
SUMMARISED = ["deadline_query", "process_guide", "eligibility_query", "profile_query", "answer_question"]


def has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def off_topic(query: Column, pack: LanguagePack = CHINESE) -> Column:
    """Chat, or another school without this one."""
    own = F.contains(query, F.lit(pack.institution)) if pack.institution else F.lit(False)
    return has(query, OFF_TOPIC) | (has(query, OTHER_SCHOOL) & ~own)


def document_lookup(query: Column) -> Column:
    return has(query, DOCUMENT_LOOKUP) | (has(query, "(通知|公告|文件)") & ~has(query, CONTENT_QUESTION))


def intent_override(query: Column, current: Column, pack: LanguagePack = CHINESE) -> Column:
    """The intent where a query's wording contradicts the planner's broad choice, else ``current``."""
    return (
        F.when(off_topic(query, pack), "unknown")
        .when(has(query, LATEST) & has(query, LATEST_PROFILE), "profile_query")
        .when(has(query, LATEST), "latest_updates")
        .when(has(query, COMPARISON), "answer_question")
        .when(document_lookup(query) & ~has(query, CONTENT_QUESTION), "find_document")
        .when(has(query, PROFILE_STAGE) & has(query, PROFILE_NEED), "profile_query")
        .otherwise(current)
    )


def safe_intent(query: Column, current: Column, pack: LanguagePack = CHINESE) -> Column:
    """intent_override(), and for what stays unknown but looks like a search of the site, the intent that its wording tells."""
    query = F.trim(query)
    over = intent_override(query, current, pack)
    site = SCHOOL_SEARCH if not pack.institution else f"{pack.institution}|{SCHOOL_SEARCH}"
    rescued = (
        F.when(has(query, LATEST), "latest_updates")
        .when(has(query, ELIGIBILITY), "eligibility_query")
        .when(has(query, PROCESS), "process_guide")
        .when(has(query, TIME_QUESTION) | has(query, AVAILABILITY), "deadline_query")
        .when(document_lookup(query), "find_document")
        .otherwise("answer_question")
    )
    return F.when((over == "unknown") & (current == "unknown") & has(query, site) & ~off_topic(query, pack), rescued).otherwise(over)


def needs_summary(query: Column, intent: Column, told: Column) -> Column:
    """Whether an answer is to be written; ``told``: what the planner said."""
    asks = has(query, CONTENT_QUESTION) | has(query, AVAILABILITY)
    return F.when(intent.isin("unknown", "latest_updates"), False).when(asks, True).when(intent.isin("find_document", "attachment_query"), False).when(intent.isin(SUMMARISED), True).otherwise(told)


def slots(query: Column, intent: Column) -> Column:
    """The slots asked for, each once, in the rules' order."""
    listed = []
    for names, pattern, of_intent in SLOTS:
        hit = F.lit(False) if pattern is None else has(query, pattern)
        hit = hit | (intent == of_intent) if of_intent else hit
        listed.append(F.when(hit, texts(names)).otherwise(strings()))
    told = F.array_distinct(F.concat(*listed))
    return F.when((intent == "answer_question") & (F.size(told) == 0), texts(DEFAULT_SLOTS)).otherwise(told)


def excluded(query: Column) -> Column:
    """Terms that a query doesn't want: what stands behind a negation, and what three phrases stand for."""
    said = F.transform(F.regexp_extract_all(query, F.lit(NEGATIVE), F.lit(1)), lambda s: F.regexp_replace(F.regexp_replace(s, "(给我|相关|的|这个|这类)$", ""), "^[ ，,、]+|[ ，,、]+$", ""))
    parts = F.filter(F.flatten(F.transform(said, lambda s: F.split(s, r"[、，,\s]+"))), lambda t: (F.length(F.trim(t)) >= 2) & ~F.trim(t).isin("通知", "公告", "信息", "结果"))
    return merged_terms(parts, *(F.when(has(query, pattern), texts(terms)).otherwise(strings()) for pattern, terms in PHRASE_EXCLUSIONS.items()))


def time_scope(query: Column) -> Column:
    """A class (NN届), ``current``, a year that is no grade, ``recent_2y``, ``historical``, or null."""
    year = F.substring(F.get(F.filter(found(query, r"20\d{2}级?"), lambda y: ~F.endswith(y, F.lit("级"))), F.lit(0)), 1, 4)
    return (
        F.when(has(query, r"\d{2}\s*届"), F.concat(F.lit("20"), F.regexp_extract(query, r"(\d{2})\s*届", 1)))
        .when(has(query, "(今年|本年度|本学年|当前|现在|最新|最近)"), "current")
        .when(year.isNotNull(), year)
        .when(has(query, "(近两年|两年内|最近两年)"), "recent_2y")
        .when(has(query, "(历史|往年|历年|以前)"), "historical")
    )


def college(name: Column) -> Column:
    """A college's full name: blanks out, the last of a pair, aliases resolved; null stays null."""
    plain = F.element_at(F.split(F.replace(name, F.lit(" "), F.lit("")), "和"), -1)
    out = plain
    for alias, full in COLLEGE_ALIASES.items():
        out = F.when(plain == alias, full).otherwise(out)
    return F.when(name.isNull() | (name == ""), None).otherwise(out)


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def authority(query: Column) -> Column:
    """The source that a query prefers, by the first phrase rule; null for none."""
    official = F.when(has(query, "(学校官网|学校通知|学校新闻|新闻|全校)"), "学校官网")
    return (
        F.when(has(query, "不要教务处|别给我教务处"), official)
        .when(has(query, "不要学校官网|别给我学校官网"), None)
        .when(F.contains(query, F.lit("教务处")), "教务处")
        .when(F.contains(query, F.lit("研究生院")), "研究生院")
        .when(first_match(query, COLLEGE).isNotNull(), college(first_match(query, COLLEGE)))
        .when(has(query, "(学校官网|学校通知|全校)"), "学校官网")
    )


def profile_signals(identity: Column, of_college: Column, of_grade: Column, of_type: Column) -> Column:
    """(identity_text, college, grade, student_type): fields as given or as the words tell; the type also from the grade."""
    words = F.concat_ws(" ", *(F.nullif(F.trim(c), F.lit("")) for c in (identity, of_college, of_grade, of_type)))
    grade = F.replace(F.coalesce(F.nullif(of_grade, F.lit("")), first_match(words, GRADE)), F.lit(" "), F.lit(""))
    kind = F.replace(F.coalesce(F.nullif(of_type, F.lit("")), first_match(words, STUDENT_TYPE)), F.lit(" "), F.lit(""))
    kind = F.when(kind.isin("硕士", "博士"), "研究生").otherwise(kind)
    told = F.when(has(grade, "^[研博]"), "研究生").when(F.startswith(grade, F.lit("大")), "本科生")
    return F.struct(F.nullif(F.trim(identity), F.lit("")).alias("identity_text"), college(F.coalesce(F.nullif(of_college, F.lit("")), first_match(words, COLLEGE))).alias("college"), grade.alias("grade"), F.coalesce(kind, told).alias("student_type"))


def expansions(query: Column) -> Column:
    """Terms that the domain's rules add to a query."""
    return F.concat(*(F.when(has(query, pattern), texts(terms)).otherwise(strings()) for pattern, terms in EXPANSIONS.items()))


def minimal_keywords(query: Column, expanded: Column, entities: Column, audience: Column, questions: Column, most: int = 24) -> Column:
    """The query, eight expanded ones, entities, audience, the domain's terms for query and sub-questions, and the query's tokens."""
    more = F.flatten(F.transform(questions, expansions))
    return F.slice(merged_terms(F.array(query), F.slice(expanded, 1, 8), entities, F.filter(audience, lambda a: a.isNotNull()), expansions(query), more, found(query, r"[A-Za-z0-9_]+|[一-鿿]{2,}")), 1, most)


def preset(intent: Column) -> Column:
    """The output preset of an intent."""
    out = F.lit("sourced_answer")
    for name, value in PRESETS.items():
        out = F.when(intent == name, value).otherwise(out)
    return out


def sections(of_preset: Column) -> Column:
    """The sections of a preset; null for an unknown one."""
    out = F.lit(None).cast("array<string>")
    for name, listed in SECTIONS.items():
        out = F.when(of_preset == name, texts(listed)).otherwise(out)
    return out
