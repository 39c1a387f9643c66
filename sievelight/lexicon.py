"""Language packs: the word lists and patterns that the engine's rules are stated in.

A pack is a value; rules take one as a parameter.  ``CHINESE`` serves university sites in Chinese, ``LATIN`` texts in
Latin letters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the Chinese pack.
STOPWORDS = ["关于", "通知", "工作", "进行", "相关", "有关", "根据", "学校", "学生", "各位", "各院", "各学院"]
DOMAIN_TERMS = ["四六级", "CET", "转专业", "专业调整", "校历", "缓考", "补考", "评教", "辅修", "选课", "成绩复核", "成绩单", "毕业审核", "推免", "保研", "奖学金", "培养方案", "考试安排", "申请表", "报名", "截止", "下载"]
SYNONYMS = {
    "四六级": ["CET", "大学英语四级", "大学英语六级", "全国大学英语四、六级考试", "英语四六级"],
    "CET": ["四六级", "大学英语四级", "大学英语六级", "全国大学英语四、六级考试"],
    "四级": ["CET4", "CET-4", "大学英语四级", "全国大学英语四级考试"],
    "CET4": ["四级", "大学英语四级", "全国大学英语四级考试"],
    "六级": ["CET6", "CET-6", "大学英语六级", "全国大学英语六级考试"],
    "CET6": ["六级", "大学英语六级", "全国大学英语六级考试"],
    "保研": ["推免", "推荐免试", "推荐免试研究生"],
    "推免": ["保研", "推荐免试", "推荐免试研究生"],
}
GENERIC_TERMS = ["通知", "公告", "文件", "链接", "原文", "报名", "申请", "打印", "成绩", "附件", "下载", "本科生", "研究生", "教务处", "时间", "查询", "办理", "PDF", "pdf"]
BOILERPLATE_TERMS = ["版权所有", "网站管理", "技术支持", "友情链接", "官方微信", "部门简介", "办事平台", "简体中文", "更多联系方式", "处室电话", "联系我们"]
FOOTER_PATTERNS = [r"版权所有", r"\[?网站管理\]?", r"技术支持", r"更多联系方式", r"处室电话[:：].*更多联系方式"]
NAV_TERMS = ["部门简介", "本科生人才培", "领导分工", "招生办公室", "教学研究科", "质量评估科", "教务科", "学籍管理科", "实践教学科", "公共教室管理", "教学服务中心", "办事平台", "信息通知", "教务信息", "导师风采", "教师教学发展", "审核评估", "管理规定", "毕业设计", "实习实践", "课外研学", "校企合作", "办事流程", "教务流程", "学籍流程", "教研流程"]
NAV_LINES = ["English", "简体中文", "部门简介", "领导分工", "处办公室", "招生办公室", "教学研究科", "质量评估科", "教务科", "学籍管理科", "实践教学科", "丁家桥教务办", "公共教室管理", "文化素质教育", "教学服务中心", "联系我们", "办事平台", "信息通知", "教务信息", "学籍管理", "导师风采", "教学研究", "实践教学", "教师教学发展", "审核评估", "评估信息", "管理规定", "教务管理", "毕业设计", "实习实践", "课外研学", "校企合作", "办事流程", "教务流程", "学籍流程", "教研流程", "实践流程", "出国交流", "教室借用", "首页", "最新动态", "无图信息", "有图信息", "办公室信息管理"]
TIME_WORDS = {"current": ["今年", "目前", "现在", "最新", "本学期", "当前"], "recent_2y": ["近两年", "最近两年"], "historical": ["历史", "往年", "历年"]}


@dataclass(frozen=True)
class LanguagePack:
    """What the rules of a language need; every field has a neutral default."""

    stopwords: list[str] = field(default_factory=list)
    domain_terms: list[str] = field(default_factory=list)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    generic_terms: list[str] = field(default_factory=list)
    boilerplate_terms: list[str] = field(default_factory=list)
    footer_patterns: list[str] = field(default_factory=list)
    nav_terms: list[str] = field(default_factory=list)
    nav_lines: list[str] = field(default_factory=list)
    contact_pattern: str = r"(phone|telephone|contact|e-mail)"
    contact_query_pattern: str = r"(phone|telephone|contact|e-mail)"
    notice_pattern: str = r"(?i)(notice|news|announcement|schedule)"
    heading_pattern: str = r"(?i)(overview|materials|time|conditions|notice|schedule)$"
    office: str = ""
    college_word: str = "college"
    institution: str = ""
    tokens: str = r"[A-Za-z0-9_]+|[一-鿿]{2,}"
    keyword_tokens: str = r"[A-Za-z][A-Za-z0-9_-]{1,}|20\d{2}级|20\d{2}|[一-鿿]{2,8}"


CHINESE = LanguagePack(
    STOPWORDS,
    DOMAIN_TERMS,
    SYNONYMS,
    GENERIC_TERMS,
    BOILERPLATE_TERMS,
    FOOTER_PATTERNS,
    NAV_TERMS,
    NAV_LINES,
    r"(联系电话|联系方式|教务老师|联系人|电话)",
    r"(联系电话|联系方式|联系谁|老师|联系人|电话)",
    r"(通知|公告|公示|安排|查询)",
    r"(流程|材料|时间|对象|条件|附件|通知|安排|说明)$",
    "教务处",
    "学院",
)
LATIN = LanguagePack(stopwords=["the", "and", "for", "with"], generic_terms=["notice", "file", "link", "download", "time"], boilerplate_terms=["copyright", "all rights reserved", "terms of use", "privacy policy", "contact us", "sitemap", "license"], footer_patterns=[r"(?i)all rights reserved", r"(?i)copyright"], nav_terms=["Home", "About", "Contact", "Sitemap", "Login"], nav_lines=["Home", "About", "Contact", "Sitemap", "Login"])
