"""The query plan, the engine's only query language, and the rules that complete one."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions.text import expanded
from ..lexicon import CHINESE, LanguagePack

INTENTS = ("answer_question", "find_document", "deadline_query", "process_guide", "eligibility_query", "attachment_query", "latest_updates", "profile_query", "unknown")


@dataclass(frozen=True)
class UserProfile:
    identity_text: str | None = None
    college: str | None = None
    grade: str | None = None
    student_type: str | None = None
    major: str | None = None
    campus: str | None = None


@dataclass(frozen=True)
class QueryPlan:
    normalized_query: str
    intent: str = "answer_question"
    confidence: float = 0.5
    sub_questions: list[str] = field(default_factory=list)
    retrieval_keywords: list[str] = field(default_factory=list)
    expanded_queries: list[str] = field(default_factory=list)
    entities: dict = field(default_factory=dict)
    filters: dict = field(default_factory=dict)
    exclude_terms: list[str] = field(default_factory=list)
    time_scope: str | None = None
    authority_preference: str | None = None
    need_answer_summary: bool = True
    output_preset: str = "default"
    notes: str = ""

    def __post_init__(self):
        if self.intent not in INTENTS:
            raise ValueError(f"unknown intent {self.intent!r}")
        if not 0 <= self.confidence <= 1:
            raise ValueError("confidence is from 0 to 1")

    def one(self, name: str) -> str | None:
        value = self.entities.get(name)
        return value if isinstance(value, str) and value else None


def dedupe(terms: list[str]) -> list[str]:
    """Blanks collapsed, at least two characters, each once regardless of case, in order."""
    out: dict[str, str] = {}
    for term in terms:
        plain = re.sub(r"\s+", " ", str(term or "")).strip()
        if len(plain) >= 2:
            out.setdefault(plain.lower(), plain)
    return list(out.values())


def query_strings(plan: QueryPlan, pack: LanguagePack = CHINESE, most: int | None = None) -> list[str]:
    """All strings that the recall channels look for."""
    listed = [plan.normalized_query, *plan.sub_questions, *plan.retrieval_keywords, *plan.expanded_queries]
    return dedupe(listed if any(listed) else expanded(plan.normalized_query, pack))[:most]


def like_terms(plan: QueryPlan, pack: LanguagePack = CHINESE, most: int = 16) -> list[str]:
    """The query strings, their tokens and the topic, each once."""
    listed = [t for q in query_strings(plan, pack) for t in (q, *re.findall(pack.tokens, q))]
    out: dict[str, str] = {}
    for term in [*listed, plan.one("topic") or ""]:
        if len(term.strip()) >= 2:
            out.setdefault(term.strip().lower(), term.strip())
    return list(out.values())[:most]


def is_generic(term: str | None, pack: LanguagePack = CHINESE) -> bool:
    plain = re.sub(r"\s+", "", term or "")
    return len(plain) < 2 or plain in pack.generic_terms or bool(re.fullmatch(r"20\d{2}", plain))


def _audience(plan: QueryPlan) -> list:
    return [plan.filters.get(k) or plan.entities.get(k) for k in ("college", "grade", "student_type")]


def specific_terms(plan: QueryPlan, pack: LanguagePack = CHINESE, most: int = 10) -> list[str]:
    """Terms that tell documents apart."""
    listed = [re.sub(r"\s+", "", t) for t in query_strings(plan, pack, 16)]
    listed += [v for v in (plan.one("topic"), *_audience(plan)) if isinstance(v, str)]
    out: dict[str, str] = {}
    for term in listed:
        if not is_generic(term, pack) and len(term) >= 2:
            out.setdefault(term.lower(), term)
    return list(out.values())[:most]


def coverage_terms(plan: QueryPlan, pack: LanguagePack = CHINESE, most: int = 10) -> list[str]:
    """Terms of which a good hit has several."""
    listed: list = [*plan.retrieval_keywords, *plan.expanded_queries, *plan.sub_questions]
    for value in (plan.entities.get("topic"), plan.entities.get("action"), *_audience(plan)):
        listed += value if isinstance(value, list) else [value] if isinstance(value, str) else []
    listed = listed or re.findall(pack.tokens, plan.normalized_query)
    out: dict[str, str] = {}
    for term in listed:
        plain = re.sub(r"\s+", "", str(term or ""))
        if not is_generic(plain, pack) and (len(plain) <= 18 or re.search(r"[A-Za-z0-9]", plain)):
            out.setdefault(plain.lower(), plain)
    return list(out.values())[:most]


def topic_terms(topic: str, pack: LanguagePack = CHINESE) -> list[str]:
    return list(dict.fromkeys(t for t in [topic, *expanded(topic, pack)] if t))


def profile_terms(plan: QueryPlan, profile: UserProfile, most: int = 10) -> list[str]:
    """What the profile channel looks for."""
    listed = [profile.college, profile.grade, profile.student_type, profile.major, profile.campus, *(v for v in _audience(plan) if isinstance(v, str))]
    return dedupe([t for t in listed if t])[:most]


def time_scope(query: str, pack: LanguagePack = CHINESE) -> str | None:
    """A class (NN届) or year, ``current``, ``recent_2y``, ``historical``, or none."""
    from ..lexicon import TIME_WORDS

    if m := re.search(r"(?<!\d)(\d{2})届", query):
        return f"20{m[1]}"
    if any(w in query for w in TIME_WORDS["recent_2y"]):
        return "recent_2y"
    if any(w in query for w in TIME_WORDS["historical"]):
        return "historical"
    if any(w in query for w in TIME_WORDS["current"]):
        return "current"
    if m := re.search(r"(20\d{2})(?!级)", query):
        return m[1]
    return None


def normalised(raw: dict, query: str, profile: UserProfile | None = None, pack: LanguagePack = CHINESE) -> QueryPlan:
    """A plan from an external planner's JSON object, completed and coerced; works on ``{}`` too."""

    def strings(name: str) -> list[str]:
        value = raw.get(name)
        return dedupe([str(v) for v in (value if isinstance(value, list) else [value]) if v])

    profile = profile or UserProfile()
    filters = dict(raw.get("filters") or {})
    for name in ("college", "grade", "student_type"):
        if getattr(profile, name) and not filters.get(name):
            filters[name] = getattr(profile, name)
    intent = raw.get("intent") if raw.get("intent") in INTENTS else "answer_question"
    confidence = raw.get("confidence")
    plan = QueryPlan(
        normalized_query=str(raw.get("normalized_query") or query).strip(),
        intent=intent,
        confidence=min(1.0, max(0.0, float(confidence))) if isinstance(confidence, (int, float)) else 0.5,
        sub_questions=strings("sub_questions"),
        retrieval_keywords=(strings("retrieval_keywords") or expanded(query, pack))[:32],
        expanded_queries=strings("expanded_queries"),
        entities=dict(raw.get("entities") or {}),
        filters=filters,
        exclude_terms=strings("exclude_terms"),
        time_scope=raw.get("time_scope") or time_scope(query, pack),
        authority_preference=raw.get("authority_preference"),
        need_answer_summary=bool(raw.get("need_answer_summary", intent not in ("find_document", "latest_updates"))),
        output_preset=str(raw.get("output_preset") or intent),
        notes=str(raw.get("notes") or ""),
    )
    return replace(plan, need_answer_summary=False) if plan.intent == "unknown" else plan
