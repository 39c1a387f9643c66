"""The engine as a service object: settings, the current collection, sessions, a response cache, one search after another."""

from __future__ import annotations

import json
import os
import re
from collections import OrderedDict
from dataclasses import asdict, dataclass, field, fields
from datetime import date

from pyspark.sql import DataFrame

from .lexicon import CHINESE, LanguagePack
from .operators import search
from .plans import query_plan as plans


@dataclass(frozen=True)
class Settings:
    """Limits and switches; ``from_environment`` reads ``SIEVELIGHT_<NAME>``."""

    limit: int = 8
    most: int = 20
    cached: int = 128
    sessions: int = 200
    evicted: int = 50
    rerank: bool = False
    judge: bool = False
    crawl_pages: int = 200
    crawl_depth: int = 6
    crawl_days: int = 730

    @classmethod
    def from_environment(cls, environment=os.environ) -> Settings:
        given = {}
        for f in fields(cls):
            value = environment.get(f"SIEVELIGHT_{f.name.upper()}")
            if value is not None:
                given[f.name] = value.lower() not in ("0", "false", "off", "disabled", "") if isinstance(f.default, bool) else int(value)
        return cls(**given)


class ResponseCache:
    """Least recently used; keys hold the index's version, so a new snapshot makes old entries unreachable."""

    def __init__(self, most: int):
        self.most, self.entries = most, OrderedDict()

    @staticmethod
    def key(**parts) -> str:
        return json.dumps(parts, sort_keys=True, ensure_ascii=False, default=str)

    def get(self, key: str):
        if key in self.entries:
            self.entries.move_to_end(key)
            return self.entries[key]
        return None

    def put(self, key: str, value) -> None:
        self.entries[key] = value
        self.entries.move_to_end(key)
        while len(self.entries) > self.most:
            self.entries.popitem(last=False)


class Sessions:
    """What was asked last in each session; the oldest go together when there are too many."""

    FOLLOW_UP = re.compile(r"^(?:那|这|它|他们|上面|刚才|it|this|that|they)", re.I)

    def __init__(self, most: int, evicted: int):
        self.most, self.evicted, self.last = most, evicted, OrderedDict()

    def contextual(self, session: str | None, query: str) -> str:
        before = self.last.get(session) if session else None
        return f"{before} {query}" if before and self.FOLLOW_UP.search(query.strip()) else query

    def remember(self, session: str | None, topic: str) -> None:
        if not session:
            return
        self.last[session] = topic
        self.last.move_to_end(session)
        if len(self.last) > self.most:
            for _ in range(self.evicted):
                self.last.popitem(last=False)


def resolve_collection(collections: list[dict], wanted: int | None) -> dict:
    """The wanted collection if enabled, or else the default, or else the first enabled one."""
    enabled = [c for c in collections if c.get("is_enabled")]
    if wanted is not None:
        found = next((c for c in enabled if c["id"] == wanted), None)
        if found is None:
            raise LookupError("no such collection")
        return found
    found = next((c for c in enabled if c.get("slug") == "default"), next(iter(enabled), None))
    if found is None:
        raise LookupError("no collection is enabled")
    return found


@dataclass
class Engine:
    """Searches tables of documents and chunks; ``planner(query) -> dict`` is an outside planner, by default none."""

    docs: DataFrame
    chunks: DataFrame
    version: int
    settings: Settings = field(default_factory=Settings)
    pack: LanguagePack = CHINESE
    members: DataFrame | None = None
    planner: object = None

    def __post_init__(self):
        self.cache = ResponseCache(self.settings.cached)
        self.sessions = Sessions(self.settings.sessions, self.settings.evicted)

    def search(self, query: str, as_of: date, profile: plans.UserProfile | None = None, limit: int | None = None, collection_id: int | None = None, session: str | None = None) -> list[dict]:
        if not 1 <= len(query.strip()) <= 300:
            raise ValueError("a query has 1 to 300 characters")
        limit = min(limit or self.settings.limit, self.settings.most)
        asked = self.sessions.contextual(session, query.strip())
        key = self.cache.key(query=asked, profile=asdict(profile) if profile else None, limit=limit, collection=collection_id, as_of=as_of, version=self.version)
        known = self.cache.get(key)
        if known is None:
            plan = plans.normalised(self.planner(asked) if self.planner else {}, asked, profile, self.pack)
            found = [] if plan.intent == "unknown" else search.search(self.docs, self.chunks, plan, as_of, profile, max(3 * limit, 24), self.members, collection_id, pack=self.pack).limit(limit).collect()
            known = [r.asDict(True) for r in found]
            self.cache.put(key, known)
        self.sessions.remember(session, asked)
        return known
