"""Schemas of the base tables, and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTACHMENT = "struct<name:string,url:string,text:string,pages:array<struct<page:int,text:string>>,sheets:array<struct<sheet:string,text:string>>>"
DOCUMENT_DDL = f"id bigint, url string, title string, source string, category string, publish_date date, body string, attachments array<{ATTACHMENT}>, applicable_colleges array<string>, applicable_grades array<string>, student_types array<string>, topics array<string>, keywords array<string>, ai_metadata string, deadline date, content_hash string"
COLLECTION_DDL = "id bigint, slug string, name string, description string, is_enabled boolean"
COLLECTION_SOURCE_DDL = "id bigint, collection_id bigint, source_name string, base_url string, max_depth int, max_pages int, days_back int, include_paths array<string>, exclude_paths array<string>, start_urls array<string>"
MEMBER_DDL = "collection_id bigint, document_id bigint"
TASK_DDL = "task_id string, status string, progress double, message string, created_at timestamp, updated_at timestamp"
AUTHORITY_DDL = "source string, kind string, authority_weight double"


def fields(ddl: str) -> dict[str, str]:
    """Names and types of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i].strip().split(" ", 1))
            start = i + 1
    return dict(out)


def evolve(df: DataFrame, ddl: str, defaults: dict | None = None) -> DataFrame:
    """``df`` with every column of ``ddl``: those it lacks with their default or null, others as they are."""
    made = [F.lit((defaults or {}).get(n)).cast(t).alias(n) for n, t in fields(ddl).items() if n not in df.columns]
    return df.select("*", *made)


def parsed_list(text, element: str = "string"):
    """A JSON list, or an empty array for null, malformed or other JSON."""
    return F.coalesce(F.from_json(text, f"array<{element}>"), F.array().cast(f"array<{element}>"))
