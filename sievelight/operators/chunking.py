"""Documents to chunks: title, packed body, attachment names, table rows, attachment text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, deduped, found, segmented, texts, title_terms, token_count
from ..lexicon import CHINESE, LanguagePack

TARGET, OVERLAP, LONGEST = 900, 160, 1800
ROWS, PDF_ROWS, CELL, ROW_TEXT = 80, 60, 180, 900
SCHEMA = ["document_id", "chunk_index", "chunk_text", "heading", "page", "chunk_kind", "attachment_name"]


def packed(body: str, pack: LanguagePack = CHINESE) -> list[tuple[str, str]]:
    """(text, heading): lines joined greedily, each chunk beginning with the end of the one before."""
    out: list[tuple[str, str]] = []
    current, heading = "", "正文"
    for line in filter(None, map(str.strip, body.splitlines())):
        if len(line) <= 40 and re.search(pack.heading_pattern, line):
            heading = line  # before the chunk is closed, so the closed chunk has it, too
        if current and len(current) + len(line) > TARGET:
            out.append((current.strip(), heading))
            current = current[-OVERLAP:]
        current = f"{current}\n{line}".strip() if current else line
    return [*out, (current.strip(), heading)] if current else out


def cell(value) -> str:
    return re.sub(r"\s+", " ", "" if value is None else str(value)).strip()[:CELL]


def table_rows(rows: list[list], label: str = "", most: int = ROWS) -> list[dict]:
    """Rows told in words: ``label；第n行；header：value；…``; the first row is the header if there are more."""
    plain = [[cell(c) for c in row] for row in rows]
    plain = [row[: max((i + 1 for i, c in enumerate(row) if c), default=0)] for row in plain]
    plain = [(n, row) for n, row in enumerate(plain, 1) if row]
    if not plain:
        return []
    header = plain[0][1] if len(plain) > 1 else []
    out = []
    for n, row in plain[1:] if header else plain:
        cells = [(header[i] if i < len(header) and header[i] else f"列{i + 1}", c) for i, c in enumerate(row) if c]
        told = "；".join(filter(None, [label, f"第{n}行", *(f"{h}：{c}" for h, c in cells)]))
        out.append({"row_number": n, "text": told[:ROW_TEXT], "cells": cells})
    return out[:most]


def text_rows(text: str) -> list[list[str]]:
    """Rows of a plain-text table: lines parted by bars or tabs."""
    return [re.split(r"\s*\|\s*|\t+", line.strip()) for line in text.splitlines() if "|" in line or "\t" in line]


def parts(title: str | None, body: str | None, attachments: list[dict] | None, pack: LanguagePack = CHINESE) -> list[tuple]:
    """(text, heading, page, kind, attachment name) in the order of the index."""
    out: list[tuple] = []
    if (title or "").strip():
        out.append((title.strip(), "标题", None, "title", None))
    out += [(t, h, None, "body", None) for t, h in packed(body or "", pack)]
    attachments = attachments or []
    names = "、".join(a["name"] for a in attachments if a.get("name"))
    if names:
        out.append((f"附件：{names}", "附件", None, "attachment_list", None))
    for a in attachments:
        name, text = a.get("name") or "", a.get("text") or ""
        out += [(r["text"], f"{name} 第{r['row_number']}行", None, "attachment_table_row", name) for r in table_rows(text_rows(text), name)]
        pages = a.get("pages") or []
        out += [(p["text"], f"{name} 第{p['page']}页", p["page"], "attachment_text", name) for p in pages if p.get("text")]
        if text and not pages:
            out.append((text, name, None, "attachment_text", name))
    # what is longer than a chunk goes on in further ones, which begin with the end of the one before
    return [(t[at : at + LONGEST], *rest) for t, *rest in out if len(t.strip()) >= 2 for at in range(0, max(1, len(t) - OVERLAP), LONGEST - OVERLAP)]


def _with_chunks(docs: DataFrame, pack: LanguagePack) -> DataFrame:
    """The rows of ``docs``, one for each chunk, with the chunk's columns (SCHEMA) behind; the texts go through Python a hundred at a time."""

    def work(title: str | None, body: str | None, attachments: list | None) -> list[tuple]:
        listed = [a if isinstance(a, dict) else a.asDict(True) for a in (attachments if attachments is not None else [])]
        return parts(title, body, listed, pack)

    made = F.udf(work, "array<struct<chunk_text:string,heading:string,page:int,chunk_kind:string,attachment_name:string>>", useArrow=False)
    rows = docs.select(F.col("id").alias("document_id"), *(c for c in docs.columns if c not in ("id", "body", "attachments")), F.posexplode(made("title", "body", "attachments")).alias("chunk_index", "_chunk"))
    return rows.select("*", "_chunk.*").drop("_chunk")


def chunk_documents(docs: DataFrame, pack: LanguagePack = CHINESE) -> DataFrame:
    """One row per chunk of ``docs`` (id, title, body, attachments), without a shuffle."""
    return _with_chunks(docs.select("id", "title", "body", "attachments"), pack).select(*SCHEMA)


def chunk_tags(pack: LanguagePack = CHINESE, limit: int = 64) -> Column:
    """Tags of a chunk joined with its document's columns."""
    text = F.concat_ws("\n", "title", "source", "category", "heading", "attachment_name", "chunk_text")
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("topics", "keywords", "applicable_colleges", "applicable_grades", "student_types")]
    values = [F.array(*(F.coalesce(F.col(c), F.lit("")) for c in ("title", "source", "category", "heading", "chunk_kind", "attachment_name"))), *lists]
    none = F.array().cast("array<string>")
    for topic, aliases in pack.synonyms.items():
        values.append(F.when(F.exists(texts([topic, *aliases]), lambda t: F.contains(text, t)), texts([topic, *aliases])).otherwise(none))
    values += [F.filter(texts(pack.domain_terms), lambda t: F.contains(text, t)), F.when(F.col("publish_date").isNotNull(), F.array(F.date_format("publish_date", "yyyy"))).otherwise(none)]
    values += [title_terms(F.col("title")), title_terms(F.col("heading"))]
    # fixed values: labels by kind
    kinds = {"attachment_table_row": ["附件表格行", "表格行", "行级证据", "表格", "名单", "条件", "要求"], "attachment_text": ["附件正文", "附件内容", "表格", "名单", "下载"], "attachment_list": ["附件列表", "下载", "材料"], "title": ["标题", "原文", "通知"]}
    label = none
    for kind, labels in kinds.items():
        label = F.when(F.col("chunk_kind") == kind, texts(labels)).otherwise(label)
    return deduped(F.concat(*values, label), limit)


#: The columns of a document that stand in the search text of its chunks.
TOLD = ["title", "source", "category", "topics", "keywords", "applicable_colleges", "applicable_grades", "student_types"]


def search_text(pack: LanguagePack = CHINESE) -> Column:
    """The labelled text that the index holds of a chunk, with its n-grams behind; whole."""
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    lines = [("标题", F.col("title")), ("来源", F.col("source")), ("栏目", F.col("category")), ("标题块", F.col("heading")), ("块类型", F.col("chunk_kind")), ("主题", joined("topics")), ("关键词", joined("keywords")), ("标签", joined("chunk_tags")), ("附件", F.col("attachment_name")), ("适用学院", joined("applicable_colleges")), ("适用年级", joined("applicable_grades")), ("适用身份", joined("student_types")), ("正文", F.col("chunk_text"))]
    raw = F.concat_ws("\n", *(F.concat(F.lit(f"{name} "), F.coalesce(value, F.lit(""))) for name, value in lines))
    return F.concat(raw, F.lit("\n分词 "), segmented(raw, pack))


def indexed(docs: DataFrame, pack: LanguagePack = CHINESE, **more: Column) -> DataFrame:
    """Chunks with ids, tags, search text and token counts, ready for the index; a chunk's id follows from document and position.

    Each chunk keeps the columns of its document beside it, so no text is joined or dealt out; ``more`` gives columns made of those.
    """
    full = _with_chunks(docs.filter("id is not null").select("id", "body", "attachments", "publish_date", *TOLD), pack)
    full = full.withColumn("chunk_tags", chunk_tags(pack)).withColumn("search_text", search_text(pack)).withColumn("token_count", token_count(F.col("chunk_text")))
    return full.select((F.col("document_id") * 10_000 + F.col("chunk_index")).alias("chunk_id"), *SCHEMA, "chunk_tags", "search_text", "token_count", *(c.alias(n) for n, c in more.items()))


__all__ = ["chunk_documents", "collapsed", "found", "indexed", "packed", "parts", "table_rows", "text_rows"]
