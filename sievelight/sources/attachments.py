"""Attachment files to text: kinds by magic bytes, Word and Excel packages by the standard library, legacy files by mining.

Files come as Spark's ``binaryFile`` rows (path, content, length); one vectorised function reads them.  PDF has no reader here and
gives an empty payload.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 8 << 20
TABLES, ROWS, SHEETS = 20, 120, 5
PAYLOAD = "kind string, text string, sheets array<struct<sheet:string,text:string>>, n_rows int, status string"


def magic(content: Column) -> Column:
    """pdf, zip, ole or null, by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head == "504B0304", "zip").when(head == "D0CF11E0", "ole")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx(data: bytes) -> tuple[str, int]:
    """Paragraphs, then tables with cells parted by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        root = ElementTree.fromstring(package.read("word/document.xml"))
    body = next((e for e in root.iter() if local(e.tag) == "body"), root)
    words = lambda e: "".join(t.text or "" for t in e.iter() if local(t.tag) == "t").strip()
    lines = [words(p) for p in body if local(p.tag) == "p"]
    n = 0
    for table in [t for t in body if local(t.tag) == "tbl"][:TABLES]:
        for row in [r for r in table if local(r.tag) == "tr"][:ROWS]:
            cells = [words(c) for c in row if local(c.tag) == "tc"]
            if any(cells):
                lines.append(" | ".join(cells))
                n += 1
    return "\n".join(filter(None, lines)), n


def xlsx(data: bytes) -> tuple[list[dict], int]:
    """Per sheet, in the workbook's order, rows with cells parted by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        names = set(package.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in ElementTree.fromstring(package.read("xl/sharedStrings.xml"))]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
        out, n = [], 0
        sheets = [s for s in ElementTree.fromstring(package.read("xl/workbook.xml")).iter() if local(s.tag) == "sheet"][:SHEETS]
        for i, sheet in enumerate(sheets, 1):
            rel = next((v for k, v in sheet.attrib.items() if local(k) == "id"), None)
            target = (targets.get(rel) or f"worksheets/sheet{i}.xml").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if path not in names:
                continue
            lines = []
            for row in [r for r in ElementTree.fromstring(package.read(path)).iter() if local(r.tag) == "row"][:ROWS]:
                cells = []
                for c in row:
                    value = next((v.text or "" for v in c if local(v.tag) == "v"), "")
                    if c.get("t") == "s" and value.isdigit() and int(value) < len(strings):
                        value = strings[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
                    cells.append(value.strip())
                if any(cells):
                    lines.append(" | ".join(cells).rstrip(" |"))
                    n += 1
            out.append({"sheet": sheet.get("name") or f"Sheet{i}", "text": "\n".join(lines)})
    return out, n


def legacy(data: bytes, least: int = 18) -> str:
    """The most text-like reading of an old Office file in four encodings."""
    best, score = "", least - 1
    for encoding in ("utf-16le", "gb18030", "utf-8", "latin1"):
        text = data.decode(encoding, "ignore")
        runs = re.findall(r"[一-鿿A-Za-z0-9，。；：、（）()《》“”\-—./% ]{4,}", text)
        lines = list(dict.fromkeys(r.strip() for r in runs if len(r.strip()) >= 4 and (re.search(r"[一-鿿]{2,}", r) or encoding != "latin1" and re.search(r"[A-Za-z]{4,}", r))))
        value = 2 * sum(len(re.findall(r"[一-鿿]", x)) for x in lines) + sum(len(re.findall(r"[A-Za-z0-9]", x)) for x in lines) // 2
        if value > score:
            best, score = "\n".join(lines), value
    return best


def read(path: str, data: bytes) -> dict:
    empty = {"kind": "", "text": "", "sheets": [], "n_rows": 0, "status": "ok"}
    suffix = path.rpartition(".")[2].lower()
    try:
        if data[:4] == b"%PDF":
            return empty | {"kind": "pdf", "status": "no_reader"}
        if data[:4] == b"PK\x03\x04":
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
            if "word/document.xml" in names:
                text, n = docx(data)
                return empty | {"kind": "docx", "text": text, "n_rows": n}
            if "xl/workbook.xml" in names:
                sheets, n = xlsx(data)
                return empty | {"kind": "xlsx", "text": "\n".join(s["text"] for s in sheets), "sheets": sheets, "n_rows": n}
            return empty | {"kind": "zip", "status": "unsupported"}
        if data[:4] == b"\xd0\xcf\x11\xe0" or suffix in ("doc", "xls"):
            text = legacy(data)
            return empty | {"kind": suffix if suffix in ("doc", "xls") else "doc", "text": text, "status": "ok" if text else "no_text"}
        return empty | {"kind": suffix, "status": "unsupported"}
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as problem:
        return empty | {"kind": suffix, "status": f"error: {type(problem).__name__}"}


def parsed(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(path, length, kind, text, sheets, n_rows, status) of ``binaryFile`` rows; larger files aren't read."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": p, "length": n} | read(p, bytes(c)) for p, n, c in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "length", "kind", "text", "sheets", "n_rows", "status"])

    inside = files.filter(F.col("length") <= largest).select("path", "length", "content").mapInPandas(work, f"path string, length bigint, {PAYLOAD}")
    nothing = F.array().cast("array<struct<sheet:string,text:string>>")
    outside = files.filter(F.col("length") > largest).select("path", "length", F.lit("").alias("kind"), F.lit("").alias("text"), nothing.alias("sheets"), F.lit(0).alias("n_rows"), F.lit("too_large").alias("status"))
    return inside.unionByName(outside)


def outcome_counts(read_files: DataFrame) -> DataFrame:
    return read_files.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))
