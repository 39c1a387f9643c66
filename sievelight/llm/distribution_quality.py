"""Quality rules by distribution divergence.

A document's histograms of character classes and of its language's common words are compared with the
reference of its language by the Jensen-Shannon distance (base 2, so 0 to 1).  References are totals over all
documents of the language that pass the base rules, from counts that the same pass gathers.  Short texts are
guarded: a histogram is compared only above a least length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, by_rows, marked, window_hashes, word_hashes, written

#: Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it with be are this by on or from as at was an not have which but",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec plus ce se sont",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus",
}
#: Histogram bins of characters; the last takes the rest.
CLASSES = [re.compile(x) for x in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]", r"[à-öø-ÿ]")]
#: Least words for comparing character classes and common words, and the greatest distances.  A text without common words is at 0.34 from
#: references with 22 % of them (at more from those with a greater share), clean texts of 100 words are within 0.27.
LEAST_CLASSES, LEAST_COMMON = 30, 100
MOST_CLASSES, MOST_COMMON = 0.30, 0.30
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20

#: The bin of each character up to U+00FF, and at 256 that of all others.
LETTER_BINS = np.full(257, len(CLASSES), np.int64)
for _k, _pattern in enumerate(CLASSES):
    for _c in range(256):
        if _pattern.match(chr(_c)):
            LETTER_BINS[_c] = _k
SYMBOL = re.compile(r"[#*$%&|<>]")


def measure(text: str, lang: str | None, memo: WordHashes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, common-word counts (the last bin: other words)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    inked = codes[~blank]
    bins = np.bincount(LETTER_BINS[np.minimum(inked, 256)], minlength=len(CLASSES) + 1)
    lines: dict[str, int] = {}
    doubled = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            doubled += line in lines
            lines[line] = 1
    repeated = 0
    if n >= 5:
        windows = window_hashes(word_hashes(words, memo), 5)
        _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[back] > 1)
        if len(again):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + 5, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    common = COMMON_WORDS.get(lang or "", "").split()
    places = {w.encode(): i for i, w in enumerate(common)}
    hits = np.zeros(len(common) + 1, np.int64)
    counted = Counter(raw.lower().split())
    for w, i in places.items():
        hits[i] = counted.get(w, 0)
    hits[-1] = n - hits.sum()
    return n, int(len(inked)), len(SYMBOL.findall(text)), doubled, repeated, bins.tolist(), hits.tolist()


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts of one length; null where one has no counts."""

    def share(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
        return F.when(total > 0, F.transform(x, lambda v: v.cast("double") / total))

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(share(p), share(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)))


def histograms(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang, _mark, _mark2, base counts and both histograms of every row; null text is none, null lang stays null."""
    rows = marked(df, key, text, lang)
    fields = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes array<bigint>, common array<bigint>"

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for table in tables:
            found = [measure(t or "", g, memo) for t, g in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [table.column(0), *table.columns[2:], *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[5:])],
                [key, lang, "_mark", "_mark2", *(x.split(" ")[0] for x in fields.split(", "))],
            )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(work, f"`{key}` {kinds[key]}, `{lang}` {kinds[lang]}, _mark bigint, _mark2 int, {fields}")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """_judged() without the marks."""
    return _judged(df, key, text, lang).drop("_mark", "_mark2")


def _judged(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """One row per row of ``df``: key, the base counts, base_failed, class_distance, common_distance, kept.

    ``kept`` is false where the base rules fail or a guarded distance is over its limit.  A document of a
    language without common words, or with a null one, is compared by character classes with the documents
    of the same (or null) language.  Repeated rows are judged alike; an empty text fails the base rules.

    The histograms are a narrow table in the shared folder.  The references are one row per language,
    made by partial sums; they are joined by broadcast, after their number was counted, or else by shuffle.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    told = written(histograms(df, key, text, lang)).withColumn("base_failed", failed)
    sound = told.filter("not base_failed")

    def totals(name: str, length: int) -> list[Column]:
        return [F.coalesce(F.sum(F.try_element_at(name, F.lit(i + 1))), F.lit(0)).alias(f"{name}{i}") for i in range(length)]

    widest = 1 + max(len(w.split()) for w in COMMON_WORDS.values())
    sums = sound.groupBy(F.col(lang).alias("_lang")).agg(*totals("classes", len(CLASSES) + 1), *totals("common", widest))
    sums = written(sums.select("_lang", F.array(*(f"classes{i}" for i in range(len(CLASSES) + 1))).alias("ref_classes"), F.array(*(f"common{i}" for i in range(widest))).alias("ref_common")))
    references = F.broadcast(sums) if sums.count() <= 10_000 else sums
    both = told.join(references, told[f"`{lang}`"].eqNullSafe(F.col("_lang")), "left")
    far_classes = F.when(F.col("n_words") >= LEAST_CLASSES, divergence(F.col("classes"), F.col("ref_classes")))
    named = F.size("common") > 1
    far_common = F.when((F.col("n_words") >= LEAST_COMMON) & named, divergence(F.col("common"), F.slice("ref_common", 1, F.size("common"))))
    out = both.withColumn("class_distance", F.round(far_classes, 6)).withColumn("common_distance", F.round(far_common, 6))
    kept = ~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASSES) & (F.coalesce("common_distance", F.lit(0.0)) <= MOST_COMMON)
    return out.select(key, "_mark", "_mark2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", kept.alias("kept"))


def keep_good(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that judge() keeps, all columns as they are."""
    gone = written(_judged(df, key, text, lang).filter("not kept").select(key, "_mark", "_mark2"))
    return by_rows(df, gone, key, text, lang, keep=False)


def oracle() -> str:
    """The same in DuckDB."""
    lists = " ".join(f"WHEN '{g}' THEN [{', '.join(repr(w) for w in dict.fromkeys(words.split()))}]" for g, words in COMMON_WORDS.items())
    patterns = [p.pattern for p in CLASSES]
    bins = ", ".join(f"length(regexp_replace(inked, '[^{p[1:-1].replace(chr(39), chr(39) * 2)}]', '', 'g'))" for p in patterns)
    widest = 1 + max(len(w.split()) for w in COMMON_WORDS.values())

    def distance(p: str, q: str) -> str:
        x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
        half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({x} + {y}) / 2)) ELSE 0 END"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({half(x)} + {half(y)}) / 2)))), 6) END"

    return f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS inked, CASE lang {lists} ELSE [] END AS listed
  FROM documents),
h AS (
  SELECT *, translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, [{bins}] AS bins FROM d),
lines AS (
  SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d))),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(5) r(k) WHERE c > 1 GROUP BY doc_id),
f AS (
  SELECT h.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, length(inked) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
         list_append(bins, length(inked) - CAST(list_sum(bins) AS BIGINT)) AS classes,
         list_transform(listed, lambda x: len(list_filter(string_split(low, ' '), lambda y: y = x))) AS hits
  FROM h LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
g AS (
  SELECT *, list_append(hits, n_words - coalesce(CAST(list_sum(hits) AS BIGINT), 0)) AS common, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f),
refs AS (
  SELECT lang, [{", ".join(f"sum(classes[{i + 1}])" for i in range(len(CLASSES) + 1))}] AS ref_classes, [{", ".join(f"coalesce(sum(common[{i + 1}]), 0)" for i in range(widest))}] AS ref_all
  FROM g WHERE NOT base_failed GROUP BY lang),
j AS (SELECT g.*, ref_classes, ref_all[1 : len(common)] AS ref_common FROM g LEFT JOIN refs ON g.lang IS NOT DISTINCT FROM refs.lang),
k AS (
  SELECT *, CASE WHEN n_words >= {LEAST_CLASSES} THEN {distance("classes", "ref_classes")} END AS class_distance,
         CASE WHEN n_words >= {LEAST_COMMON} AND len(common) > 1 THEN {distance("common", "ref_common")} END AS common_distance FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, common_distance,
       NOT base_failed AND coalesce(class_distance, 0) <= {MOST_CLASSES} AND coalesce(common_distance, 0) <= {MOST_COMMON} AS kept FROM k
"""
