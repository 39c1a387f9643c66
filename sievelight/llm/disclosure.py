"""Personal data and the terms that give it away, in DataFrame functions only.

Formats (e-mail, IP address, card, phone) are found first; each distinct value is a protected entity.  Then, after the
information-theoretic sanitisation of Sanchez and Batet, the corpus says how much a term of an entity's text reveals of it: with p as shares
of distinct texts, PMI(c; t) = log2 p(c, t) / (p(c) p(t)) against IC(c) = -log2 p(c), all that there is to know about c.  A term with
PMI >= DISCLOSURE * IC(c) exceeds the threshold; in the documents that hold the entity its occurrences are spans, too, and ``sanitised``
generalises them like the entity.  A value too rare for statistics is counted as its class (domain, prefix), or else as its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, by_ids, column, marked, named_rows, same_row, written
from .spans import SPAN, masked, matches, no_spans

#: The kinds in their order.  Look-behinds and possessive quantifiers only keep the search linear; the matches are those of the plain patterns.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Share of an entity's information from which a term discloses it, and least distinct texts for statistics of an entity and of a pair:
#: what met only once may have met by chance, and nothing in the corpus tells.
DISCLOSURE, LEAST_TEXTS, LEAST_BOTH = 0.9, 3, 2
#: What a term is.
TERM = r"[\p{L}\p{N}]{2,}"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the check digit of Luhn's rule."""
    reverse = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """An array of (start, end, value, kind): kind is the place in KINDS; sorted by start, then kind."""

    def kind(n: int, maybe: Column, pattern: str, good=None) -> Column:
        found = F.when(maybe, matches(text, pattern)).otherwise(no_spans())
        found = F.filter(found, lambda x: good(x["value"])) if good else found
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    def is_card(v: Column) -> Column:
        return F.length(_digits(v)).between(14, 19) & luhn(_digits(v))

    return F.array_sort(
        F.concat(
            kind(0, F.contains(text, F.lit("@")), EMAIL),
            kind(1, F.rlike(text, F.lit(IP)), IP, lambda v: F.rlike(v, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))),
            kind(2, F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")), CARD, is_card),
            kind(3, F.contains(text, F.lit("+")), PHONE, lambda v: F.length(_digits(v)).between(10, 15)),
        )
    )


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _classes(kind: Column, value: Column) -> Column:
    """What a value is of: an e-mail's domain, an IP address's first two numbers, a card's first six digits, a phone number's first three."""
    return F.concat(
        F.get(F.array(*map(F.lit, KINDS)), kind),
        F.lit("/"),
        F.when(kind == 0, F.lower(F.substring_index(value, "@", -1))).when(kind == 1, F.substring_index(value, ".", 2)).when(kind == 2, F.substring(_digits(value), 1, 6)).otherwise(F.substring(_digits(value), 1, 3)),
    )


def _texts(seen: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """(text_id, text): each distinct text of ``df`` once; only texts that have copies are shuffled."""
    doubled = written(seen.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_id"))
    everything = df.select(F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
    return by_ids(everything, doubled, "text_id", keep=False).unionByName(by_ids(everything, doubled, "text_id", keep=True).dropDuplicates(["text_id"]))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing_terms(seen: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """(text_id, term): the terms of each text that are over the threshold for an entity of it.

    ``seen``: text_id, spans of all documents, and text of those with entities; ``df``: all documents.  A value found in fewer than
    LEAST_TEXTS distinct texts is counted as its class, or else as its kind; where that is too rare, too, nothing is known of it.
    """
    found = seen.filter("text is not null").dropDuplicates(["text_id"])
    kinds = F.array(*map(F.lit, KINDS))
    s = F.col("s")
    entities = written(found.select("text_id", F.explode("spans").alias("s")).select("text_id", F.get(kinds, s["kind"]).alias("kind"), _classes(s["kind"], s["value"]).alias("class"), F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("value")).distinct())

    def often(name: str) -> DataFrame:
        counts = entities.select(name, "text_id").distinct().groupBy(name).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        return written(counts.filter(F.col(f"n_{name}") >= LEAST_TEXTS))

    known = entities.join(often("value"), "value", "left").join(often("class"), "class", "left").join(F.broadcast(often("kind")), "kind", "left")
    names = [F.when(F.col(f"n_{n}").isNotNull(), F.struct(F.col(n).alias("entity"), F.col(f"n_{n}").alias("n_entity"))) for n in ("value", "class", "kind")]
    held = written(known.select("text_id", F.coalesce(*names).alias("e")).filter("e is not null").select("text_id", "e.entity", "e.n_entity").distinct())
    if held.isEmpty():
        return held.select("text_id", F.col("entity").alias("term"))
    met = written(held.join(found.select("text_id", F.explode(_words(F.col("text"))).alias("term")), "text_id"))
    pairs = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_entity").alias("n_entity")).filter(F.col("n_both") >= LEAST_BOTH)
    total = seen.select("text_id").distinct().count()
    n_term = _texts(seen, df, text).select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    over = written(pairs.join(n_term, "term").filter((information > 0) & (mutual >= DISCLOSURE * information)).select("entity", "term"))
    return written(met.join(over, ["entity", "term"]).select("text_id", "term").distinct())


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, spans and all_spans, arrays of (start, kind, end, value) sorted by start and kind.

    ``spans`` has the formats, ``all_spans`` the disclosing terms, too, but for those inside a format.  Null text counts as empty and has
    none.  Repeated rows have the same spans and count once in the corpus statistics, as do all equal texts.  Keys, null or repeated,
    play no part.  Places in very long texts with very many matches are counted in blocks.  An empty table gives none.
    """
    return _found(df, key, text).drop("_mark", "_mark2")


def _found(df: DataFrame, key: str, text: str) -> DataFrame:
    """find() with _mark and _mark2 of every row."""
    rows = marked(df, key, text).withColumn(text, F.coalesce(text, F.lit("")))
    seen = rows.select(F.col(key), "_mark", "_mark2", F.xxhash64(text).alias("text_id"), base_spans(F.col(text)).alias("spans"), F.col(text).alias("text"))
    seen = written(seen.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))))
    told = disclosing_terms(seen, rows, text)
    if told.isEmpty():
        return seen.select(key, "_mark", "_mark2", "spans", F.col("spans").alias("all_spans"))
    terms = told.groupBy("text_id").agg(F.collect_set("term").alias("terms"))
    words = F.filter(matches(F.col("text"), TERM), lambda w: F.array_contains("terms", F.lower(w["value"])))
    marks = F.transform(words, lambda w: F.struct(w["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), w["end"].alias("end"), w["value"].alias("value")))
    outside = F.filter(marks, lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    more = seen.filter("text is not null").dropDuplicates(["text_id"]).join(terms, "text_id").select(F.col("text_id").alias("_text_id"), outside.alias("extra"))
    out = seen.join(written(more), F.col("text_id") == F.col("_text_id"), "left")
    return out.select(key, "_mark", "_mark2", "spans", F.array_sort(F.concat("spans", F.coalesce("extra", F.slice("spans", 1, 0)))).alias("all_spans"))


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """find() as counts and digests: key, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""

    def count(name: str, n: int) -> Column:
        return F.size(F.filter(name, lambda s: s["kind"] == n)).cast("bigint")

    counts = [count("all_spans", n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return find(df, key, text).select(key, *counts, F.sha2(F.encode(told(F.col("spans")), "UTF-8"), 256).alias("base_sha256"), told(F.col("all_spans")).alias("spans"))


def sanitised(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every span in the text replaced by the upper-case name of its kind in brackets; rows without spans as they are.

    Every row stays once, also with a null or repeated key: spans belong to (key, text).
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    spans = written(_found(df, key, text).filter(F.size("all_spans") > 0).select(key, "_mark", "_mark2", F.transform("all_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("spans")).dropDuplicates([key, "_mark", "_mark2"]))
    named, marks = named_rows(df, spans)
    few = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) + spans.count() <= MOST_BROADCAST
    both = df.join(F.broadcast(named) if few else named, same_row(df, key, (text,), named, marks), "left")
    held = F.col(marks[3])
    new = F.when(held.isNull(), column(both, text)).otherwise(masked(column(both, text), held, lambda s: F.get(names, s["kind"])))
    return both.select(*(new.alias(c) if c == text else column(both, c).alias(c) for c in df.columns))


__all__ = ["SPAN", "disclosing_terms", "find", "report", "sanitised"]
