"""What the corpus operators share: shared-folder tables, safe column names, word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut as written
from ..functions.lineage import forget, shared_dir

#: The characters that separate words, as a character class of Java, Python and RE2 alike.
BLANK = r"[\x20\x09-\x0D]"
#: The same characters for translate().
BLANK_CHARS = " \t\n\x0b\x0c\r"


def column(df: DataFrame, name: str):
    """The column ``name``, matched exactly, also when ``df`` has another one that differs only by case or has dots."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return df[f"`{name}`"]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def base(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with those made later."""
    return df.select(*(column(df, n).alias(n) for n in names))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) over an array of uint64."""
    v = values.copy()
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


class WordHashes(dict):
    """bytes -> 64-bit hash, the same in every process; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every window of ``size`` words, from the words' hashes."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    acc = words[:n].copy()
    for k in range(1, size):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
        acc += words[k : k + n]
    return mixed(acc)


def shingle_set(text: str | None, memo: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of ``text``, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words, memo)
    return np.unique(window_hashes(hashes, size)) if len(words) >= size else mixed(window_hashes(hashes, len(words)) + np.uint64(len(words)))


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


#: Most rows of a side that is broadcast after it was counted: ids of a few numbers each.
MOST_BROADCAST = 1_000_000


def marks(*texts: Column) -> list[Column]:
    """Two hashes (96 bits) of texts, null as empty: with the key they tell rows apart whose keys are null or repeated."""
    whole = [F.coalesce(t, F.lit("")) for t in texts]
    return [F.xxhash64(*whole), F.hash(*whole)]


def marked(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """key, the texts, _mark, _mark2."""
    one, two = marks(*(column(df, t) for t in texts))
    return df.select(column(df, key).alias(key), *(column(df, t).alias(t) for t in texts), one.alias("_mark"), two.alias("_mark2"))


def named_rows(df: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` (key, _mark, _mark2, and more) with names that ``df`` doesn't have."""
    names = [fresh(df, n) for n in ("_key", "_mark", "_mark2", *(f"_{c}" for c in rows.columns[3:]))]
    return rows.toDF(*names), names


def same_row(df: DataFrame, key: str, texts: tuple[str, ...], side: DataFrame, names: list[str]) -> Column:
    """Whether a row of ``df`` is the one that ``names`` (key, _mark, _mark2) of ``side`` tell; null keys equal each other."""
    one, two = marks(*(column(df, t) for t in texts))
    return column(df, key).eqNullSafe(side[names[0]]) & (one == side[names[1]]) & (two == side[names[2]])


def by_rows(df: DataFrame, rows: DataFrame, key: str, *texts: str, keep: bool) -> DataFrame:
    """The rows of ``df`` that are (``keep``) or aren't among ``rows`` (key, _mark, _mark2).

    They are broadcast only when counted to be at most MOST_BROADCAST; more are joined by a shuffle.
    """
    named, names = named_rows(df, rows)
    side = named.distinct()
    side = F.broadcast(side) if row_count(rows) <= MOST_BROADCAST else side
    return df.join(side, same_row(df, key, texts, named, names), "left_semi" if keep else "left_anti")


def one_each(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` without the further copies of rows that repeat key and text; shuffles only those that do."""
    rows = marked(df, key, text).select(key, "_mark", "_mark2")
    twice = written(rows.groupBy(key, "_mark", "_mark2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if twice.isEmpty():
        return df
    at, one, two = (fresh(df, n) for n in ("_at", "_one", "_two"))
    hits = by_rows(df, twice, key, text, keep=True)
    hits = hits.select("*", column(hits, key).alias(at), *(m.alias(n) for m, n in zip(marks(column(hits, text)), (one, two), strict=True)))
    return by_rows(df, twice, key, text, keep=False).unionByName(hits.dropDuplicates([at, one, two]).drop(at, one, two))


def by_ids(df: DataFrame, ids: DataFrame, key: str, keep: bool, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of ``df`` whose key is (``keep``) or isn't in the one column of ``ids``; nulls equal nulls.

    The ids are broadcast only when counted to be at most ``most_broadcast`` (8 MB of longs); more are joined by a shuffle.
    """
    name = fresh(df, "_id")
    named = ids.toDF(name).distinct()
    side = F.broadcast(named) if row_count(ids) <= most_broadcast else named
    return df.join(side, column(df, key).eqNullSafe(named[name]), "left_semi" if keep else "left_anti")

