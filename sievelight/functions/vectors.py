"""Hash embeddings and vector arithmetic over arrays."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bound
from .text import CJK

DIMENSIONS, VERSION = 128, 2


def dot(a: Column, b: Column) -> Column:
    """The dot product; 0 where lengths differ or one is null or empty."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(0.0)


def normalised(v: Column, digits: int = 6) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: F.round(x / norm, digits))).otherwise(v)


def _run_terms(run: str) -> Iterator[str]:
    """What text.run_terms has of a run, without single characters."""
    if 2 <= len(run) <= 8:
        yield run
    for n in (2, 3, 4):
        yield from (run[i : i + n] for i in range(len(run) - n + 1))


def hash_tokens(text: str) -> Iterator[str]:
    """Latin tokens, runs and n-grams of CJK, of two characters or more; the runs count twice, as both passes see them."""
    yield from map(str.lower, re.findall(r"[A-Za-z0-9_]{2,}", text))
    for run in re.findall(f"{CJK}+", text):
        yield from _run_terms(run)
    for run in re.findall(f"{CJK}{{2,24}}", text):
        yield from _run_terms(run)


@lru_cache(100_000)
def _placed(token: str) -> tuple[int, float]:
    digest = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(digest[:4], "big"), -1.0 if digest[4] % 2 else 1.0


def hash_embeddings(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector): signed log-counts of hashed tokens, L2-normalised and rounded.

    Index and sign come from the SHA-256 of a token; all is counted within the row, without a shuffle.  A text without
    tokens has the zero vector.
    """

    def sums(text: str | None) -> list[float]:
        out = [0.0] * dimensions
        for token, n in Counter(hash_tokens(text or "")).items():
            number, sign = _placed(token)
            out[number % dimensions] += sign * math.log1p(n)
        return out

    made = df.select(key, F.udf(sums, "array<double>", useArrow=False)(F.col(text)).alias("_sums"))
    norm = F.nullif(F.sqrt(F.aggregate("_sums", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))
    # F.round is that of the SQL, which Python's isn't
    return made.select(key, bound(norm, lambda n: F.transform("_sums", lambda x: F.coalesce(F.round(x / n, 6), F.lit(0.0)))).alias("vector"))


def is_current(embedding: Column, provider: str, model: str, dimensions: int = DIMENSIONS) -> Column:
    """Whether a stored embedding struct has the present signature."""
    same = (embedding["provider"] == provider) & (embedding["model"] == model) & (embedding["dim"] == dimensions) & (embedding["version"] == VERSION)
    return F.coalesce(same & embedding["vector"].isNotNull(), F.lit(False))


def embedding_text(labelled: dict[str, Column], longest: int = 2400) -> Column:
    """The labelled lines that are embedded of a chunk."""
    return F.substring(F.concat_ws("\n", *(F.concat(F.lit(f"{name} "), F.coalesce(value, F.lit(""))) for name, value in labelled.items())), 1, longest)
