"""Full-text index and column-weighted BM25 over DataFrames.

Postings are (term, id, field, tf, positions); a query is a handful of phrases, broadcast to the postings.  Everything per query is one job,
however many query strings there are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens, snippet
from ..lexicon import CHINESE, LanguagePack

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
CHUNK_WEIGHTS = {"title": 4.0, "search_text": 1.5, "chunk_text": 1.0, "source": 0.5, "topics": 0.8}
#: Longest query and hits of one query string.
QUERY_TOKENS, HITS = 12, 60


def postings(df: DataFrame, key: str, fields: list[str], terms: DataFrame | None = None) -> DataFrame:
    """(key, field, term, tf, positions), one row per term of each field; of ``terms`` (term; a query's, so few) only, if given."""
    tokens = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), index_tokens(F.col(f)).alias("tokens")) for f in fields)))
    places = df.select(key, tokens.alias("t")).select(key, "t.field", F.posexplode("t.tokens").alias("position", "term"))
    if terms is not None:
        places = places.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    return places.groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def term_counts(df: DataFrame, key: str, fields: list[str], terms: DataFrame | None = None) -> DataFrame:
    """(key, field, term, tf): postings() without positions, which is all that phrases of one term need."""
    tokens = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), index_tokens(F.col(f)).alias("tokens")) for f in fields)))
    places = df.select(key, tokens.alias("t")).select(key, "t.field", F.explode("t.tokens").alias("term"))
    if terms is not None:
        places = places.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    return places.groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, length): tokens of all fields."""
    total = sum((F.size(index_tokens(F.col(f))) for f in fields), F.lit(0))
    return df.select(key, total.cast("bigint").alias("length"))


def query_phrases(query: str, pack: LanguagePack = CHINESE, most: int = QUERY_TOKENS) -> list[list[str]]:
    """The phrases, joined by OR, of a query string: its tokens, each a phrase of index tokens (``a_b`` is two)."""
    tokens = re.findall(pack.tokens, query)[:most] or [query.strip()]
    phrases = [re.findall(r"[^\W_]+", t.lower()) for t in tokens]
    return list(map(list, dict.fromkeys(tuple(p) for p in phrases if p)))


def queries_frame(spark, queries: dict[int, str], pack: LanguagePack = CHINESE) -> DataFrame:
    """(query_id, phrase_id, place, term, size) of a few query strings: a table of tens of rows, fit to broadcast."""
    rows = [(q, n, i, term, len(p)) for q, text in queries.items() for n, p in enumerate(query_phrases(text, pack)) for i, term in enumerate(p)]
    return spark.createDataFrame(rows, "query_id bigint, phrase_id int, place int, term string, size int")


def phrase_counts(index: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """(query_id, phrase_id, key, field, tf): occurrences of whole phrases, each term one behind the other in one field.

    An ``index`` without positions (term_counts) is for phrases of one term.
    """
    hits = index.join(F.broadcast(phrases), "term")
    single = hits.filter("size = 1").select("query_id", "phrase_id", key, "field", F.col("tf").cast("bigint").alias("tf"))
    if "positions" not in index.columns:
        return single
    starts = hits.filter("size > 1").select("query_id", "phrase_id", key, "field", "size", F.explode(F.transform("positions", lambda p: p - F.col("place"))).alias("start"))
    whole = starts.groupBy("query_id", "phrase_id", key, "field", "size", "start").count().filter("count = size")
    return single.unionByName(whole.groupBy("query_id", "phrase_id", key, "field").agg(F.count(F.lit(1)).alias("tf")))


def bm25(index: DataFrame, sizes: DataFrame, phrases: DataFrame, key: str, weights: dict[str, float], corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, key, rank): the negated BM25 score, lower is better, as full-text indexes give it.

    The frequency of a phrase is the weighted sum over fields; a phrase's inverse document frequency counts the rows with it in any field.
    ``corpus`` (n_rows, average), one row, is counted from ``sizes`` unless given.
    """
    weight = F.lit(0.0)
    for field, w in weights.items():
        weight = F.when(F.col("field") == field, F.lit(float(w))).otherwise(weight)
    # each phrase is found and scored once, however many queries have it; then each query adds up its own
    told = phrases.groupBy("query_id", "phrase_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", "size"))).alias("words"))
    told = told.select("query_id", F.array_join("words.term", " ").alias("phrase"), "words")
    once = told.groupBy("phrase").agg(F.first("words").alias("words")).select(F.lit(0).alias("query_id"), F.col("phrase").alias("phrase_id"), F.inline("words"))
    found = phrase_counts(index, once, key).groupBy("phrase_id", key).agg(F.sum(weight * F.col("tf")).alias("f"))
    corpus = corpus or sizes.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("length").alias("average"))
    counts = found.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("n_with"))
    idf = F.log((F.col("n_rows") - F.col("n_with") + 0.5) / (F.col("n_with") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    # one row of corpus statistics and one row per phrase: bounded by the query
    scored = found.join(F.broadcast(counts), "phrase_id").join(sizes, key).crossJoin(F.broadcast(corpus)).select("phrase_id", key, part.alias("part"))
    asked = told.select("query_id", F.col("phrase").alias("phrase_id"))
    return scored.join(F.broadcast(asked), "phrase_id").groupBy("query_id", key).agg((-F.sum("part")).alias("rank"))


def top_hits(ranks: DataFrame, key: str, most: int = HITS) -> DataFrame:
    """The ``most`` best rows of every query string, ties by key."""
    order = Window.partitionBy("query_id").orderBy("rank", key)
    return ranks.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def base_score(rank: Column) -> Column:
    return F.greatest(F.lit(0.1), -rank) + 0.4


def hit_snippet(chunk_text: Column, body: Column, term: Column) -> Column:
    return F.coalesce(F.nullif(snippet(chunk_text, term), F.lit("")), F.nullif(chunk_text, F.lit("")), F.substring(body, 1, 180))
