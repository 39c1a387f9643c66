"""Near-duplicates by a chosen-path set similarity join (after Christiani, Pagh and Sivertsen, 2018).

Documents are sets of hashed word shingles, embedded in a fixed number of minwise tokens.  Nodes are groups of documents that
chose the same tokens along a path; the tokens that a node branches on follow from its path and from how many documents have
them, so all its documents choose alike, rare tokens first.  Small nodes are compared exhaustively, large ones branch again.  Independent
trees repeat this.

What would make hot groups quadratic is removed before: equal sets are one representative; a document of whose tokens too
few occur anywhere else has no partner, whatever long passage it shares, and goes before any branching; in each node
every document is first compared with the node's leader alone, what these verified links connect is one component, and only pairs
of different components are compared further.  Nodes that are still large at the last level are not compared
exhaustively: their documents go to an exact join on the rare ends of their sorted sets (prefix filtering), so nothing is
given up.  All comparisons estimate the similarity from the minwise tokens and confirm it on the full sets.

A pair of similarity 0.75 is missed if it shares too few of the root tokens (NEED of 24: 3 in a million), if its estimate
falls under LEAST_ESTIMATE (4.5 standard deviations), or if its choices part in all trees: 2 in a thousand where every other token
of theirs is shared with third documents and chosen first, else under 1 in 10000.  Large nodes that its documents stay in
to the last look miss nothing; those where they part by branching do with a chance of 1 in 16.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, WordHashes, by_rows, column, forget, marked, named_rows, one_each, row_count, same_row, shingle_set, written
from .components import components

#: Minwise tokens of a document.
TOKENS = 64
#: Trees, token positions of a root and those that a document branches on, branches below it, and levels.
TREES, ROOT_TOKENS, ROOT_BRANCHES, BRANCHES, LEVELS = 3, 8, 4, 2, 2
#: Root tokens that a document must have in common with any others to have a partner at all, and those in small nodes that suffice.
NEED, ENOUGH = 8, 8
#: A node is compared exhaustively with at most LEAF squared pairs, or LINEAR for each of its documents.
LEAF, LINEAR = 24, 4
#: Documents of a node that is branched on last.
LARGE = 64
#: Share of equal tokens from which a pair is confirmed: four and a half standard deviations under 0.75.
LEAST_ESTIMATE = 0.5

_RANDOM = np.random.Generator(np.random.PCG64(20180611))
_XOR = _RANDOM.integers(0, 1 << 63, TOKENS, np.uint64)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens (int32) of a non-empty set of hashes."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at : at + 2048, None] ^ _XOR) * _MULTIPLY).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(rows: DataFrame, text: str, size: int) -> DataFrame:
    """The other columns of ``rows``, n_shingles, set_id (a 128-bit digest of the set; null if empty), tokens (array<int>; null if empty)."""
    kept = [c for c in rows.columns if c != text]

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for table in tables:
            n, ids, tokens = [], [], []
            for t in table.column(text).to_pylist():
                found = shingle_set(t, memo, size)
                n.append(len(found))
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                tokens.append(minwise(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([*(table.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.list_(pa.int32()))], [*kept, "n_shingles", "set_id", "tokens"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_shingles bigint, set_id binary, tokens array<int>")


def _counted(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` whose path several documents have, with ``held``, their number, and ``large``: whether that is more than LARGE."""
    counts = written(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select(F.col("path").alias("_path"), "held", (F.col("held") > LARGE).alias("large")))
    return nodes.join(counts, F.col("path") == F.col("_path")).drop("_path")


def _roots(tokens: DataFrame) -> DataFrame:
    """(id, weight, path): the first nodes of all documents that may have a partner; ``weight``: how many share its tokens.

    First go those with too few root tokens that any other has, then, counted anew over all tokens, those with too few for the
    least estimate.  Who has ENOUGH root tokens in small nodes meets any partner there (but for a chance of
    0.25 to that power) and stays out of the large ones.
    """
    everywhere = tokens.select("id", F.posexplode(F.slice("tokens", 1, TREES * ROOT_TOKENS)).alias("place", "token")).select("id", F.xxhash64("place", "token").alias("path"))

    def in_tree(tree: int):
        return lambda x: x["from"] == tree

    some = written(_counted(everywhere).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= NEED).select("id"))
    again = tokens.join(some, "id").select("id", F.posexplode("tokens").alias("place", "token"))
    live = _counted(again.select("id", F.floor(F.col("place") / ROOT_TOKENS).alias("from"), F.xxhash64("place", "token").alias("path")))
    is_root = F.col("from") < TREES
    # small nodes come first, then a hash of the path decides, so documents that share paths choose alike
    place = F.struct("from", "large", F.xxhash64("path", F.lit(7)).alias("order"), "path")
    listed = live.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum((is_root & ~F.col("large")).cast("int")).alias("cold"), F.sum("held").alias("weight"), F.array_sort(F.collect_list(F.when(is_root, place))).alias("all"))
    listed = listed.filter(F.col("n") >= int(LEAST_ESTIMATE * TOKENS))
    able = F.filter("all", lambda x: (F.col("cold") < ENOUGH) | ~x["large"])
    listed = listed.withColumn("all", able)
    picked = F.concat(*(F.slice(F.filter("all", in_tree(tree)), 1, ROOT_BRANCHES) for tree in range(TREES)))
    return listed.select("id", "weight", F.explode(F.transform(picked, lambda x: x["path"])).alias("path"))


def _children(large: DataFrame, tokens: DataFrame, branches: int) -> DataFrame:
    """(id, weight, path): where the documents of large nodes go on; the node's path decides which tokens they branch on.

    Documents of similarity s stay together in s * branches children: fewer at each level below 1 / branches.
    """
    picks = [F.pmod(F.xxhash64("path", F.lit(j)), F.lit(TOKENS)).cast("int") for j in range(branches)]
    children = F.array_distinct(F.array(*(F.xxhash64("path", c, F.get("tokens", c)) for c in picks)))
    return large.join(tokens, "id").select("id", "weight", F.explode(children).alias("path"))


def _occupied(nodes: DataFrame) -> DataFrame:
    """The rows of nodes that hold several components, with what the node's comparison needs.

    n, cross (pairs of different components), major (its largest component) and leader (the most typical document outside that).
    """
    parts = written(nodes.groupBy("path", "component").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("weight", "id")).alias("typical")))
    n = F.sum("c")
    sizes = parts.groupBy("path").agg(n.alias("n"), ((n * n - F.sum(F.col("c") * F.col("c"))) / 2).alias("cross"), F.max(F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    sizes = sizes.select(F.col("path").alias("_path"), "n", "cross", F.col("most.component").alias("major"))
    others = parts.join(sizes, (F.col("path") == F.col("_path")) & (F.col("component") != F.col("major")))
    sizes = written(others.groupBy("_path", "n", "cross", "major").agg(F.max("typical").alias("typical")).withColumn("leader", F.col("typical.id")).drop("typical"))
    return nodes.join(sizes, F.col("path") == F.col("_path")).drop("_path")


def _relabelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with the components of ``labels``."""
    named = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return nodes.join(named, F.col("id") == F.col("_node"), "left").select("path", "id", "weight", F.coalesce("_component", "id").alias("component"))


def _likely(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b) whose share of equal tokens is at least LEAST_ESTIMATE."""
    one = tokens.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    two = tokens.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    same = F.aggregate(F.zip_with("ta", "tb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(one, "a").join(two, "b").filter(same >= int(LEAST_ESTIMATE * TOKENS)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        last, known = None, np.empty(0, np.uint64)
        for table in tables:
            keep = []
            for one, two in zip(table.column(2).to_pylist(), table.column(3).to_pylist(), strict=True):
                if one != last:
                    last, known = one, shingle_set(one, memo, size)
                other = shingle_set(two, memo, size)
                both = len(np.intersect1d(known, other, assume_unique=True))
                union = len(known) + len(other) - both
                keep.append(union > 0 and 100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([table.column(0), table.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(texts.dtypes)["id"]
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(work, f"a {kind}, b {kind}")


class _Sets:
    """The representatives of equal sets, and links between them."""

    def __init__(self, df: DataFrame, key: str, text: str, size: int, percent: int):
        self.df, self.key, self.text, self.size, self.percent = df, key, text, size, percent
        self.told = written(sketches(marked(df, key, text), text, size))
        least = F.min(F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), "_mark", "_mark2"))
        named = self.told.filter("set_id is not null").groupBy("set_id").agg(least.alias("least"), F.first("tokens").alias("tokens"))
        self.named = written(named.select("set_id", "least", "tokens", F.monotonically_increasing_id().alias("id")))
        self.tokens = self.named.select("id", "tokens")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the representatives in ``ids``, as often as their key and text are repeated."""
        rows = written(self.named.join(ids, "id", "left_semi").select("least.key", "least._mark", "least._mark2", "id"))
        named, names = named_rows(self.df, rows)
        side = F.broadcast(named) if row_count(rows) <= MOST_BROADCAST else named
        found = self.df.join(side, same_row(self.df, self.key, (self.text,), named, names))
        return written(found.select(F.col(names[3]).alias("id"), column(found, self.text).alias("text")))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The confirmed ones of ``pairs``."""
        pairs = written(_likely(pairs, self.tokens))
        texts = self.texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        found = written(confirmed(pairs, texts, self.size, self.percent))
        forget(texts)
        return found

    def shingles(self, rows: DataFrame) -> DataFrame:
        """(id, n, shingle, component): the full sets of ``rows`` (id, component)."""
        texts, size = self.texts(rows.select("id")), self.size

        def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = WordHashes()
            for table in tables:
                for key, text in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
                    found = shingle_set(text, memo, size)
                    for at in range(0, len(found), 20_000):
                        part = found[at : at + 20_000].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(np.full(len(part), len(found))), pa.array(part)], ["id", "n", "shingle"])

        out = written(texts.dropDuplicates(["id"]).select("id", "text").mapInArrow(work, "id bigint, n bigint, shingle bigint").join(rows, "id"))
        forget(texts)
        return out

    def possible(self, rows: DataFrame) -> DataFrame:
        """The shingles of those ``rows`` that have enough of them in common with other components to be linked with one: exact.

        What goes takes its shingles with it, so a second look sees more.
        """
        sets = self.shingles(rows)
        for _ in range(2):
            across = sets.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("shingle")
            live = sets.join(across, "shingle").groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).filter(100 * F.col("c") >= self.percent * F.col("n")).select("id")
            fewer = written(sets.join(live, "id", "left_semi"))
            forget(sets)
            sets = fewer
        return sets

    def exact_pairs(self, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components among ``sets`` (id, n, shingle, component) that may be similar, by prefix filtering: exact.

        Shingles are sorted: first those of one component only, which can't be common to two, then from rare to frequent.  If i and j
        are the places of the first common one in sets of n and m, at most ``1 + min(n - i, m - j)`` are common, and ``t / (1 + t)`` of
        ``n + m`` must be.  A passage shared by many sets stands at their ends, where no pair is made.
        """
        t = self.percent / (100 + self.percent)
        often = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), (F.min("component") < F.max("component")).alias("across"))
        ranked = sets.join(often, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("across", "df", "shingle")))
        ranked = written(ranked.filter((100 * (F.col("n") - F.col("place") + 1) >= self.percent * F.col("n")) & F.col("across")))
        probe = ranked.select("shingle", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.col("place").alias("px"))
        index = ranked.filter(F.col("n") - F.col("place") + 1 >= 2 * t * F.col("n") - 1e-6).select("shingle", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), F.col("place").alias("py"))
        smaller = (F.struct("ny", "y") < F.struct("nx", "x")) & (100 * F.col("ny") >= self.percent * F.col("nx")) & (F.col("cx") != F.col("cy"))
        enough = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= t * (F.col("nx") + F.col("ny")) - 1e-6
        meet = (index["shingle"] == probe["shingle"]) & smaller & enough
        return written(index.join(probe, meet).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _grouped(df: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """key, _mark, _mark2, n_shingles, component_id, kept of every row of ``df``; see near_groups()."""
    sets = _Sets(df, key, text, size, percent)
    told, named, tokens = sets.told, sets.named, sets.tokens

    nodes = written(_roots(tokens))
    final = components(_all_links(nodes, sets))

    groups = named.select("set_id", "least", "id").join(final, F.col("id") == F.col("node"), "left").select("set_id", "least", F.coalesce("component", "id").alias("component"))
    best = groups.groupBy("component").agg(F.min(F.struct("least.no_key", "least.key", "set_id")).alias("best"))
    # another key than the aggregate's: the join then has exchanges right below it on both sides, and AQE can split a hot component
    best = best.select(F.col("component").bitwiseXOR(F.lit(1)).alias("_key"), "best")
    groups = written(groups.join(best, F.col("component").bitwiseXOR(F.lit(1)) == F.col("_key")).select(F.col("set_id").alias("_set"), "best"))
    forget(nodes)
    rows = told.join(groups, F.col("set_id") == F.col("_set"), "left")
    component = F.when(F.col("best").isNull(), F.col(key)).otherwise(F.col("best.key"))
    kept = F.col("best").isNull() | (F.col("best.key").eqNullSafe(F.col(key)) & (F.col("best.set_id") == F.col("set_id")))
    return rows.select(key, "_mark", "_mark2", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``df``: key, n_shingles, component_id, kept.

    Two texts are linked when ``100 * |A and B| >= percent * |A or B|`` for their sets of distinct ``size``-word
    shingles (A-Z lower-cased; a shorter text is one shingle; a null or empty one has none, is linked
    with nothing and kept).  ``component_id`` is the smallest key reached, null where none of the group has a key; the
    row with that key is kept, of several texts with it (or without keys) that of the least digest.  Rows that repeat key and
    text are alike: all kept or none.  A very long text is one row of 64 tokens like any other; its whole set is compared.
    An empty table gives none.

    Shuffled are narrow rows (path, number), minwise tokens of the representatives, and the texts of documents that have a
    likely partner.  No node is gathered in one task unless it is small; sizes and leaders are pre-aggregated.
    """
    return _grouped(df, key, text, size, percent).select(key, "n_shingles", "component_id", "kept")


def _all_links(nodes: DataFrame, sets: _Sets) -> DataFrame:
    """Links (a, b) that connect what is similar: from leaders, small nodes, branches of large ones, and the exact join at last.

    The leaders' links are confirmed first: what they connect needs no other comparison.
    """
    leaders = written(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("weight", "id")).alias("typical")).filter("n > 1").select(F.col("path").alias("_path"), F.col("typical.id").alias("leader")))
    links = sets.links(_stars(nodes.join(leaders, F.col("path") == F.col("_path"))).distinct())
    forget(leaders)
    labels = components(links)
    found: DataFrame | None = None
    full: DataFrame | None = None
    for level in range(LEVELS):
        rows = written(_occupied(_relabelled(nodes, labels)))
        # a node is small if its comparisons are few, or few for each of its documents
        is_small = F.col("cross") <= F.greatest(F.lit(LEAF * LEAF), LINEAR * F.col("n"))
        small, large = rows.filter(is_small), rows.filter(~is_small)
        # whoever isn't of the largest component meets all of another one; the largest never meets itself
        outside = small.filter("component != major").select("path", F.col("id").alias("x"), "component")
        other = small.select("path", F.col("id").alias("y"), F.col("component").alias("other"))
        pairs = outside.join(other, "path").filter("component != other").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        if level < LEVELS - 1:  # at the last one the exact join sees to large nodes
            pairs = pairs.union(_stars(large))
        found = pairs if found is None else found.union(pairs)
        if large.isEmpty():
            break
        if level == 0:
            full = sets.possible(large.select("id", "component").distinct())
            large = large.join(full.select("id").distinct(), "id", "left_semi")
        if level == LEVELS - 1:
            found = found.union(sets.exact_pairs(full.join(large.select("id").distinct(), "id", "left_semi")))
            break
        nodes = written(_children(large, sets.tokens, BRANCHES))
    return links.union(sets.links(found.distinct()))


def _stars(rows: DataFrame) -> DataFrame:
    """Each row's document with its node's leader."""
    return rows.filter("id != leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``df`` that near_groups() keeps, all columns as they are; of rows that repeat key and text one."""
    gone = written(_grouped(df, key, text, size, percent).filter("not kept").select(key, "_mark", "_mark2"))
    return one_each(by_rows(df, gone, key, text, keep=False), key, text)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingles
  FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON other = a)
SELECT r.doc_id, n.n AS n_shingles, r.component_id, r.doc_id = r.component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r JOIN n USING (doc_id)
"""
