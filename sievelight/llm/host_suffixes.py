"""Main text of web pages: markup, and long token runs that a host repeats.

A page is read into blocks in page order.  Blocks whose markup says what they are (menus, footers, adverts, forms, scripts, comments)
go.  About all others the host decides, by what its distinct pages repeat (equal pages, mirrors, count once):

* whole blocks are counted over all pages of the host.  Outside an article container, a block on PAGES distinct pages is
  boilerplate; inside one, only a notice on nearly every page, since articles of one host do share passages.
* in blocks outside containers, runs inside differing blocks are found by suffix arrays: the token streams of a bounded group of
  the host's pages are concatenated, all suffixes sorted, and substrings of at least LEAST tokens that recur on PAGES
  distinct pages are covered.  Covered runs go, unique runs stay.  A host of more pages has several groups, whose counts are
  summed: suffixes that begin with the same LEAST tokens are neighbours in a group's array, each such prefix goes out once with
  its pages, and all groups learn which of theirs recur on the host.  Every longer run is covered by its parts of LEAST tokens,
  so what goes doesn't depend on how pages are dealt.

A page of which nothing would be left stays as it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import base, row_count, window_hashes, written

#: Fixed values of HTML: elements that hold no text of the page, that are furniture, that have no content, that part blocks.
SILENT = set("script style noscript template svg math canvas iframe object embed audio video head title textarea select option datalist map".split())
FURNITURE = set("nav header footer aside form button menu dialog fieldset label input legend".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An element's end that HTML lets go unwritten: it ends where one of these begins.
IMPLIED_END = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words of class, id and role that name furniture, and article containers.
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side-bar|aside|widget|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|more-stories|comments?|commentlist|comment-list|respond|disqus|replies|reply|discussion|complementary|contentinfo|search|toolbar|pagination|pager|skip-link|copyright|disclaimer|legal)(?:$|[\s_-])"
)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|article-body|article-content|post|post-body|post-content|entry|entry-content|main|main-content|content|story|story-body)(?:$|[\s_-])")

#: Inside an article its own header is no furniture.
OWN_HEADER = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead)(?=$|[\s_-])")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|$))""", re.I)
SPACE = re.compile(r"\s+")

#: Tokens of a repeated run, and distinct pages that must have it; inside an article container, pages and their share of the host's.
LEAST, PAGES, NOTICE_PAGES, NOTICE_SHARE = 8, 3, 16, 0.8
#: Pages of a group: a hot host is dealt over as many groups as it needs.
GROUP = 128
#: Most rows of a table of hosts, blocks or copied pages that is broadcast.
MOST_HOSTS = 500_000


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, sure) of each block in page order, without furniture; ``sure`` inside an article container."""
    out: list[tuple[str, bool]] = []
    run: list[str] = []
    # element, whether it or one around it is furniture or silent, whether inside an article, how many entries up to the last block element
    stack: list[tuple[str, bool, bool, int]] = []
    opened: Counter[str] = Counter()
    hidden = in_article = keep_space = False

    def flush() -> None:
        if run:
            text = SPACE.sub(" ", "".join(run)).strip()
            run.clear()
            if text:
                out.append((text, in_article))

    def pop(to: int) -> None:
        nonlocal hidden, in_article
        opened.subtract(x[0] for x in stack[to:])
        del stack[to:]
        hidden, in_article = stack[-1][1:3] if stack else (False, False)

    at, raw_end = 0, None
    lower = None
    while at < len(page):
        m = TAG.search(page, at)
        begin = m.start() if m else len(page)
        if begin > at and not hidden:
            run.append(html.unescape(page[at:begin]))
        if not m:
            break
        at = m.end()
        end_tag, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5] or "", m[6] or "")
        name = name.lower()
        if not name:
            continue
        if end_tag:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[name] > 0 else ():
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in ("article", "main", "body") and name not in BLOCKS:
                    break
            continue
        if name in BLOCKS or name == "br":
            if name == "br":
                run.append(" ")
            else:
                flush()
                while stack and name in IMPLIED_END.get(stack[-1][0], ()):
                    pop(len(stack) - 1)
                k = stack[-1][3] - 1 if stack else -1  # an open p with inline elements inside ends, too
                if k >= 0 and stack[k][0] == "p" and name in IMPLIED_END["p"]:
                    pop(k)
        if name in VOID:
            continue
        if name in SILENT and name not in ("svg", "math", "canvas", "object", "video", "audio", "head", "map", "select", "datalist"):
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{name}", at)  # its content is no markup
            if end < 0:
                break
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            continue
        told = " ".join((v or "").strip("\"'").lower() if k.lower() in ("class", "id", "role") else f"{k}={v}".lower() for k, v in ATTRIBUTE.findall(attributes)) if attributes else ""
        inner = in_article or name in ("article", "main") or bool(told and name in ("div", "section", "td") and ARTICLE_NAMES.search(told))
        # a header inside an article is the article's own
        furniture = name in SILENT or (name in FURNITURE and not (name == "header" and in_article)) or bool(told and name not in ("html", "body", "article", "main") and (FURNITURE_NAMES.search(OWN_HEADER.sub("", told) if in_article else told) or "aria-hidden=\"true\"" in told or "hidden=" in told.replace("aria-hidden=", "") or "display:none" in told.replace(" ", "")))
        if name == "article" and told and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", told):
            furniture = True
        if furniture and name not in BLOCKS:
            run.append(" ")
        hidden, in_article = hidden or furniture, inner
        stack.append((name, hidden, inner, len(stack) + 1 if name in BLOCKS else stack[-1][3] if stack else 0))
        opened[name] += 1
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``tokens`` in order, and the tokens that each has in common with the one before it (Kasai and others, 2001)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    while step < n and rank.max() < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.argsort(rank, kind="stable")
    common, flat, where, places = [0] * n, tokens.tolist(), rank.tolist(), order.tolist()
    held = 0
    for i in range(n):
        if where[i]:
            j = places[where[i] - 1]
            while i + held < n and j + held < n and flat[i + held] == flat[j + held]:
                held += 1
            common[where[i]] = held
            held = max(0, held - 1)
        else:
            held = 0
    return order, np.array(common, np.int64)


def streamed(pages: list[list[list[str]]]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The ids of all tokens, from 1 on; the pages' tokens as one stream, each block with a separator of its own, so that no run crosses it; each place's page."""
    ids: dict[str, int] = {}
    stream: list[int] = []
    owner: list[int] = []
    ends = 0
    for number, page in enumerate(pages):
        for tokens in page:
            ends += 1
            stream += [*(ids.setdefault(t, len(ids) + 1) for t in tokens), -ends]
            owner += [number] * (len(tokens) + 1)
    return ids, np.array(stream, np.int64), np.array(owner, np.int64)


def parted(inside: list[bool], pages: list[list[list[str]]]) -> list[list[list[bool]]]:
    """The values of a stream's places by page, block and token."""
    out, at = [], 0
    for page in pages:
        out.append([])
        for tokens in page:
            out[-1].append(inside[at : at + len(tokens)])
            at += len(tokens) + 1
    return out


def prefixes(ids: dict[str, int], stream: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places where ``least`` tokens of one block begin, and two hashes (96 bits) of these tokens."""
    import xxhash

    digests = [0, *(xxhash.xxh3_128_intdigest(t.encode("utf-8", "surrogatepass")) for t in ids)]
    one = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64)
    two = np.array([d >> 64 for d in digests], np.uint64)
    at = np.maximum(stream, 0)
    ends = np.flatnonzero(stream < 0)
    places = np.arange(max(0, len(stream) - least + 1))
    places = places[ends[np.searchsorted(ends, places)] - places >= least]
    return places, window_hashes(one[at], least)[places].view(np.int64), (window_hashes(two[at], least)[places] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def counted(pages: list[list[list[str]]], same: list, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct substring of ``least`` tokens once: its two hashes and the number of distinct pages that have it.

    ``same``: pages with equal values are one page.
    """
    ids, stream, owner = streamed(pages)
    places, one, two = prefixes(ids, stream, least)
    if not len(places):
        return one, two, np.empty(0, np.int64)
    numbers = np.unique(np.array(same), return_inverse=True)[1].astype(np.int64)
    order, common = suffix_array(stream)
    begins = common < least  # a suffix that shares fewer tokens with the one before it begins another prefix
    begins[0] = True
    prefix = np.cumsum(begins) - 1
    held = np.unique(prefix * len(pages) + numbers[owner[order]])
    n = np.bincount(held // len(pages))
    first = order[begins]
    at = np.searchsorted(places, first)
    whole = places[np.minimum(at, len(places) - 1)] == first
    return one[at[whole]], two[at[whole]], n[whole]


def covered(pages: list[list[list[str]]], known: set[tuple[int, int]], least: int = LEAST) -> list[list[list[bool]]]:
    """For each page, block and token: is it in a substring of ``least`` tokens whose two hashes are ``known``?"""
    ids, stream, _ = streamed(pages)
    places, one, two = prefixes(ids, stream, least)
    hits = places[np.fromiter((k in known for k in zip(one.tolist(), two.tolist(), strict=True)), bool, len(places))]
    cover = np.zeros(len(stream) + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + least, -1)
    return parted((np.cumsum(cover) > 0).tolist(), pages)


def repeated(pages: list[list[list[str]]], same: list, least: int = LEAST, count: int = PAGES) -> list[list[list[bool]]]:
    """For each page, block and token: is it covered by a substring of at least ``least`` tokens that recurs on ``count`` distinct pages?

    ``same``: pages with equal values are one page.
    """
    numbers = {v: i for i, v in enumerate(dict.fromkeys(same))}
    _, tokens, owner = streamed(pages)
    stream = tokens.tolist()
    cover = np.zeros(len(stream) + 1, np.int64)
    if stream and len(numbers) >= count:
        order, common = suffix_array(tokens)
        # the narrowest windows of the order with suffixes of ``count`` pages: what all in it have in common recurs on these
        own = np.array([numbers[v] for v in same])[owner[order]].tolist()
        shared = common.tolist()
        held: Counter[int] = Counter()
        low, longest = 0, np.zeros(len(stream), np.int64)
        for high, page in enumerate(own):
            held[page] += 1
            while len(held) > count or held[own[low]] > 1:
                held[own[low]] -= 1
                if not held[own[low]]:
                    del held[own[low]]
                low += 1
            if len(held) == count and high > low:
                length = min(shared[low + 1 : high + 1])
                if length >= least:
                    window = order[low : high + 1]
                    longest[window] = np.maximum(longest[window], length)
        hits = np.flatnonzero(longest)
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + longest[hits], -1)
        # further suffixes of a page beside those in a narrowest window have what their neighbours have
        inside = (np.cumsum(cover)[: len(stream)] > 0).tolist()
        known = {tuple(stream[i : i + least]) for i in hits.tolist()}
        for i in range(len(stream) - least + 1):
            if not longest[i] and tuple(stream[i : i + least]) in known:
                inside[i : i + least] = [True] * least
    else:
        inside = [False] * len(stream)
    return parted(inside, pages)


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", content: str = "html", group: int = GROUP) -> DataFrame:
    """One row per row of ``df``: key, url, text, n_chars.

    Null html counts as empty and gives an empty text; a null or odd url is a host of its own.  Repeated rows each get
    their text and count as one page, also with null keys.  A very long page is one row; its markup is read in one
    linear walk.  An empty table gives none.

    Blocks are read where the pages are stored and written once.  Counting moves three hashes a block, pre-aggregated.  Only pages with
    blocks outside containers meet others, equal pages of a host as one: of each host, dealt into groups of about
    ``group`` distinct pages, so a host with a third of all pages is spread over as many tasks as it needs.  Groups of one host
    exchange a row for each distinct run of LEAST tokens (two hashes, 96 bits, told apart within the host) and learn which of
    theirs recur; runs of blocks that go whole count, too.
    """
    rows = base(df, key, url, content)
    kinds = dict(rows.dtypes)

    def read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            found = [blocks(h or "") for h in table.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [table.column(0), table.column(1), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), pa.array([[s for _, s in f] for f in found], pa.list_(pa.bool_()))],
                [key, url, "_blocks", "_sure"],
            )

    schema = f"`{key}` {kinds[key]}, `{url}` {kinds[url]}"
    made = rows.mapInArrow(read, f"{schema}, _blocks array<string>, _sure array<boolean>")
    name = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z]+://([^/?#]+)", 1))
    made = written(made.withColumn("_row", F.monotonically_increasing_id()))
    host = F.when(F.coalesce(name, F.lit("")) == "", F.xxhash64(F.lit("row"), "_row")).otherwise(F.xxhash64(name))
    made = made.withColumn("_host", host).withColumn("_page", F.xxhash64("_blocks"))

    told = made.select("_row", "_host", "_page", F.posexplode(F.arrays_zip(F.transform("_blocks", lambda b: F.xxhash64(b)).alias("b"), F.col("_sure").alias("sure"))).alias("at", "x"))
    told = told.select("_row", "_host", "_page", "at", F.col("x.b").alias("_b"), F.col("x.sure").alias("_inside"))
    counts = told.select("_host", "_b", "_inside", "_page").distinct().groupBy("_host", "_b", "_inside").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {PAGES}")
    sizes = written(made.select("_host", "_page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("pages")))
    # one row a host; more than MOST_HOSTS of them meet the blocks in a join that AQE can split
    sizes = F.broadcast(sizes) if row_count(sizes) <= MOST_HOSTS else sizes
    often = counts.join(sizes, "_host").filter(~F.col("_inside") | ((F.col("n") >= NOTICE_PAGES) & (F.col("n") >= NOTICE_SHARE * F.col("pages"))))
    often = written(often.select("_host", "_b", "_inside"))
    n_often = row_count(often)
    if n_often:
        hits = told.join(F.broadcast(often) if n_often <= MOST_HOSTS else often, ["_host", "_b", "_inside"], "left_semi")
        hits = written(hits.groupBy("_row").agg(F.collect_set("at").alias("_gone")))

    def with_gone(pages: DataFrame) -> DataFrame:
        none = F.array().cast("array<int>")
        return pages.join(hits, "_row", "left").withColumn("_gone", F.coalesce("_gone", none)) if n_often else pages.withColumn("_gone", none)

    is_open = F.exists("_sure", lambda s: ~s)
    closed = with_gone(made.filter(~is_open)).withColumn("_kept", F.filter("_blocks", lambda b, i: ~F.array_contains("_gone", i)))
    closed = closed.select(key, url, F.concat_ws("\n", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_blocks"))).alias("text"))
    size = F.length("text").cast("bigint").alias("n_chars")
    if made.filter(is_open).isEmpty():
        return closed.select(key, url, "text", size)

    opened = made.filter(is_open).withColumn("_one", F.xxhash64("_blocks", "_sure")).withColumn("_two", F.hash("_blocks", "_sure"))
    # of a host's equal pages the first is judged, the others get its text
    twice = written(opened.groupBy("_host", "_one", "_two").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    n_twice = row_count(twice)
    if n_twice:
        opened = opened.join(F.broadcast(twice) if n_twice <= MOST_HOSTS else twice, ["_host", "_one", "_two"], "left")
    else:
        opened = opened.withColumn("_first", F.lit(None).cast("bigint"))
    first = opened.filter("_first IS NULL OR _first = _row").select("_row", "_first", key, url, "_blocks", "_sure", "_page", "_host")
    groups = written(first.groupBy("_host").agg(F.ceil(F.count(F.lit(1)) / group).alias("_groups")))
    several = not groups.filter("_groups > 1").isEmpty()
    groups = F.broadcast(groups) if row_count(groups) <= MOST_HOSTS else groups
    dealt = first.join(groups, "_host").withColumn("_group", F.pmod(F.xxhash64("_page"), F.col("_groups")))

    def outside(table: pa.Table) -> list[list[list[str]]]:
        return [[t.split() for t, s in zip(p, q, strict=True) if not s] for p, q in zip(table.column("_blocks").to_pylist(), table.column("_sure").to_pylist(), strict=True)]

    def count(table: pa.Table) -> pa.Table:
        one, two, n = counted(outside(table), table.column("_page").to_pylist())
        at = [pa.repeat(table.column(c)[0], len(n)) for c in ("_host", "_group")]
        return pa.Table.from_arrays([*at, pa.array(one), pa.array(two), pa.array(np.minimum(n, PAGES).astype(np.int8))], ["_host", "_group", "_one", "_two", "n"])

    def judged(table: pa.Table, known: set[tuple[int, int]] | None) -> pa.Table:
        pages, sure, gone = (table.column(c).to_pylist() for c in ("_blocks", "_sure", "_gone"))
        found = repeated(outside(table), table.column("_page").to_pylist()) if known is None else covered(outside(table), known)
        texts = []
        for p, q, g, covers in zip(pages, sure, map(set, gone), found, strict=True):
            rest, out = iter(covers), []
            for i, (t, s) in enumerate(zip(p, q, strict=True)):
                cover = [] if s else next(rest)
                if i not in g:
                    out.append(" ".join(w for w, c in zip(t.split(), cover, strict=True) if not c) if any(cover) else t)
            texts.append("\n".join(filter(None, out)) or "\n".join(p))
        return pa.Table.from_arrays([table.column("_first"), table.column(key), table.column(url), pa.array(texts, pa.string())], ["_first", key, url, "text"])

    def judge(table: pa.Table) -> pa.Table:
        return judged(table, None)

    def judge_part(table: pa.Table, hits: pa.Table) -> pa.Table:
        return judged(table, set(zip(hits.column("_one").to_pylist(), hits.column("_two").to_pylist(), strict=True)))

    result = f"_first bigint, {schema}, text string"
    texts = with_gone(dealt.filter("_groups = 1")).groupBy("_host").applyInArrow(judge, result)
    if several:
        parts = dealt.filter("_groups > 1")
        runs = parts.groupBy("_host", "_group").applyInArrow(count, "_host bigint, _group bigint, _one bigint, _two int, n tinyint")
        # a run has a row a group at most, so no host and no run makes a hot key
        runs = runs.withColumn("_pages", F.sum("n").over(Window.partitionBy("_host", "_one", "_two"))).filter(f"_pages >= {PAGES}").drop("_pages", "n")
        texts = texts.unionByName(with_gone(parts).groupBy("_host", "_group").cogroup(runs.groupBy("_host", "_group")).applyInArrow(judge_part, result))
    if n_twice:
        texts = written(texts)
        texts = texts.unionByName(opened.filter("_first <> _row").select(key, url, "_first").join(texts.select("_first", "text"), "_first"))
    return closed.unionByName(texts.select(key, url, "text")).select(key, url, "text", size)
