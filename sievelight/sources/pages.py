"""Web pages as documents: parsing, links, titles, main text, attachments, and a crawl over a snapshot of pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bound
from ..functions.lineage import cut
from ..functions.text import count_contained
from ..lexicon import CHINESE, LanguagePack
from ..operators.cleaning import clean_body

# What holds an article, surely and perhaps, and what never belongs to one.
STRICT = [".wp_articlecontent", "#wp_articlecontent", ".arti_content", ".article_content", ".article-content", ".v_news_content", ".news_content", ".news-con", ".news_con", ".content-detail", ".detail_content", ".TRS_Editor", "[id*=wp_articlecontent]", "[class*=wp_articlecontent]"]
FALLBACK = ["article", ".article", ".main_content", ".main-content", ".article-main", ".article_body", ".article-body", ".detail", ".detail-box", ".wp_entry", ".wp_article", ".content", "#content", ".main"]
BAD = ["script", "style", "noscript", "nav", "footer", "header", "aside", "form", "iframe", ".nav", ".navbar", ".menu", ".submenu", ".footer", ".header", ".breadcrumb", ".location", ".position", ".share", ".search", ".sider", ".sidebar", ".leftmenu", ".rightmenu", ".wp_nav", ".wp_menu", "#nav", "#footer", "#header"]
FILES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".ppt", ".pptx")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
PAGE = "title string, containers array<struct<weight:int,text:string>>, links array<string>, attachments array<struct<name:string,url:string>>"


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict, parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def matches(self, selector: str) -> bool:
        """A tag, ``.class``, ``#id`` or ``[attribute]`` / ``[attribute*=part]``."""
        if selector[0] == ".":
            return selector[1:] in (self.attributes.get("class") or "").split()
        if selector[0] == "#":
            return self.attributes.get("id") == selector[1:]
        if selector[0] == "[":
            name, _, part = selector[1:-1].partition("*=")
            return part in (self.attributes.get(name) or "") if part else name in self.attributes
        return self.tag == selector

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        """The texts below that no bad element holds."""
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if node.strip():
                    yield node.strip()
            elif not any(node.matches(b) for b in BAD):
                stack += reversed(node.children)


class Tree(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attributes):
        node = Node(tag, dict(attributes), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attributes):
        self.at.children.append(Node(tag, dict(attributes), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def containers(root: Node) -> list[tuple[int, str]]:
    """(weight, raw text) of every element that a selector takes for the main text, the strict selectors first; behind them the whole body (weight -1)."""
    nodes = list(root.walk())
    found = [(weight, "\n".join(node.strings())) for weight, selectors in ((100, STRICT), (20, FALLBACK)) for selector in selectors for node in nodes if node.tag and node.matches(selector)]
    body = next((n for n in nodes if n.tag == "body"), root)
    return [*found, (-1, "\n".join(body.strings()))]


def title_of(root: Node, site: str = "") -> str:
    """The longest heading or title, else the sharing title; without the site's name behind a dash."""
    nodes = list(root.walk())
    found = [re.sub(r"\s+", " ", " ".join(n.strings() if n.tag != "title" else (c for c in n.children if isinstance(c, str)))).strip() for n in nodes if n.tag in ("h1", "title") or any(n.matches(s) for s in (".arti_title", ".article-title", ".news_title") if n.tag)]
    best = max(found, key=len, default="")
    if not best:
        best = next((n.attributes.get("content") or "" for n in nodes if n.tag == "meta" and n.attributes.get("property") == "og:title"), "")
    return re.sub(r"\s*-\s*" + re.escape(site) + ".*$", "", best, flags=re.S)[:200] if site else best[:200]


def resolved(base: str, href: str | None) -> str | None:
    """An absolute http(s) address without fragment, or none."""
    href = (href or "").strip()
    if not href or href.lower().startswith(("javascript:", "mailto:", "#")):
        return None
    try:
        url = urljoin(base, html.unescape(href)).split("#", 1)[0]
        return url if urlsplit(url).scheme in ("http", "https") and urlsplit(url).netloc else None
    except ValueError:
        return None


def is_file(url: str) -> bool:
    return urlsplit(url).path.lower().endswith(FILES)


def parse(url: str, page: str | None, site: str = "") -> dict:
    """What needs the tree: title, containers of text, links and attachments."""
    root = Tree(page or "").root
    links, attachments = [], {}
    for node in root.walk():
        for name in ("href", "pdfsrc", "filesrc"):
            target = resolved(url, node.attributes.get(name)) if node.tag and (name != "href" or node.tag == "a") else None
            if not target:
                continue
            if name != "href" or is_file(target):
                told = " ".join(node.strings()) or target.rsplit("/", 1)[-1]
                attachments.setdefault(target, {"name": told[:160], "url": target})
            elif urlsplit(target).netloc == urlsplit(url).netloc and not re.search(r"/_upload/|/_t|/main\.htm", target):
                links.append(target)
    out = {"title": title_of(root, site), "containers": [{"weight": w, "text": t} for w, t in containers(root)], "links": list(dict.fromkeys(links)), "attachments": list(attachments.values())}
    for node in list(root.walk()):
        node.parent = None  # so the tree goes at once, without the collector of cycles
    return out


def main_text(found: Column, title: Column, pack: LanguagePack) -> Column:
    """(container, text) of the best container: by its weight, length, long lines and boilerplate, ties to the first; else the cleaned body."""
    cleaned = F.transform(found, lambda c, i: F.struct(c["weight"].alias("weight"), i.alias("at"), clean_body(c["text"], title, pack).alias("text")))

    def chosen(cleaned: Column) -> Column:
        def value(c: Column) -> Column:
            long_lines = F.size(F.filter(F.split(c["text"], "\n"), lambda x: F.length(x) >= 28))
            return c["weight"] + F.floor(F.least(F.length(c["text"]), F.lit(5000)) / 20) + 8 * long_lines - 60 * count_contained(c["text"], pack.boilerplate_terms)

        good = F.filter(cleaned, lambda c: (c["weight"] > 0) & (F.length(c["text"]) >= 30))
        best = F.array_max(F.transform(good, lambda c: F.struct(value(c).alias("value"), (-c["at"]).alias("order"), c["text"].alias("text"))))
        return F.struct(best.isNotNull().alias("container"), F.coalesce(best["text"], F.element_at(cleaned, -1)["text"]).alias("text"))

    return bound(cleaned, chosen)


def page_kind(url: Column, body: Column, container: Column) -> Column:
    """home, list, listing_like_page, article or no_article_container."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    dates = F.size(F.regexp_extract_all(body, F.lit(r"20\d{2}[-./年]\d{1,2}[-./月]\d{1,2}"), F.lit(0)))
    listing = ~container & (dates >= 5) & (F.size(F.filter(F.split(body, "\n"), lambda x: F.length(x) >= 8)) >= 12)
    home = path.isin("", "/", "/index.html", "/index.htm", "/main.htm")
    return F.when(home, "home").when(F.contains(path, F.lit("list")), "list").when(listing, "listing_like_page").when(container, "article").otherwise("no_article_container")


def parsed(pages: DataFrame, pack: LanguagePack = CHINESE, url: str = "url", content: str = "html") -> DataFrame:
    """``pages`` with title, body, links (same host), attachments and the page's kind; only the tree is read in Python."""

    # not in Arrow batches, which hold thousands of pages and their containers at once
    read = F.udf(lambda at, page: parse(at or "", page, pack.institution), PAGE, useArrow=False)
    out = pages.withColumn("_p", read(F.col(url), F.col(content))).withColumn("_main", main_text(F.col("_p.containers"), F.col("_p.title"), pack))
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), "_p.title", F.col("_main.text").alias("body"), "_p.links", "_p.attachments", page_kind(F.col(url), F.col("_main.text"), F.col("_main.container")).alias("kind"))


def allowed_links(links: DataFrame, link: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Links whose path has an included prefix (any, if there are none) and no excluded one."""
    path = F.regexp_extract(F.col(link), r"^https?://[^/?#]+([^?#]*)", 1)
    starts = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(path, p)) if prefixes else F.lit(False)
    return links.filter((starts(include) if include else F.lit(True)) & ~starts(exclude))


def documents(pages: DataFrame, as_of=None, days_back: int | None = None) -> DataFrame:
    """Parsed pages that are documents: with a title, and a body of at least 30 characters or attachments; not older than ``days_back``."""
    from ..functions.dates import age_days, from_url

    rows = pages.filter((F.col("title") != "") & ((F.length("body") >= 30) | (F.size("attachments") > 0))).withColumn("publish_date", from_url(F.col("url")))
    if days_back is not None:
        rows = rows.filter(F.col("publish_date").isNull() | (age_days(F.col("publish_date"), as_of) <= days_back))
    return rows


def reachable(edges: DataFrame, start: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(node, depth): breadth first over (src, dst) from ``start`` (node), up to ``depth`` levels and ``most`` nodes.

    Each level is one join of the frontier and one anti-join with what was seen; levels are few and bounded by ``depth``.
    """
    seen = frontier = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        reached = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if most is not None:
        seen = seen.orderBy("depth", "node").limit(most)
    return seen


def crawl_report(log: DataFrame, errors: int = 80, skipped: int = 2000) -> DataFrame:
    """Per site: counts by outcome, the first errors and skipped addresses.  ``log`` (site, url, outcome, seq)."""
    nth = F.row_number().over(Window.partitionBy("site", "outcome").orderBy("seq"))
    rows = log.withColumn("_n", nth)
    short: dict[str, Column] = {name: F.transform(F.array_sort(F.collect_list(F.when((F.col("outcome") == name) & (F.col("_n") <= most), F.struct("seq", "url")))), lambda x: x["url"]) for name, most in (("error", errors), ("skipped", skipped))}
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("outcome") == "saved").alias("n_saved"), F.count_if(F.col("outcome") == "error").alias("n_errors"), F.count_if(F.col("outcome") == "skipped").alias("n_skipped"), short["error"].alias("errors"), short["skipped"].alias("skipped"))
