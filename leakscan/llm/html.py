"""Main text of web pages by site template removal.

A page is parsed once. Every block element's subtree is hashed from its leaves up; Spark counts the distinct pages of each host that hold
it, and subtrees that recur on many of them are the site's template and are deleted. How many are many depends on where a
subtree stands, since passages that articles share are content. In all places at least `min_pages` pages of the host hold it.

- Outside the articles (or main elements) of pages that have any: it is short, or `min_share` percent of the pages hold it.
- On pages without: `min_share` percent hold it, or it is short and always stands at the same place, counted in blocks from the
  start of the page or from its end.
- Inside an article: it is short, always stands at the same place of its article, and `article_share` percent hold it.

What recurrence cannot show goes by lists: adverts and reader comments differ from page to page, and on a host with few pages
nothing recurs. So elements that are furniture by their tag, role or class are deleted too. What is left is read block by block: inside the
articles where a page has any, else inside the main elements, else in the whole body.

The parse leaves a table of text pieces and of subtree hashes with the range of pieces that each covers; pages are not read
again. Counts combine on the map side, so a host with a third of all pages makes no large task. The recurring subtrees are
broadcast while they are at most `broadcast_rows`; beyond that they are joined to the pages by a shuffle on host and hash.

Nulls: a null or empty page has an empty text, a null url a host of its own kind. Equal pages count once; repeated rows are
extracted one by one. Further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# HTML's elements without content, with raw text, and without a block of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPE = frozenset("ul ol dl table select menu".split())
# Page furniture by tag, by role, and by words of class and id.
FURNITURE = frozenset("head script style title nav footer aside form noscript template iframe svg button select textarea dialog object canvas menu xmp noembed noframes".split())
# Content of an article, whatever its class says; blocks of it that are furniture are of other tags.
CONTENT = INLINE | frozenset("table thead tbody tfoot tr td th caption colgroup dl dt dd li pre blockquote figure figcaption h1 h2 h3 h4 h5 h6 hgroup main article".split())
# First words of class names that say what a page has, not what an element is.
TELLS_OF_PAGE = frozenset("has no with without".split())
# What is never text, and what leaves no break in the text around it.
HIDDEN = frozenset("head script style title noscript template iframe svg select textarea object canvas xmp noembed noframes".split())
NO_TEMPLATE = HIDDEN | INLINE | {"#root", "br", "meta", "link"}
SILENT = frozenset("script style noscript template iframe svg button select textarea object canvas noembed noframes title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLASSES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs comment comments disqus respond reply replies notice notices cookie cookies consent gdpr banner alert popup modal newsletter subscribe signup share sharing social related footer masthead skip pagination pager".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(frozen=True)
class TemplateRules:
    """min_pages, min_share, article_share: see the module, shares in percent; short: most words of a short subtree;
    lists: whether furniture by tag, role and class goes too; broadcast_rows: see the module."""

    min_pages: int = 5
    min_share: int = 20
    article_share: int = 50
    short: int = 50
    lists: bool = True
    broadcast_rows: int = 100_000


class Node:
    __slots__ = ("by_name", "children", "digest", "furniture", "opening", "tag")

    def __init__(self, tag: str, opening: str, furniture: bool, by_name: bool = False) -> None:
        """by_name: furniture for nothing but a class or id."""
        self.tag, self.opening, self.furniture, self.by_name, self.children, self.digest = tag, opening, furniture, by_name, [], 0


def parse(page: str, lists: bool = True) -> tuple[Node, list[Node]]:
    """The page's tree and its nodes in page order; children are nodes and strings (text with character references as written)."""
    root = Node("#root", "", False)
    stack, nodes, at, size = [root], [root], 0, len(page)
    opened: Counter[str] = Counter()
    raw_ends: dict[str, re.Pattern] = {}
    wraps: dict[str, list[list[Node]]] = {"article": [], "main": []}  # of each, the furniture around it

    def close(n: int) -> None:
        while len(stack) > n:
            opened[stack.pop().tag] -= 1

    def nearest(tags: Iterable[str], stop: frozenset[str] | set[str] = frozenset()) -> int:
        if not any(opened[t] for t in tags):
            return 0
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].tag in tags:
                return n
            if stack[n].tag in stop:
                return 0
        return 0

    def add(node: Node) -> None:
        stack[-1].children.append(node)
        nodes.append(node)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(page[at:])
            break
        if lt > at:
            stack[-1].children.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        m = TAG.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/") or page[lt + 1 : lt + 2].isalpha():
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                stack[-1].children.append("<")
                at = lt + 1
            continue
        at, tag, attrs = m.end(), m[2].lower(), m[3]
        if m[1]:
            n = nearest((tag,))
            if n:
                close(n)
            elif tag in ("p", "br"):
                add(Node(tag, "", False))
            continue
        if tag in CLOSES_P and (n := nearest(("p",), {"button", "table", "article", "#root"})):
            close(n)
        elif tag in SAME_CLOSES and (n := nearest(SAME_CLOSES[tag], LIST_SCOPE)):
            close(n)
        listed = tag in FURNITURE or (tag == "header" and not opened["article"])
        role, name = _furniture(tag, attrs, opened["article"] > 0) if attrs and lists and not listed else (False, False)
        add(node := Node(tag, m[0], listed or role or name if lists else tag in HIDDEN, name and not role))
        if tag in wraps and not node.furniture:
            wraps[tag].append([x for x in stack if x.furniture])
        if tag in VOID or attrs.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        if tag in RAW:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(rf"</{tag}\s*>", re.I)
            end = raw_ends[tag].search(page, at)
            node.children.append(page[at : size if end is None else end.start()])
            at = size if end is None else end.end()
        else:
            stack.append(node)
            opened[tag] += 1
    around = wraps["article"] or wraps["main"]
    if around and all(around):
        unwrap(root, around)
    for node in reversed(nodes):  # children come after their parents
        h = xxhash.xxh64(node.opening.encode("utf-8", "replace"))
        for c in node.children:
            h.update(b"\0" + c.encode("utf-8", "replace") if isinstance(c, str) else b"\1" + c.digest.to_bytes(8, "little", signed=True))
        node.digest = h.intdigest() - (1 << 63)
    return root, nodes


def unwrap(root: Node, around: list[list[Node]]) -> None:
    """Where all of a page's articles lie in furniture by class or id, that is their wrapper and no furniture, if it holds most of
    the page's text; a list of teasers beside a text without an article stays furniture."""
    wrappers = {id(x): x for held in around if all(x.by_name for x in held) for x in held}
    inner = outer = 0
    work: list[tuple[Node, bool]] = [(root, False)]
    while work:
        x, wrapped = work.pop()
        wrapped = wrapped or id(x) in wrappers
        if x.furniture and not wrapped or x.tag in HIDDEN:
            continue
        n = sum(len(c.split()) for c in x.children if isinstance(c, str))
        inner, outer = (inner + n, outer) if wrapped else (inner, outer + n)
        work += [(c, wrapped) for c in x.children if not isinstance(c, str)]
    if inner >= outer:
        for x in wrappers.values():
            x.furniture = False


def _furniture(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is furniture by its role, and by a class or id; the page itself and its main parts only by role, and
    an article also where it is a comment; inside an article only what is not content by its tag."""
    role = name = False
    for m in ATTR.finditer(attrs):
        kind = m[1].lower()
        if kind not in ("class", "id", "role"):
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        if kind == "role":
            role = role or not ROLES.isdisjoint(re.split(r"[^a-z0-9]+", value))
        elif tag in ("html", "body", "main", "article"):
            if tag == "article":
                name = name or any(re.split(r"[^a-z0-9]+", x)[0] in ("comment", "reply") for x in value.split())
        elif not (in_article and tag in CONTENT):
            for x in value.split():
                parts = re.split(r"[^a-z0-9]+", x)
                name = name or (not CLASSES.isdisjoint(parts) and parts[0] not in TELLS_OF_PAGE)
    return role, name


OUTSIDE, INSIDE, PLAIN = range(3)


@dataclass
class Pieces:
    """A parsed page. texts: its text in order, None where a block ends. subtrees: (hash, first piece, end, where, words, blocks
    before it and after it), where: OUTSIDE, INSIDE an article, or on a PLAIN page. articles, mains: ranges of pieces."""

    texts: list[str | None]
    subtrees: list[list[int]]
    articles: list[tuple[int, int]]
    mains: list[tuple[int, int]]


def pieces(page: str, rules: TemplateRules = TemplateRules()) -> Pieces:
    root, nodes = parse(page, rules.lists)
    holds = set()  # what holds an article or a main element is no template
    todo: list = [(root, False)]
    while todo:
        node, done = todo.pop()
        inner = [c for c in node.children if not isinstance(c, str)]
        if done:
            if node.tag in ("html", "body", "article", "main") or any(id(c) in holds for c in inner):
                holds.add(id(node))
        else:
            todo.append((node, True))
            todo += [(c, False) for c in inner]
    out = Pieces([], [], [], [])
    held = {x.tag for x in nodes if not x.furniture}
    plain = not held & {"article", "main"}
    words = blocks = 0
    open_block = False  # whether the running block has a word
    work: list = [(root, 0, False)]  # inside: 1 a main element, 2 an article
    while work:
        x, inside, hidden = work.pop()
        if isinstance(x, str):
            if not hidden:
                text = entities.unescape(x)
                n = len(text.split())
                words += n
                open_block = open_block or n > 0
                out.texts.append(text)
            continue
        if x is None:
            if open_block:
                blocks, open_block = blocks + 1, False
            out.texts.append(None)
            continue
        if isinstance(x, list):  # the end of a subtree
            x[2], x[4] = len(out.texts), words - x[4]
            x[6] = blocks + open_block
            continue
        if isinstance(x, tuple):  # the end of an article or main element
            kind, start, n, before = x
            (out.articles if kind == "article" else out.mains).append((start, len(out.texts)))
            if kind == "article":
                for sub in out.subtrees[n:]:
                    sub[5], sub[6] = sub[5] - before, blocks + open_block - sub[6]
            continue
        gone = hidden or x.furniture
        if x.tag not in INLINE and not (x.furniture and x.tag in SILENT):
            work.append((None, inside, False))
            if open_block:
                blocks, open_block = blocks + 1, False
            out.texts.append(None)
        region = x.tag if not gone and inside < {"article": 2, "main": 1}.get(x.tag, 0) else None
        if region:
            work.append(((region, len(out.texts), len(out.subtrees), blocks), inside, False))
        within = max(inside, {"article": 2, "main": 1}[region] if region else 0)
        if (id(x) not in holds or region == "article") and x.tag not in NO_TEMPLATE:
            sub = [x.digest, len(out.texts), 0, INSIDE if within == 2 else PLAIN if plain else OUTSIDE, words, blocks, 0]
            out.subtrees.append(sub)
            work.append((sub, inside, False))
        if x.tag not in HIDDEN:
            work += [(c, within, gone) for c in reversed(x.children) if not (gone and isinstance(c, str))]
    if plain:
        for sub in out.subtrees:
            sub[6] = blocks + open_block - sub[6]
    return out


def joined(texts: list[str | None]) -> str:
    """Blocks in order, joined by blanks."""
    blocks: list[str] = []
    held: list[str] = []
    for x in [*texts, None]:
        if x is not None:
            held.append(x)
        elif held:
            if text := " ".join("".join(held).split()):
                blocks.append(text)
            held = []
    return " ".join(blocks)


def kept_text(texts: list[str | None], articles: list, mains: list, removed: list) -> str:
    """The text of a parsed page without the removed ranges of pieces."""
    left = list(texts)
    for a, b in removed:
        left[a:b] = [None if x is None else "" for x in left[a:b]]
    whole = [(a, b) for a, b in removed if b > a]
    for regions in (articles, mains):
        held = [(a, b) for a, b in regions if not any(c <= a and b <= d for c, d in whole)]
        if held:
            return " ".join(filter(None, (joined(left[a:b]) for a, b in held)))
    return joined(left)


def main_text(page: str, template: frozenset[int] | set[int] = frozenset(), rules: TemplateRules = TemplateRules()) -> str:
    """The page's main text, without furniture and the subtrees with the given hashes."""
    p = pieces(page, rules)
    return kept_text(p.texts, p.articles, p.mains, [(x[1], x[2]) for x in p.subtrees if x[0] in template])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


RANGE = "array<struct<a: int, b: int>>"
SUBTREE = "hash: bigint, a: int, b: int, place: int, words: int, before: int, after: int"


def parsed_pages(pages: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """One row per row of pages: page_id, url, host, digest of the page, and its pieces."""
    kind = pages.schema["page_id"].dataType.simpleString()
    ranges = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    names = [x.split(":")[0].strip() for x in SUBTREE.split(",")]
    two = lambda x: [dict(zip("ab", r, strict=True)) for r in x]

    def listed(found: list[Pieces]) -> pa.ListArray:
        flat = [x for p in found for x in p.subtrees]
        cols = list(zip(*flat, strict=True)) or [()] * len(names)
        ends = np.cumsum([0] + [len(p.subtrees) for p in found]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, pa.int64() if n == "hash" else pa.int32()) for c, n in zip(cols, names, strict=True)], names=names))

    def parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 100):
                part = b.slice(i, 100)
                html = [x.as_py() or "" for x in part["html"]]
                found = [pieces(x, rules) for x in html]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["page_id"], part["url"], part["host"], pa.array([xxhash.xxh3_128_digest(x.encode("utf-8", "replace")) for x in html], pa.binary()),
                        pa.array([p.texts for p in found], pa.list_(pa.string())), pa.array([two(p.articles) for p in found], ranges), pa.array([two(p.mains) for p in found], ranges),
                        listed(found),
                    ],
                    names=["page_id", "url", "host", "digest", "texts", "articles", "mains", "subtrees"],
                )

    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).mapInArrow(
        parse_all, f"page_id {kind}, url string, host string, digest binary, texts array<string>, articles {RANGE}, mains {RANGE}, subtrees array<struct<{SUBTREE}>>"
    )


def site_templates(parsed: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """host and hash of the subtrees that recur across many distinct pages of the host; place: where they stand."""
    distinct = parsed.groupBy("host", "digest").agg(F.min("subtrees").alias("subtrees"))  # equal pages have equal subtrees
    # one row (host, null) for each page counts the pages of its host in the same pass; a page holds a subtree once
    none = F.array(F.lit(None).cast(f"struct<{SUBTREE}>"))
    each = distinct.select("host", "digest", F.explode(F.concat("subtrees", none)).alias("s")).groupBy("host", "digest", F.col("s.hash").alias("hash"), F.col("s.place").alias("place"))
    once = each.agg(F.max("s.words").alias("words"), *[f(f"s.{c}").alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("min", F.min), ("max", F.max))])
    counts = once.groupBy("host", "hash", "place").agg(
        F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("min", F.min), ("max", F.max))]
    ).where(F.col("n") >= rules.min_pages)
    counts = written(counts, "subtree-counts")
    total = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    shared = counts.where("hash is not null").join(total, "host")
    share, brief = F.col("n") * 100 / F.col("pages"), F.col("words") <= rules.short
    in_place = (F.col("min_before") == F.col("max_before")) | (F.col("min_after") == F.col("max_after"))
    often = share >= rules.min_share
    told = F.when(F.col("place") == INSIDE, (share >= rules.article_share) & brief & in_place & (F.col("words") > 0))
    told = told.when(F.col("place") == PLAIN, often | (brief & in_place)).otherwise(often | brief)
    return shared.where(told).select("host", "hash", "place")


def extract_main_text(pages: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """page_id, url, text, n_chars, n_template (outermost subtrees that went for recurring): one row per row of pages (page_id,
    url, html)."""
    parsed = written(parsed_pages(pages, rules), "parsed-pages", compression="zstd")
    found = written(site_templates(parsed, rules), "templates")
    rows = parsed.withColumn("template", F.lit(None).cast("array<struct<hash: bigint, place: int>>"))
    few: dict[str, set[tuple[int, int]]] = {}
    listed = found.limit(rules.broadcast_rows + 1).collect()  # at most broadcast_rows + 1 rows
    if len(listed) <= rules.broadcast_rows:
        for r in listed:
            few.setdefault(r["host"], set()).add((r["hash"], r["place"]))
    else:  # each distinct page's own recurring subtrees, by its digest
        own = parsed.groupBy("host", "digest").agg(F.min("subtrees").alias("subtrees")).select("host", "digest", F.explode("subtrees").alias("s"))
        own = own.select("host", "digest", F.col("s.hash").alias("hash"), F.col("s.place").alias("place")).join(found, ["host", "hash", "place"])
        rows = parsed.join(own.groupBy("host", "digest").agg(F.collect_set(F.struct("hash", "place")).alias("template")), ["host", "digest"], "left")
    by_host = pages.sparkSession.sparkContext.broadcast(few)
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 100):
                b = whole.slice(i, 100)
                out, removed = [], []
                for host, texts, articles, mains, subtrees, template in zip(*(b[c] for c in ("host", "texts", "articles", "mains", "subtrees", "template")), strict=True):
                    known = by_host.value.get(host.as_py()) or {(t["hash"], t["place"]) for t in template.as_py() or ()}
                    found = subtrees.values
                    hashes, places, starts, ends = (found.field(c).to_pylist() for c in ("hash", "place", "a", "b")) if known else ([],) * 4
                    gone: list[tuple[int, int]] = []
                    for h, place, start, end in zip(hashes, places, starts, ends, strict=True):  # in page order: the outermost comes first
                        if (h, place) in known and not (gone and gone[-1][0] <= start and end <= gone[-1][1]):
                            gone.append((start, end))
                    ranges = [[(r["a"], r["b"]) for r in some.as_py()] for some in (articles, mains)]
                    out.append(kept_text(texts.as_py(), *ranges, gone))
                    removed.append(len(gone))
                yield pa.RecordBatch.from_arrays(
                    [b["page_id"], b["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(removed, pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_template"],
                )

    return rows.select("page_id", "url", "host", "texts", "articles", "mains", "subtrees", "template").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars bigint, n_template bigint")
