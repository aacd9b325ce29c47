"""Main text of web pages by a site style tree.

1. Every page is parsed, leniently, into a tree; block elements with the same path of tags, classes and ids are one
   presentation node. For each page and node: a hash of the text below it (digits masked), a hash of its kinds of
   children, how much of its text is link text, and where it lies.
2. The pages of a host are merged by node. Pages that read the same in their article (or as a whole, if they mark none)
   count once, so copies of an article do not look like boilerplate. Over the m pages of a node, the entropy of its texts
   and of its children's kinds, divided by log m, are its content and presentation importance, ``GAMMA`` of the first and
   the rest of the second; on fewer than ``LEAST_PAGES`` pages it is unknown and taken as ``UNKNOWN``. Tags, roles, names,
   links and the place beside or around an article are a second measure, the node's promise. A node's importance is
   ``WEIGHT`` of the entropy and the rest of the promise. A menu that reads the same on every page is low whatever its
   name, a named one only if its entropy is not that of content; the same paragraph under every article goes, too.
3. Each page is parsed again and loses the branches whose node is less important than ``LOW``, wherever they are. No
   other rule drops text: without the tree, menus, footers and adverts stay.

The low nodes of each host are a small table. It is broadcast up to ``MOST_LOW`` rows; beyond that, hosts with very many
pages (a bounded number) are still joined by broadcast, and the others by a shuffle in which no host is large.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one space in page order. Defined results: a null or empty page has an empty text; a null url is a host of its own name;
repeated rows give repeated results; unclosed, crossed and unknown tags are tolerated; a script or style that is never
closed ends at the next block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.storage import materialize, ship

GAMMA = 0.9
WEIGHT = 0.45
LOW = 0.5
LEAST_PAGES = 4
UNKNOWN = 0.5
#: Rows of the table of low nodes that may be broadcast, and pages from which a host is large (or a 2,000th of all pages).
MOST_LOW = 200_000
LARGE_HOST = 20_000

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noframes".split())
CLOSED = frozenset("svg noscript select object canvas audio video template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr mi mo mn mrow mfrac msup msub".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("p blockquote pre ul ol li dl dt dd table thead tbody tr td th figure figcaption".split())
CLOSED_BY_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOISE_TAGS = frozenset("nav footer aside form button fieldset menu dialog head svg noscript select object canvas audio video template".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words in classes and ids. A name speaks of noise if one of its words does and the others are mere parts.
NOISE_WORDS = frozenset(
    "ad ads adv adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies cookiebar consent gdpr disqus foot footer login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notification overlay pagination pager paywall popup promo promoted promotion related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
PART_WORDS = frozenset("area bar block box bottom button buttons col column container content cta flow form global group header inner item items left link links list main menu module page panel primary right secondary section site slot thread top unit wrap wrapper".split())
HEADER_WORDS = frozenset("header site-header page-header site-title".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*>", re.S)
_attribute = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_block = re.compile(r"<(?:/?(?:body|article|main|section|div|p|h[1-6]|nav|footer|header|ul|table)\b)", re.I)
_digits = str.maketrans("123456789", "000000000")


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def noisy_name(name: str) -> bool:
    """Whether a class or id, as a whole, names what is no content: ``comment-list`` does, ``related-work`` and ``has-sidebar`` do not."""
    words = [w for w in re.split(r"[-_]+|\d+", name) if w]
    return any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in PART_WORDS for w in words)


class _Node:
    """An open element. kind: 0 any, 1 text, 2 article; ``drop``: it or an element around it is low."""

    __slots__ = ("tag", "path", "noisy", "in_noise", "main", "judged", "kind", "drop", "link")

    def __init__(self, tag: str, path: int, noisy: bool, in_noise: bool, main: bool, judged: bool, kind: int, drop: bool, link: bool):
        self.tag, self.path, self.noisy, self.in_noise, self.main, self.judged, self.kind, self.drop, self.link = tag, path, noisy, in_noise, main, judged, kind, drop, link


class Pages:
    """Parses pages; keeps the hashes of paths and the readings of names that it has met (bounded, as sites share them)."""

    def __init__(self, most: int = 100_000):
        self.paths: dict[tuple[int, str], int] = {}
        self.names: dict[str, bool] = {}
        self.most = most

    def path(self, above: int, name: str) -> int:
        key = (above, name)
        known = self.paths.get(key)
        if known is None:
            if len(self.paths) >= self.most:
                self.paths.clear()
            known = self.paths[key] = _hash(f"{above}/{name}")
        return known

    def noisy(self, names: str, header: bool) -> bool:
        known = self.names.get(names)
        if known is None:
            if len(self.names) >= self.most:
                self.names.clear()
            known = self.names[names] = any(map(noisy_name, names.split()))
        return known or header and not HEADER_WORDS.isdisjoint(names.split())

    def events(self, html: str, low: frozenset[int] = frozenset()) -> Iterator[tuple[str, list[_Node], bool]]:
        """(text, open elements, whether a block ends here); text is empty at a tag that only ends a block."""
        stack = [_Node("", 0, False, False, False, False, 0, False, False)]
        at, size, lower = 0, len(html), None
        while at < size:
            m = _token.search(html, at)
            if m is None:
                yield html[at:], stack, False
                return
            if m.start() > at:
                yield html[at : m.start()], stack, False
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                if tag not in INLINE:
                    yield "", stack, True
                continue
            if tag in CLOSED:
                lower = html.lower() if lower is None else lower
                if lower.find(f"</{tag}", at) < 0:
                    continue  # never closed: what follows is not in it
            if tag not in INLINE:
                yield "", stack, True
                if tag not in ("br", "hr"):
                    for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                        if stack[k].tag == "p":
                            del stack[k:]
                            break
                        if stack[k].tag not in INLINE:
                            break
            if tag in VOID or (m[3] or "").endswith("/") and tag not in RAW and tag in INLINE:
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
                if end:
                    at = end.end()
                else:
                    block = _block.search(html, at)
                    at = block.start() if block else size
                continue
            if tag in CLOSED_BY_SELF:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in CLOSED_BY_SELF[tag]:
                        break
            top = stack[-1]
            names, noisy = "", tag in NOISE_TAGS or tag == "header" and not top.main
            if m[3] and tag not in ("html", "body", "main", "article"):
                found = {a.lower(): (x or y or z) for a, x, y, z in _attribute.findall(m[3])}
                names = f"{found.get('class', '')} {found.get('id', '')}".strip().lower()
                named = names and tag not in INLINE and tag not in HEADINGS and self.noisy(names, not top.main)  # a heading's id is an anchor
                noisy = bool(noisy or named or found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true")
            article = tag in ("article", "main")
            sign = tag + ("." + ".".join(sorted(names.translate(_digits).split())) if names else "") + ("!" if noisy else "")
            path = self.path(top.path, sign)
            judged = tag not in ("html", "body") and tag not in INLINE
            stack.append(_Node(tag, path, noisy, noisy or top.in_noise, top.main or article, judged, 2 if article else 1 if tag in TEXT_TAGS else 0, top.drop or judged and path in low, top.link or tag == "a"))

    def bare(self, top: _Node) -> int:
        """The node of text that stands in no block of the page, else 0."""
        return self.path(top.path, "#text") if top.tag in ("", "html", "body") else 0

    def profile(self, html: str) -> tuple[int, dict[int, list]]:
        """A hash of what identifies the page, and for each node: [hash of its text, hash of its kinds of children, characters,
        characters in links, the node above, noisy, kind, in an article, around an article, beside one that holds most]."""
        nodes: dict[int, list] = {}
        whole = article = characters = in_article = 0
        for text, stack, _ in self.events(html):
            above = 0
            for up, node in zip(stack, stack[1:]):
                if not node.judged:
                    continue
                if node.path not in nodes:
                    nodes[node.path] = [0, 0, 0, 0, above, node.noisy, node.kind, up.main, False, False]
                    if above in nodes:
                        nodes[above][1] += node.path * 31 % (1 << 61)
                    if node.main:
                        for outer in stack:
                            if outer.path in nodes and not outer.main:
                                nodes[outer.path][8] = True
                above = node.path
            if not text or text.isspace():
                continue
            told = " ".join(text.split())
            h, n, top = _hash(told.translate(_digits)), len(told), stack[-1]
            whole = (whole * 1000003 + h) % (1 << 63)
            if not top.in_noise:
                characters += n
                in_article += n if top.main else 0
            if top.main:
                article = (article * 1000003 + h) % (1 << 63)
            loose = self.bare(top)
            if loose and loose not in nodes:
                nodes[loose] = [0, 0, 0, 0, 0, False, 0, False, False, False]
            for path in [loose] if loose else [x.path for x in stack if x.judged]:
                x = nodes[path]
                x[0] = (x[0] * 1000003 + h) % (1 << 63)
                x[2] += n
                x[3] += n if top.link else 0
        for x in nodes.values():
            x[1] %= 1 << 63
            x[9] = 2 * in_article >= characters > 0 and in_article > 0 and not (x[7] or x[8] or x[6] == 2)
        return (article if in_article else whole), nodes

    def main_text(self, html: str, low: frozenset[int]) -> str:
        """The page's text without the branches whose node is in ``low``."""
        parts = []
        for text, stack, block in self.events(html, low):
            if block:
                parts.append(" ")
            elif text and not stack[-1].drop and not (low and (loose := self.bare(stack[-1])) and loose in low):
                parts.append(unescape(text) if "&" in text else text)
        return " ".join("".join(parts).split())


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


PROFILE = "host string, page bigint, node bigint, content bigint, kinds bigint, characters bigint, linked bigint, above bigint, noisy boolean, kind int, inside boolean, around boolean, beside boolean"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages, types = Pages(), [pa.string(), *[pa.int64()] * 7, pa.bool_(), pa.int32(), *[pa.bool_()] * 3]
    names = [c.split()[0] for c in PROFILE.split(", ")]
    for batch in batches:
        hosts, rows = batch.column("host").to_pylist(), [[] for _ in names]
        for host, html in zip(hosts, batch.column("html").to_pylist()):
            page, nodes = pages.profile(html or "")
            for node, told in nodes.items():
                for column, value in zip(rows, (host, page, node, *told)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names)


def promise() -> Column:
    """What a node's tags, names, links and place say of it, in [0, 1]."""
    linked = F.col("linked") / F.greatest("characters", F.lit(1))
    plain = F.when(F.col("kind") == 1, F.lit(0.8)).otherwise(F.lit(0.6))
    return (
        F.when((F.col("kind") == 2) | F.col("around"), F.lit(1.0))
        .when(F.col("noisy"), F.lit(0.0))
        .when(F.col("beside"), F.lit(0.05))
        .otherwise(plain * (1 - F.when(F.col("inside"), linked / 2).otherwise(linked)))
    )


def node_importance(pages: DataFrame) -> DataFrame:
    """(host, node, above, pages, content, kinds, importance) from (host, html): the merged trees, measured."""
    seen = materialize(pages.mapInArrow(_profiles, PROFILE).distinct(), "profiles")

    def entropy(column: str) -> DataFrame:
        counted = seen.groupBy("host", "node", column).agg(F.count(F.lit(1)).cast("double").alias("c"))
        many = F.sum("c")
        return counted.groupBy("host", "node").agg(many.cast("long").alias("pages"), F.when(many > 1, (F.log(many) - F.sum(F.col("c") * F.log("c")) / many) / F.log(many)).otherwise(F.lit(1.0)).alias(column))

    mostly = lambda c: (F.avg(F.col(c).cast("int")) >= 0.5).alias(c)
    place = seen.groupBy("host", "node").agg(F.min("above").alias("above"), F.sum("characters").alias("characters"), F.sum("linked").alias("linked"), F.max("kind").alias("kind"), mostly("noisy"), mostly("inside"), mostly("around"), mostly("beside"))
    both = entropy("content").join(entropy("kinds").drop("pages"), ["host", "node"]).join(place, ["host", "node"])
    measured = F.when(F.col("pages") >= LEAST_PAGES, F.lit(GAMMA) * F.col("content") + F.lit(1 - GAMMA) * F.col("kinds")).otherwise(F.lit(UNKNOWN))
    return both.select("host", "node", "above", "pages", "content", "kinds", (F.lit(WEIGHT) * measured + F.lit(1 - WEIGHT) * promise()).alias("importance"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = Pages()
    for batch in batches:
        hosts, texts = batch.column("host").to_pylist(), []
        lows, at = batch.column("low"), {}
        for i, (host, html) in enumerate(zip(hosts, batch.column("html").to_pylist())):
            if host not in at:
                at[host] = frozenset(lows[i].as_py() or ())
            texts.append(pages.main_text(html or "", at[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _with_low(source: DataFrame, low: DataFrame) -> DataFrame:
    """Every page with the low nodes of its host."""
    per_host = low.groupBy("host").agg(F.collect_set("node").alias("low"))
    if low.count() <= MOST_LOW:
        return source.join(F.broadcast(per_host), "host", "left")
    hosts = source.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    hosts = materialize(hosts.join(per_host, "host", "left"), "hosts")
    large = F.greatest(F.lit(LARGE_HOST), F.lit(hosts.agg(F.sum("n")).first()[0] // 2000))
    big = hosts.filter(F.col("n") > large).select("host", "low")  # at most 2,000
    rest = source.join(F.broadcast(big.select("host")), "host", "left_anti").join(hosts.filter(F.col("n") <= large).select("host", "low"), "host")
    return source.join(F.broadcast(big), "host").unionByName(rest)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: bool = True) -> DataFrame:
    """(page_id, url, text): the main text of every page; without ``tree`` all of its text."""
    ship(pages.sparkSession)
    source = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("host"), pages[html_col].alias("html"))
    if not tree:
        return source.withColumn("low", F.lit(None).cast("array<bigint>")).mapInArrow(_texts, "page_id bigint, url string, text string")
    low = materialize(node_importance(source.select("host", "html")).filter(F.col("importance") < LOW).select("host", "node", "above"), "low-nodes")
    # what is below a low node goes with it
    top = materialize(low.join(low.select("host", F.col("node").alias("above")), ["host", "above"], "left_anti").select("host", "node"), "low-branches")
    return _with_low(source, top).select("page_id", "url", "host", "html", "low").mapInArrow(_texts, "page_id bigint, url string, text string")


def digest(pages: DataFrame) -> DataFrame:
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
