"""Main text of web pages, with site style trees.

Pages of one host are merged into a tree of style nodes: the path of tags and classes from the root.
For each node, over the m pages that have it:

* content importance: 1 less the mean of log_m c over the texts that each page has directly in it, c being the
  number of pages with that text: what stands on every page has 0, what stands on one has 1;
* presentation importance: the entropy, in base m, of the sequences of child nodes it has;
* composite importance: (1 - g) times presentation plus g times the mean of its children and its own content, where g is
  ``GAMMA`` to the number of different child sequences: one fixed presentation leaves the decision to the content.

A node of one page has importance 1.  Branches with composite importance under ``LEAST`` are removed from each page of the host;
of what a page declares as ``article`` or ``main``, only ``div`` and ``section`` branches, and never a branch that holds such
an element.  A page of which the tree would leave nothing keeps what the markup leaves.

The tree says nothing of hosts with one page, and menus or adverts with other words on each page look like content to it, so it is
joined with what the markup declares.  Elements and roles that are never main text (menus, footers, asides, scripts,
...) go, as do elements hidden by an attribute.  Reader comments, known by class or id, go with all they hold, articles of their own included, unless the page has
nothing else.  Forms and elements with a class or id that names a menu, an advert, a notice or a side bar go,
unless they hold an ``article`` or ``main`` element or, where the page has no such element, over half of its remaining text; words that tell a state of a
wrapper (``with-sidebar``, ``no-comments``) name nothing, nor do names of headings.  Inside ``article`` and ``main``, and for paragraphs, names of menus, headers
and notices count only where half or more of the element's text is links, since articles have parts about such things and headers of
their own.  If ``article`` and ``main`` elements hold half or more of what is then left, only they stay.

Character references are decoded, white space in a block becomes one space, blocks are joined by
one space.  Null and empty html give an empty text; a null url is a host of its own.  Repeated rows
each get a result, and count as pages of their own.  Pages of any length are parsed whole, one at a time.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.shared import BROADCAST_BYTES, hot_keys, released, stash
from voxelmill.llm.textops import chunks

GAMMA = 0.9
LEAST = 0.3
#: Tasks that a large host's pages are dealt to where its style nodes are too many to broadcast.
SALTS = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z|([^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in _RAW}
_NEVER = frozenset("head nav footer aside button select dialog menu svg canvas object audio video datalist".split()) | _RAW
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tr td th tbody thead figure figcaption article main body html".split())
#: Words that name comments, other parts that aren't main text wherever they stand, parts that are so by their links or outside
#: of articles, and words that may stand around these in a class or id.
_COMMENTS = "comments? commentlist respond reply replies disqus".replace(" ", "|")
_FIRM = (
    "ads? adverts? advertisements? advertising sponsor(?:ed|s)? promos? promotions? cookies? consent gdpr popups? modals? overlays? newsletters? "
    "subscribe subscription signup login share sharing social related recommend(?:ed|ations?)? sidebars? widgets? searchbox"
).replace(" ", "|")
_SOFT = "banners? notices? alerts? nav navbar navigation menus? breadcrumbs? pagination pager footer masthead toolbar skip header".replace(" ", "|")
_AROUND = "site|page|main|global|top|bottom|left|right|side|primary|secondary|post|article|user|reader|google|js"
_BEHIND = r"\d+|bar|box|block|container|wrapper|wrap|area|list|items?|section|unit|slot|links?|content|inner|form|panel|top|bottom|left|right"
_ANY = f"{_COMMENTS}|{_FIRM}|{_SOFT}"
_NAMED = re.compile(rf"(?:(?:{_AROUND})[_-])*(?P<part>{_ANY})(?:[_-](?:{_ANY}|{_BEHIND}))*\d*", re.I)
_KINDS = ((re.compile(_COMMENTS, re.I), 3), (re.compile(_FIRM, re.I), 2), (re.compile(_SOFT, re.I), 1))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TELLING = re.compile(r"class|id\s*=|role|hidden|style", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def _step(parent: int, key: str) -> int:
    return xxhash.xxh64_intdigest(key, parent) >> 1


class Element:
    """``noise``: it or an element around it is never main text; ``named``: its class or id names such a part (1 softly, 2 firmly, 3
    comments); ``size`` and ``linked``: characters of its text, and of those of links."""

    __slots__ = ("tag", "parent", "node", "noise", "named", "main", "holds", "size", "linked", "kinds", "texts", "block")

    def __init__(self, tag: str, parent: Element | None, node: int, noise: bool, named: int, main: bool, block: Element | None):
        self.tag, self.parent, self.node, self.noise, self.named, self.main = tag, parent, node, noise, named, main
        self.holds, self.size, self.linked = False, 0, 0
        self.kinds: list[int] = []
        self.texts: list[str] = []
        self.block = block or self


@lru_cache(maxsize=65536)
def _marks(tag: str, attributes: str) -> tuple[str, bool, int, bool]:
    """Of a start tag: its key in a style path, whether it is noise, what it is named like, and whether it is main."""
    names, role, hidden = [], "", False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names += value.split()
        elif name == "role":
            role = value.lower()
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    named = 1 if tag == "header" else 2 if tag == "form" else 0
    if tag not in _HEADINGS and tag not in ("body", "html"):
        found = [m["part"] for m in map(_NAMED.fullmatch, names) if m]
        named = max([named, *(kind for part in found for pattern, kind in _KINDS if pattern.fullmatch(part))])
    key = re.sub(r"\d+", "", f"{tag}.{names[0] if names else ''}")
    return key, hidden or tag in _NEVER or role in _ROLES, named, tag in ("article", "main") or role == "main"


def _open(tag: str, attributes: str, above: Element) -> Element:
    if tag not in _BLOCK and tag not in _NEVER and not _TELLING.search(attributes):
        return Element(tag, above, above.node, above.noise, 0, above.main, above.block)
    key, noise, named, main = _marks(tag, attributes if _TELLING.search(attributes) else "")
    noise = above.noise or noise
    if tag not in _BLOCK and tag not in _NEVER and noise == above.noise and not named:
        return Element(tag, above, above.node, noise, 0, above.main or main, above.block)
    node = _step(above.node, key)
    above.block.kinds.append(node)
    return Element(tag, above, node, noise, named, above.main or main, None)


def parse(page: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """Blocks of text in page order, each with its block element; and all block elements."""
    root = Element("", None, 1, False, 0, False, None)
    now, elements = root, [root]
    blocks: list[tuple[Element, str]] = []
    pending: list[str] = []

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                now.block.texts.append(text)
                blocks.append((now.block, text))

    at, end, links = 0, len(page), 0
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m[7]
        if text is not None:
            if not now.noise or not text.isspace():
                text = entities.unescape(text) if "&" in text else text
                pending.append(text)
                if links:
                    now.block.linked += len(" ".join(text.split()))
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if tag in _BLOCK or tag in _NEVER:
            flush()
        if closing:
            x = now
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                if now.block is not x.parent.block:
                    flush()
                now = x.parent
            links = max(0, links - (tag == "a"))
            continue
        if tag in _RAW:
            stop = _CLOSING[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P or tag == "li":
            x = now
            while x is not root and x.tag not in _BLOCK:
                x = x.parent
            if x.tag == "p" or (x.tag == "li" and tag == "li"):
                now = x.parent
        links += tag == "a"
        new = _open(tag, m[3] or m[6] or "", now)
        if new.block is new:
            flush()
            elements.append(new)
        now = new
    flush()
    return blocks, elements


def _settle(blocks: list[tuple[Element, str]], elements: list[Element]) -> None:
    """Which elements hold main ones, and which of those named like noise are it."""
    apart = [e.noise for e in elements]
    for e in elements[1:]:
        e.noise |= e.parent.block.noise or e.named == 3
    if not any(not e.noise for e, _ in blocks):  # comments are all there is
        for e, before in zip(elements, apart):
            e.noise = before
    for e, text in blocks:
        e.size += 0 if e.noise else len(text)
    for e in reversed(elements[1:]):  # inner ones come after those around them
        above = e.parent.block
        above.size += e.size
        above.linked += 0 if e.noise else e.linked
        above.holds |= e.holds or (e.main and not e.parent.main and not e.noise)
    most = elements[0].size / 2 if not elements[0].holds else -1  # a page with a main element has its text there
    for e in elements[1:]:
        above = e.parent.block
        gone = e.named and not e.holds and not (e.main and not e.parent.main) and (e.size <= most or most < 0)
        if gone and e.named == 1 and (above.main or e.tag == "p"):
            gone = 2 * e.linked >= e.size
        e.noise |= above.noise or bool(gone)


def main_text(page: str, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text; ``low``: the style nodes of its host that are of low importance."""
    blocks, elements = parse(page)
    _settle(blocks, elements)
    blocks = [(e, t) for e, t in blocks if not e.noise]
    inside = [(e, t) for e, t in blocks if e.main]
    if inside and 2 * sum(len(t) for _, t in inside) >= sum(len(t) for _, t in blocks):
        blocks = inside

    def dropped(e: Element) -> bool:
        while e is not None and e.tag not in ("", "body", "html", "article", "main"):
            if e.node in low and not e.holds and not (e.main and e.tag in _FLOW):
                return True
            e = e.parent
        return False

    kept = [t for e, t in blocks if not dropped(e)] if low else []
    return " ".join(kept or [t for _, t in blocks])


@released
def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk: host, node, parent, kind (0 presence, 1 text, 2 child sequence), value, pages."""
    names = ["host", "node", "parent", "kind", "value", "pages"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for batch in chunks(batches, "html"):
        seen: Counter = Counter()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            own = set()
            for e in parse(page or "")[1][1:]:
                if e.noise:
                    continue
                parent = e.parent.block.node
                own.add((host, e.node, parent, 0, 0))
                own.update((host, e.node, parent, 1, xxhash.xxh64_intdigest(t) >> 1) for t in e.texts)
                if e.kinds:
                    own.add((host, e.node, parent, 2, xxhash.xxh64_intdigest(np.array(list(dict.fromkeys(e.kinds)), np.int64).tobytes()) >> 1))
            seen.update(own)
        columns = list(zip(*((*k, n) for k, n in seen.items()))) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _compose(nodes: pd.DataFrame) -> pd.DataFrame:
    """Composite importance of the nodes of one host; a row with ``alone`` stands for so many children of one page each."""
    single = nodes[nodes["alone"] > 0].groupby("parent")["alone"].sum().to_dict()
    nodes = nodes[nodes["alone"] == 0]
    own, parent, m = {}, dict(zip(nodes["node"], nodes["parent"])), dict(zip(nodes["node"], nodes["pages"]))
    content, style, ways = {}, {}, {}
    for r in nodes.itertuples():
        base = np.log(max(r.pages, 2))
        if r.texts > 0:
            content[r.node] = max(0.0, 1 - r.text_logs / r.texts / base)
        style[r.node] = max(0.0, (np.log(r.kind_pages) - r.kind_logs / r.kind_pages) / base) if r.kinds > 0 else 0.0
        ways[r.node] = int(r.kinds)
    children: dict[int, list[int]] = {}
    for n, p in parent.items():
        children.setdefault(p, []).append(n)

    stack = [n for n, p in parent.items() if p not in parent or p == n]
    order = []
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in children.get(n, ()) if c != n]
    for n in reversed(order):
        below = [c for c in children.get(n, ()) if c in own]
        alone = single.get(n, 0)
        if not below and not alone:
            own[n] = content.get(n, style[n])
            continue
        mean = (sum(m[c] * own[c] for c in below) + alone) / (sum(m[c] for c in below) + alone)
        if n in content:
            mean = (mean + content[n]) / 2
        g = GAMMA ** ways[n]
        own[n] = (1 - g) * style[n] + g * mean
    return pd.DataFrame({"host": nodes["host"].iloc[0] if len(nodes) else None, "node": list(own), "pages": [m[n] for n in own], "importance": list(own.values())})


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host (of the url, lower-cased; null without one)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", "url", "html", F.when(host != "", host).alias("host"))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance of all style nodes, from (page_id, url, html, host)."""
    seen = pages.select("host", "html").mapInArrow(_nodes, "host string, node long, parent long, kind int, value long, pages long")
    seen = seen.groupBy("host", "node", "parent", "kind", "value").agg(F.sum("pages").alias("pages"))
    of = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    log = F.log("pages")
    nodes = seen.groupBy("host", "node", "parent").agg(
        of(0, F.col("pages")).alias("pages"), of(1, F.col("pages")).alias("texts"), of(1, F.col("pages") * log).alias("text_logs"),
        F.count_if(F.col("kind") == 2).alias("kinds"), of(2, F.col("pages")).alias("kind_pages"), of(2, F.col("pages") * log).alias("kind_logs"),
    )
    # Nodes of one page have importance 1: their parents need their number alone, so the group of a host has the nodes
    # that its pages share, and not those that each page has of its own (as with generated class names).
    shared = nodes.filter("pages > 1")
    both = [F.col(f"single.{a}").eqNullSafe(F.col(f"shared.{b}")) for a, b in (("host", "host"), ("parent", "node"))]
    single = nodes.filter("pages = 1").groupBy("host", "parent").agg(F.count("*").alias("alone")).withColumns({"node": F.lit(0).cast("long"), "pages": F.lit(0).cast("long")}).alias("single")
    single = single.join(shared.select("host", "node").distinct().alias("shared"), both[0] & both[1], "left_semi")
    rows = shared.withColumn("alone", F.lit(0).cast("long")).unionByName(single, allowMissingColumns=True)
    return rows.groupBy("host").applyInPandas(_compose, "host string, node long, pages long, importance double")


@released
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html"):
        low = batch.column("low").to_pylist()
        texts = [main_text(p, frozenset(n or ())) if p else "" for p, n in zip(batch.column("html").to_pylist(), low)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per input row: page_id, url, text."""
    pages = with_host(pages)
    low = style_tree(pages).filter(F.col("importance") < least)
    low = stash(low.groupBy(F.col("host").alias("own")).agg(F.collect_set("node").alias("low")), "op6-low")
    size = low.agg(F.coalesce(F.sum(F.size("low") * 8 + 64), F.lit(0))).first()[0]
    same = F.col("host").eqNullSafe(F.col("own"))
    if size <= BROADCAST_BYTES:
        rows = pages.join(F.broadcast(low), same, "left")
    else:  # pages of large hosts are dealt to SALTS tasks each, their hosts' lists to all of these
        counts = pages.groupBy("host").agg(F.count("*").alias("rows"))
        hot = F.broadcast(hot_keys(counts, pages.count(), "op6-hot").withColumnsRenamed({"host": "_host"}).withColumn("_hot", F.lit(True)))  # under HOT rows
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
        salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        dealt = pages.join(hot, F.col("host").eqNullSafe(F.col("_host")), "left").withColumn("_salt", salt).drop("_host", "_hot")
        lists = low.join(hot, F.col("own").eqNullSafe(F.col("_host")), "left").select("own", "low", F.explode(salts).alias("_of"))
        rows = dealt.join(lists, same & (F.col("_salt") == F.col("_of")), "left")
    return rows.select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_text": op6_html_text}
SQL: dict[str, str] = {}
