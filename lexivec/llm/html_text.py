"""Main text of web pages: site template removal by subtree hashes, and page structure.

Every element subtree of a page is hashed. Per host, Spark counts for each hash the distinct pages (by content) that hold it;
subtrees that recur across ``LEAST_PAGES`` pages of a host or more are its template and are deleted (a host with fewer pages has none). Structure says the
rest: menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out, and the text is that of the article where the page marks one. Within a marked
article only containers recur as template; its headings, paragraphs, lists and tables are content, however often they are repeated.
A class, id or role marks boilerplate by its whole name alone (``sidebar``, ``cookie-notice``; not ``has-sidebar`` or ``notice-period``). Names never
cost the article: one within a named wrapper is found all the same, and names that would leave nothing of it are not heeded.

Text: character references decoded, white space within a block turned into one space, blocks joined in page
order by one space.

Defined cases: a null html is empty and gives an empty text; a null url is a host of its own name ''; a null page_id stays null; repeated rows
are extracted each, and count once for the template; equal pages of a host get equal texts, and no choice depends on order; very long, deep or malformed pages are read in one pass; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import durable, short_batches

#: A subtree is template if so many distinct pages of the host hold it, however many pages the host has.
LEAST_PAGES = 5
#: Lists of the hosts' template subtrees are broadcast up to so many rows in all and so many for a host, as counted; beyond, each page
#: gets those of its own subtrees that are template. Either way the texts are the same.
BROADCAST_ROWS, HOST_ROWS = 500_000, 10_000

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = {"script", "style", "head", "title", "nav", "footer", "aside", "form", "noscript", "template", "iframe", "object", "svg", "canvas", "button", "select", "textarea", "dialog", "menu", "audio", "video", "map", "input", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: What may be template: blocks of a page's frame. What recurs in any other element (inline ones, headings, paragraphs, cells, items) is content.
CONTAINERS = {"div", "section", "header", "footer", "aside", "nav", "ul", "ol", "dl", "center", "address", "details", "fieldset", "figure"}
#: Text in these, but for links, makes a container content.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "pre", "blockquote", "figcaption", "summary"}
#: Start tags that end an open paragraph, and those that end an open element of their own kind.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What the end tag of an inline element does not reach beyond.
BARRIERS = ("article", "main", "td", "th", "body")
#: Words of a class, id or role that mark what is not the article.
_WORDS = (
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar sidebars aside rail widget widgets menu menus nav navbar navigation navigational "
    "breadcrumb breadcrumbs pagination pager footer masthead toolbar share sharing social related recommended recommendations comment comments "
    "commentlist disqus respond reply replies complementary contentinfo search skip"
)
MARKS = frozenset(_WORDS.split())
#: Words that such a name may have beside them; with any other word in it, it marks nothing.
_BESIDE = "site page main global top bottom left right primary secondary box bar block list link links area section container wrapper wrap inner outer panel slot unit form message buttons icons posts articles thread module region content"
BESIDE = frozenset(_BESIDE.split())

#: A comment, a tag (its quotes count only where a value begins; what isn't closed goes on to the end) or a declaration. Each character is read once.
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)(>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
#: One attribute, as ``_TAG`` reads it.
_ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)))?+")
#: Whether it is worth while to read the attributes.
_NAMES = re.compile(r"class|id|role|hidden|style", re.I)
_PART = re.compile(r"[-_]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none(?![\w-])", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str = ""
    parts: list = field(default_factory=list)  # of texts and nodes
    hash: int = 0
    bare: bool = False  # has text outside of links
    prose: bool = False  # has such text in a paragraph, heading, item or cell
    read: dict | None = None

    def attributes(self) -> dict[str, str]:
        """Values by name in lower case; of attributes with one name the first holds."""
        if self.read is None:
            self.read = {}
            if self.attrs and _NAMES.search(self.attrs):
                for m in _ATTR.finditer(self.attrs):
                    self.read.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return self.read


class _Open:
    """The open elements, with where each kind of them was opened last, so that no end tag has to look for its start."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {"#root": [0]}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=0)

    def close(self, i: int) -> None:
        """End the i-th open element (never the root) and all within it."""
        while len(self.stack) > max(i, 1):
            node = self.stack.pop()
            self.at[node.tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()


def parse(source: str) -> Node:
    """A tree after the parts of the HTML rules that matter here: raw text, void elements, implied ends, stray end tags.

    One pass, in time proportional to the source; depth is held in a list, so deeply nested pages are no trouble."""
    root = Node("#root")
    opened = _Open(root)
    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if not m:
            opened.stack[-1].parts.append(source[at:])
            break
        if m.start() > at:
            opened.stack[-1].parts.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:  # the source ends within a tag
            break
        tag = m[2].lower()
        if m[1]:
            i = opened.last((tag,))
            if i and not (tag in INLINE and opened.last(BARRIERS) > i):
                opened.close(i)
            continue
        if tag in ENDS_P and opened.stack[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        if tag in SIBLINGS:
            same, limit = SIBLINGS[tag]
            i = opened.last(same)
            if i > opened.last(limit):
                opened.close(i)
        node = Node(tag, m[3])
        opened.stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            node.parts.append(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        if not m[3].endswith("/") or tag not in ("svg", "path"):
            opened.push(node)
    return root


def walk(root: Node) -> Iterator[tuple[Node, list[Node]]]:
    """Every node after its descendants, with its ancestors."""
    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, i = stack.pop()
        parts = node.parts
        while i < len(parts) and isinstance(parts[i], str):
            i += 1
        if i < len(parts):
            stack += [(node, i + 1), (parts[i], 0)]
        else:
            yield node, stack


def set_hashes(root: Node) -> None:
    """A node's hash covers its tag, attributes, texts and the hashes of its children. Where its text lies is noted beside."""
    for node, _ in walk(root):
        h = xxhash.xxh3_64(f"{node.tag} {node.attrs.strip()}")
        bare = prose = False
        for p in node.parts:
            if isinstance(p, str):
                h.update(f"\0{' '.join(p.split())}")
                bare = bare or not p.isspace()
            else:
                h.update(p.hash.to_bytes(8, "little"))
                bare, prose = bare or p.bare, prose or p.prose
        node.hash = h.intdigest()
        node.bare = bare and node.tag != "a" and node.tag not in DROPPED
        node.prose = node.bare and (prose or node.tag in PROSE)


def _names_boilerplate(name: str) -> bool:
    words = [w for w in _PART.split(name) if w]
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in BESIDE for w in words)


def _marked(node: Node) -> bool:
    """Whether a class, id or role of the element is, as a whole, a name of boilerplate."""
    own = node.attributes()
    return any(_names_boilerplate(x) for name in ("class", "id", "role") if name in own for x in own[name].lower().split())


def _hidden(node: Node) -> bool:
    own = node.attributes()
    return "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or bool(_HIDDEN.search(own.get("style", "")))


def boilerplate(node: Node, in_article: bool, names: bool = True) -> bool:
    """Whether structure says that the subtree isn't the article's text. A header within an article is its own."""
    if node.tag in ("html", "body", "main"):
        return False
    return node.tag in DROPPED or (node.tag == "header" and not in_article) or _hidden(node) or (names and _marked(node))


def articles(root: Node) -> list[Node]:
    """The outermost article elements that aren't boilerplate; else those within or with a name of it; else main; else the body; else all."""
    found: dict[str, list[Node]] = {"article": [], "wrapped": [], "named": [], "main": [], "body": []}
    stack = [(root, False)]
    while stack:
        node, within = stack.pop()
        if node is not root and boilerplate(node, False, False):
            continue
        named = _marked(node)
        kind = "main" if "main" in node.attributes().get("role", "").lower().split() else node.tag
        if kind == "article":
            found["named" if named else "wrapped" if within else "article"].append(node)
            continue
        if kind in found:
            found[kind].append(node)
        stack += [(p, within or (named and kind not in ("html", "body", "main"))) for p in reversed(node.parts) if isinstance(p, Node)]
    return found["article"] or found["wrapped"] or found["main"][:1] or found["named"] or found["body"][:1] or [root]


def removable(root: Node) -> list[Node]:
    """The subtrees that may be template: containers without prose; within a marked article only those all of whose text is links."""
    tops = articles(root)
    marked = {id(t) for t in tops if t.tag in ("article", "main") or t.attributes().get("role")}
    out, stack = [], [(root, False)]
    while stack:
        node, within = stack.pop()
        within = within or id(node) in marked
        if node.tag in CONTAINERS and id(node) not in marked and not (node.bare if within else node.prose):
            out.append(node)
        stack += [(p, within) for p in node.parts if isinstance(p, Node)]
    return out


def text_of(root: Node, template: set[int]) -> str:
    """The text of the articles without template and boilerplate subtrees."""
    able = {id(n) for n in removable(root) if n.hash in template} if template else set()
    tops = articles(root)
    return _text(tops, able, True) or _text(tops, able, False)


def _text(tops: list[Node], able: set[int], names: bool) -> str:
    pieces: list[str] = []
    for top in tops:
        stack: list = [(top, True)]
        while stack:
            node, first = stack.pop()
            if isinstance(node, str):
                pieces.append(node)
                continue
            if not first and (id(node) in able or boilerplate(node, top.tag == "article", names)):
                pieces.append(" ")
                continue
            gap = [] if node.tag in INLINE else [(" ", False)]
            stack += [*gap, *[(p, False) for p in reversed(node.parts)], *gap]
    return " ".join(html.unescape("".join(pieces)).split())


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page, of the whole html."""
    short_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents, hashes = [], [], []
            for where, content, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                root = parse(source)
                set_hashes(root)
                own = {n.hash for n in removable(root)}
                hosts += [where] * len(own)
                contents += [content] * len(own)
                hashes += [h - (1 << 63) for h in own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "content", "subtree"])

    content = F.xxhash64("html").alias("content")
    held = base.select("host", content, "html").mapInArrow(subtrees, "host string, content bigint, subtree bigint").distinct()
    template = durable(held.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "subtree"))
    size = template.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()
    if size["rows"] <= BROADCAST_ROWS and size["most"] <= HOST_ROWS:
        lists = template.groupBy("host").agg(F.collect_list("subtree").alias("template"))
        joined = base.join(F.broadcast(lists), "host", "left")
    else:
        known = F.broadcast(template) if size["rows"] <= BROADCAST_ROWS else template
        lists = held.join(known, ["host", "subtree"]).groupBy("host", "content").agg(F.collect_list("subtree").alias("template"))
        joined = base.withColumn("content", content).join(lists, ["host", "content"], "left")
    joined = joined.select("page_id", "url", "html", "template")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sets = [], {}
            for source, known in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                key = known.values.to_numpy().tobytes() if known.is_valid else b""
                if key not in sets:
                    sets[key] = {h + (1 << 63) for h in known.values.to_pylist()} if key else set()
                root = parse(source)
                if sets[key]:
                    set_hashes(root)
                out.append(text_of(root, sets[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, "page_id bigint, url string, text string, n_chars bigint")
