"""Main text of web pages, with removal of the templates of their sites.

Every element subtree of a page's main roots outside the prose of an explicit article is hashed. Spark counts in how
many different contents (main roots) of a host each hash stands, so copies of a page are one; subtrees that recur in
several are the host's template and are deleted, besides the
elements that are never main text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed, pieces_of

#: A subtree is template if it stands in so many different contents of its host.
LEAST_PAGES = 5
#: Rows of template hashes, and hashes of pages that hold any, that are broadcast at most; more go by a shuffle.
BROADCAST_ROWS = 1 << 20
SALTS = 16

#: A quote opens a value only after an equals sign, as browsers read it; elsewhere it is a part of a name.
VALUE = r"=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*+|)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|{VALUE})*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
SPACE = re.compile(r"\s+")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = {"head", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "embed", "button", "select", "option", "textarea", "input", "label", "dialog", "menu", "svg", "canvas", "audio", "video", "map", "title", "xmp", "noembed", "noframes"}
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "status", "tablist", "toolbar"}
#: A class or id made of these words, and of words of LAYOUT, between - and _ names something else than main text.
NEVER_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "promoted", "promotion", "related", "reply", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
LAYOUT = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "group", "header", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "small", "top", "unit", "wrap", "wrapper"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "li"}
#: An opening tag of the key ends an open element of the value, up to the nearest element of CLOSE_STOP.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_STOP = {"ul", "ol", "dl", "table", "select", "menu", "body", "html"}


@dataclass(eq=False)
class Node:
    tag: str
    names: tuple[str, ...] = ()
    role: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)  # Node or str
    digest: int = 0
    size: int = 0


class Open:
    """The open elements. What an end tag or an implied end looks for is counted, so that a search that finds nothing
    costs nothing, and one that finds something closes all it has passed."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.by_name: Counter = Counter()
        self.blocks, self.inline = [0], [Counter()]  # places of open blocks, inline elements since each
        self.items = [Counter()]  # list items and cells since the last list or table

    def push(self, node: Node) -> None:
        self.by_name[node.tag] += 1
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
            self.inline.append(Counter())
        else:
            self.inline[-1][node.tag] += 1
        if node.tag in CLOSE_STOP:
            self.items.append(Counter())
        elif node.tag in ENDS:
            self.items[-1][node.tag] += 1
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            tag = self.nodes.pop().tag
            self.by_name[tag] -= 1
            if tag in CLOSE_STOP:
                self.items.pop()
            elif tag in ENDS:
                self.items[-1][tag] -= 1
            if tag in BLOCK:
                self.blocks.pop()
                self.inline.pop()
            else:
                self.inline[-1][tag] -= 1

    def last(self, tags: set[str]) -> int:
        k = len(self.nodes) - 1
        while self.nodes[k].tag not in tags:
            k -= 1
        return k

    def end(self, tag: str) -> None:
        """An end tag; that of an inline element does not close a block around it."""
        if (self.by_name if tag in BLOCK else self.inline[-1])[tag]:
            self.cut(self.last({tag}))

    def make_room(self, tag: str) -> None:
        """Ends that the start of ``tag`` implies."""
        if tag in BLOCK and self.nodes[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in ENDS:
            while any(self.items[-1][t] for t in ENDS[tag]):
                self.cut(self.last(ENDS[tag]))


def parse(source: str) -> Node:
    """A tree of the page; unclosed and misnested tags are repaired as browsers do in the common cases."""
    root = Node("#root")
    opened = Open(root)
    at = 0
    while at < len(source):
        mark = source.find("<", at)
        if mark < 0:
            mark = len(source)
        if mark > at:
            opened.nodes[-1].children.append(entities.unescape(source[at:mark]))
        if mark == len(source):
            break
        m = TOKEN.match(source, mark)
        if m is None:
            opened.nodes[-1].children.append("<")
            at = mark + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            opened.end(tag)
            continue
        opened.make_room(tag)
        node = _node(tag, m[3] or "")
        opened.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            node.children.append(source[at : end.start()])
            at = end.end()
        elif tag not in VOID:
            opened.push(node)
    return root


def _node(tag: str, rest: str) -> Node:
    names, role, hidden = (), "", False
    if rest.strip():
        for k, a, b, c in ATTRIBUTE.findall(rest):
            k, v = k.lower(), a or b or c
            if k in ("class", "id"):
                names += tuple(entities.unescape(v).lower().split())
            elif k == "role":
                role = v.strip().lower()
            elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
                hidden = True
    return Node(tag, names, role, hidden)


def excluded(node: Node) -> bool:
    return node.tag in NEVER or node.role in NEVER_ROLES or node.hidden or any(map(other_than_text, node.names))


@lru_cache(1 << 14)
def other_than_text(name: str) -> bool:
    parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
    return not NEVER_NAMES.isdisjoint(parts) and all(x in NEVER_NAMES or x in LAYOUT for x in parts)


def main_roots(root: Node) -> list[Node]:
    """The outermost articles (else main elements, else the page) that neither are nor lie in an excluded element."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if excluded(node):
                continue
            if node.tag == wanted:
                found.append(node)
            else:
                todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
        if found:
            return found
    return [root]


def headings(node: Node) -> list[Node]:
    """The headings below a node, in page order."""
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS:
            found.append(x)
        elif x is node or not excluded(x):
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return found


def digests(root: Node) -> tuple[int, list[int]]:
    """Hash every subtree (tag, names, children in order; white space made one); return the hash of the main roots
    and those of the subtrees in them that may be template: all but excluded ones and the prose of articles."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        h = xxhash.xxh64(f"{node.tag} {' '.join(node.names)} {node.role}\0")
        node.size = 0
        for c in node.children:
            if isinstance(c, Node):
                h.update(c.digest.to_bytes(8, "little", signed=True))
                node.size += c.size
            elif line := SPACE.sub(" ", c).strip():
                h.update(b"\1" + line.encode("utf-8", "surrogatepass"))
                node.size += len(line)
        node.digest = h.intdigest() - (1 << 63)
    mains = main_roots(root)
    explicit = mains[0] is not root
    found: set[int] = set()
    todo = [c for m in mains for c in m.children if isinstance(c, Node)]
    while todo:
        node = todo.pop()
        if excluded(node):
            continue
        if node.size and node.tag not in ("html", "body") and not (explicit and (node.tag in PROSE or node.tag not in BLOCK)):
            found.add(node.digest)
        if not (explicit and node.tag in PROSE):
            todo.extend(c for c in node.children if isinstance(c, Node))
    content = xxhash.xxh64(b"".join(m.digest.to_bytes(8, "little", signed=True) for m in mains)).intdigest() - (1 << 63)
    return content, sorted(found)


def main_text(root: Node, template: set[int]) -> str:
    """The blocks of the main roots in page order, one a line, without excluded and template subtrees."""
    lines: list[str] = []
    held: list[str] = []

    def flush():
        if line := SPACE.sub(" ", "".join(held)).strip():
            lines.append(line)
        held.clear()

    mains = main_roots(root)
    explicit = mains[0] is not root
    for main in mains:
        todo: list = [(main, False)]
        while todo:
            item, prose = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                held.append(item)
            elif item.tag == "br":
                held.append(" ")
            elif item.tag == "header" and explicit and not (item.hidden or item.role in NEVER_ROLES or any(map(other_than_text, item.names))):
                todo.extend((h, prose) for h in reversed(headings(item)))  # an article's own header holds its title
            elif item is main or not (excluded(item) or item.digest in template and not prose and not (explicit and (item.tag in PROSE or item.tag not in BLOCK))):
                block = item.tag in BLOCK
                if block:
                    flush()
                    todo.append((None, False))
                todo.extend((c, prose or explicit and item.tag in PROSE) for c in reversed(item.children))
        flush()
    return "\n".join(lines)


def host_of(url: str) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url)
    return m[1].lower().rstrip(".") if m else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """Rows (page_id, url, text), one for each input row.

    Null and empty html have the empty text; null url and page_id are kept, a url without a host counts as one
    host of its own. Character references are decoded, white space within a block is one space, blocks are joined
    by a newline. Repeated rows are kept; pages of one host and equal main roots count once. A page of which
    template leaves nothing keeps its text. Rows with one page_id and one host share their template hashes. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "html", 4 << 20):
            urls, sources = piece.column("url").to_pylist(), piece.column("html").to_pylist()
            found = [digests(parse(x or "")) for x in sources]
            hosts = pa.array([host_of(u or "") for u in urls], pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), hosts, pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["page_id", "host", "content", "hashes"])

    # One row a page: its hashes are a small part of its size.
    pages_seen = checkpointed(rows.mapInArrow(hashes, "page_id long, host string, content long, hashes array<long>"))
    seen = pages_seen.select("page_id", "host", F.explode("hashes").alias("hash"))
    # Equal main roots have equal hashes.
    votes = pages_seen.dropDuplicates(["host", "content"]).select("host", F.explode("hashes").alias("hash"))
    recurring = votes.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).select("host", "hash")
    recurring = checkpointed(recurring)
    keyed = seen.withColumn("salt", F.pmod(F.xxhash64("page_id", "hash"), F.lit(SALTS)))
    if recurring.count() <= BROADCAST_ROWS:
        held = keyed.join(F.broadcast(recurring), ["host", "hash"])
    else:  # a template of a large host is split over tasks
        held = keyed.join(recurring.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")), ["host", "hash", "salt"])
    own = checkpointed(held.groupBy("page_id", "host").agg(F.collect_set("hash").alias("template")))
    size = own.agg(F.coalesce(F.sum(F.size("template") + 8), F.lit(0)).alias("n")).first()["n"]
    own = F.broadcast(own) if size <= BROADCAST_ROWS else own
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    placed = rows.withColumn("host", F.regexp_replace(host, r"\.+$", "")).alias("r")
    same = F.col("r.page_id").eqNullSafe(F.col("o.page_id")) & (F.col("r.host") == F.col("o.host"))
    joined = placed.join(own.alias("o"), same, "left").select("r.page_id", "r.url", "r.html", "o.template")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "html", 4 << 20):
            out = []
            for source, template in zip(piece.column("html").to_pylist(), piece.column("template").to_pylist(), strict=True):
                root = parse(source or "")
                if template:
                    digests(root)
                # Copies under changing surroundings: what recurs is the text itself.
                out.append(main_text(root, set(template or ())) or main_text(root, set()))
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(texts, "page_id long, url string, text string")
