"""Main text of web pages, with site templates removed by recurrence.

First pass: every block element is hashed with its whole subtree (tags and text, without attributes), from the
hashes of its children, and Spark counts on how many different pages of its host each hash
occurs; copies of one page count once. Subtrees on at least ``min_pages`` pages and ``share`` of the
host's pages are site template, whatever their tags and names. Second pass: they are deleted, together with what its own markup
tells to be no content (menus, footers, adverts, forms, comments and so on, by tag, role, class and id;
of classes and ids only whole names such as ``sidebar`` or ``share-buttons``, and never on what holds
the page's article or most of its text, nor inside an article on prose or by id);
of the rest, the article is the largest ``article`` element, else ``main``, else the body, there
without lists that are mostly links. Paragraphs and headings of an article are never template,
however often they recur, and neither is the article itself or an element that holds over half of its text.
Pages that no template concerns are not shuffled, and html is read in slices of a bounded size.

Text: character references are decoded, white space inside a block becomes one space, ``br`` counts as
white space, and blocks are joined in page order by a blank line. Defined cases: null and empty html
give the empty text; a null or hostless url has no templates; unclosed, crossed and stray tags are
closed as browsers do in the common cases; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .probe import Probe
from .staging import stage
from .words import slices

#: pages and share of its host's pages that make a subtree a template
MIN_PAGES, SHARE = 4, 0.02

# tags of HTML by what they mean here (fixed values)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg annotation annotation-xml object canvas audio video".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr br img math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot
mstyle mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mtable mtr mtd""".split())
_PROSE = frozenset("""p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption
figure figcaption hr""".split())
_CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split())
_ITEMS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_NO_CONTENT = frozenset("nav header footer aside form button select dialog menu fieldset head datalist".split())
_NO_ROLE = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar
form tablist""".split())
_NO_CLASS = frozenset("""ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion
banner cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription paywall signup
login share sharing social menu nav navbar navigation breadcrumb breadcrumbs sidebar sidenav footer header masthead topbar
comment comments disqus replies respond related recommended recommendations widget pagination pager toolbar skip
""".split())

# words that may stand beside one of these in a class or id
_BESIDE = frozenset("""bar block box button buttons container icon icons item items links list section slot unit wrap wrapper
site page main top bottom left right primary secondary post""".split())
# in an article these are its own title, or remarks
_ARTICLE_CLASS = frozenset("header banner masthead notice notification".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*>|\?[^>]*>|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "children", "bad", "main", "inside", "size", "links", "anchors", "named")

    def __init__(self, tag: str, bad: bool, main: str, inside: bool):
        self.tag, self.bad, self.main, self.inside = tag, bad, main, inside
        self.children: list = []  # nodes, and decoded texts
        self.size = self.links = self.anchors = 0
        self.named = False  # bad by class or id alone


def _named(tag: str, found: dict, inside: bool) -> bool:
    """Whether a class or id is, as a whole, a name of what is no content."""
    if tag in ("html", "body", "main") or tag in _HEADINGS or inside and tag in _PROSE and tag not in ("ul", "ol", "li"):
        return False
    names = found.get("class", "").split() + ([] if inside else [found.get("id", "").strip()])
    for name in names:
        words = set(re.split(r"[^a-z0-9]+", name.lower())) - {""}
        told = words & _NO_CLASS - (_ARTICLE_CLASS if inside else frozenset())
        if told and words <= told | _BESIDE:
            return True
    return False


def _judge(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element's own markup says that it is no content, whether its class or id alone does, and
    which kind of article it is, if any."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes or "hidden" in attributes else {}
    role = found.get("role", "").lower()
    bad = (tag in _NO_CONTENT and not (tag == "header" and inside)) or role in _NO_ROLE or "hidden" in found \
        or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    named = not bad and bool(found) and _named(tag, found, inside)
    bad = bad or named
    kind = "" if bad else "article" if tag == "article" or found.get("itemprop", "").lower() == "articlebody" \
        else "main" if tag == "main" or role == "main" else ""
    return bad, named, kind


def parse(html: str) -> Node:
    """The element tree of a page; unknown and broken markup is read as leniently as needed."""
    root = Node("#root", False, "", False)
    stack, at, low, any_named = [root], 0, None, False
    open_: dict[str, int] = {}  # so that no search up a deep stack is in vain

    def close(n: int) -> None:
        while len(stack) > n:
            node = stack.pop()
            open_[node.tag] -= 1
            stack[-1].size += node.size
            stack[-1].links += node.size if node.tag == "a" else node.links
            stack[-1].anchors += node.anchors + (node.tag == "a")

    def add(text: str) -> None:
        text = unescape(text) if "&" in text else text
        stack[-1].children.append(text)
        stack[-1].size += len(text.strip())

    while True:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for n in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[n].tag == tag:
                    close(n)
                    break
            continue
        if tag in _RAW:
            if low is None:
                low = html.lower() if html.isascii() else "".join(c.lower() if c.isascii() else c for c in html)
            if not m[0].endswith("/>"):
                end = low.find(f"</{tag}", at)
                end = len(html) if end < 0 else end
                gt = html.find(">", end)
                at = len(html) if gt < 0 else gt + 1
            continue
        if tag in _VOID:
            stack[-1].children.append(" " if tag in ("br", "wbr") else Node(tag, False, "", False) if tag == "hr" else "")
            continue
        if tag in _CLOSES_P and open_.get("p"):
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == "p":
                    close(n)
                    break
                if stack[n].tag not in _INLINE:
                    break
        if tag in _ITEMS:
            same, within = _ITEMS[tag]
            for n in range(len(stack) - 1, 0, -1) if any(open_.get(t) for t in same.split()) else ():
                if stack[n].tag in within:
                    break
                if stack[n].tag in same.split():
                    close(n)
                    break
        inside = stack[-1].inside or bool(stack[-1].main)
        bad, named, kind = _judge(tag, m[3], inside)
        node = Node(tag, bad, kind, inside)
        node.named, any_named = named, any_named or named
        stack[-1].children.append(node)
        if not m[0].endswith("/>") or tag not in ("a", "b", "i", "span"):
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
        else:
            stack[-1].anchors += tag == "a"
    close(1)
    if any_named:
        _spare(root)
    return root


def _spare(root: Node) -> None:
    """A class or id can't tell that what holds the only article, or most of the text, is no content."""
    article = _article(root)
    if article is None:
        article = _article(root, named=True)
        holders = _holders(root, article)
        for node in _walk(root):
            if id(node) in holders and node.named:
                node.bad = False
    top = article or root
    for node in _walk(top):
        if node.named and node.size * 2 > top.size:
            node.bad = False


def _walk(node: Node):
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def digests(root: Node) -> dict[int, bytes]:
    """Hash of each element's subtree, by node: its tag, its texts and its children's hashes. Attributes, case and
    white space don't count."""
    out: dict[int, bytes] = {}
    todo: list = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo.extend((x, False) for x in node.children if isinstance(x, Node))
            continue
        parts, text = [node.tag.encode("utf-8", "replace")], []
        for x in [*node.children, None]:
            if isinstance(x, str):
                text.append(x)
                continue
            words = " ".join("".join(text).lower().split())
            text.clear()
            if words:
                parts.append(b"t" + _digest(words.encode("utf-8", "replace")))
            if x is not None:
                parts.append(b"n" + out[id(x)])
        out[id(node)] = _digest(b"\0".join(parts))
    return out


def _templated(node: Node, holds_article: set, article: Node | None) -> bool:
    """Whether recurrence may delete an element: a block with text that neither is, nor holds, nor is prose or most of an article."""
    return bool(node.size) and node.tag not in ("#root", "html", "body") and node.tag not in _INLINE \
        and id(node) not in holds_article and not (node.inside and (node.tag in _PROSE or article is not None and node.size * 2 > article.size))


def _article(root: Node, dropped=frozenset(), hashes=None, named: bool = False) -> Node | None:
    """The largest article, else main; none if the page has neither outside of what goes. ``named``: also
    inside of what only a class or id tells to be no content."""
    best: dict[str, Node] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.bad and not (named and node.named) or hashes and hashes.get(id(node)) in dropped:
            continue
        if node.main and node.size > (best[node.main].size if node.main in best else 0):
            best[node.main] = node
        todo.extend(x for x in node.children if isinstance(x, Node))
    return best.get("article") or best.get("main")


def _holders(root: Node, article: Node | None) -> set:
    """The article and the elements around it."""
    if article is None:
        return set()
    path: list = []

    def find(node: Node) -> bool:
        todo = [(node, 0)]
        while todo:
            node, depth = todo.pop()
            del path[depth:]
            path.append(node)
            if node is article:
                return True
            todo.extend((x, depth + 1) for x in node.children if isinstance(x, Node))
        return False

    find(root)
    return {id(n) for n in path}


def subtree_hashes(root: Node) -> dict[int, tuple[int, bool]]:
    """(hash, shown) of the elements that recurrence may delete, by node; not of what is inside of one that its markup
    deletes. Shown: the element would be part of the text."""
    article = _article(root)
    holds, found, out = _holders(root, article), digests(root), {}
    todo = [(root, article is None)]
    while todo:
        node, shown = todo.pop()
        shown = shown or node is article
        if node.bad or _templated(node, holds, article):
            out[id(node)] = int.from_bytes(found[id(node)], "big", signed=True), shown and not node.bad
        if not node.bad:
            todo.extend((x, shown) for x in node.children if isinstance(x, Node))
    return out


def extract(html: str, dropped: frozenset = frozenset()) -> str:
    """Main text of a page, without the subtrees whose hashes are given."""
    if not html:
        return ""
    root = parse(html)
    hashes = {k: h for k, (h, shown) in subtree_hashes(root).items() if shown} if dropped else {}
    article = _article(root, dropped, hashes)
    top = article or root
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            blocks.append(text)

    todo: list = [top]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            now.append(node)
            continue
        if node is None:
            flush()
            continue
        if node is not top and (node.bad or hashes.get(id(node)) in dropped if dropped else node.bad):
            if node.tag not in _INLINE:
                flush()
            continue
        links = article is None and node.tag in ("ul", "ol", "div", "table", "dl") and node.links * 10 > node.size * 8
        if links and node.anchors > 2:
            flush()
            continue
        if node.tag not in _INLINE:
            flush()
            todo.append(None)
        todo.extend(reversed(node.children))
    flush()
    return "\n\n".join(blocks)


def host_of(url):
    """Host of a url column, lower case; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hash_rows(batches):
    """(host, page, body, hash, shown): one row for each distinct hash of a page; body stands for its whole content."""
    for batch in batches:
        for first, column in slices(batch.column(2)):
            rows: list = []
            some = batch.slice(first, len(column))
            for host, page, html in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), column.to_pylist()):
                found: dict[int, bool] = {}
                for h, shown in subtree_hashes(parse(html)).values() if html and host else ():
                    found[h] = found.get(h, False) or shown
                body = int.from_bytes(_digest((html or "").encode("utf-8", "replace")), "big", signed=True)
                rows += [(host, page, body, h, shown) for h, shown in (found | {0: False}).items()]  # 0 stands for the page itself
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                                  ["host", "page", "body", "hash", "shown"])


def _texts(batches):
    """page_id, url, text and n_chars of rows (page, page_id, url, html) and, where given, dropped."""
    for batch in batches:
        for first, column in slices(batch.column(3)):
            some = batch.slice(first, len(column))
            dropped = some.column(4).to_pylist() if batch.num_columns > 4 else [None] * len(column)
            out = [extract(h or "", frozenset(d or ())) for h, d in zip(column.to_pylist(), dropped)]
            yield pa.record_batch([some.column(1), some.column(2), pa.array(out, pa.string()),
                                   pa.array(np.fromiter(map(len, out), np.int64, len(out)))], ["page_id", "url", "text", "n_chars"])


def templates(rows: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, hash) of site template: subtrees on many different pages of their host."""
    counts = rows.groupBy("host", "hash", "body").agg(F.lit(1).alias("one")).groupBy("host", "hash").agg(F.count("one").alias("n"))
    total = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    return (counts.where((F.col("hash") != 0) & (F.col("n") >= min_pages)).join(total, "host")
            .where(F.col("n") >= F.col("pages") * share).select("host", "hash"))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    out = "page_id long, url string, text string, n_chars long"
    keyed = pages.select(F.xxhash64("page_id", "url", "html").alias("page"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = stage(keyed.select(host_of(F.col("url")).alias("host"), "page", "html")
                 .mapInArrow(_hash_rows, "host string, page long, body long, hash long, shown boolean"), "html-hashes")
    hits = stage(rows.where("shown").join(templates(rows, min_pages, share), ["host", "hash"])
                 .groupBy("page").agg(F.collect_set("hash").alias("dropped")), "html-hits")
    if hits.isEmpty():
        return keyed.mapInArrow(_texts, out)
    probe = Probe(hits.select("page"))
    clear = probe.keep(False)
    doubtful = keyed.mapInArrow(probe.keep(True), keyed.schema).join(hits, "page", "left")
    return (keyed.mapInArrow(lambda batches: _texts(clear(batches)), out)
            .union(doubtful.select("page", "page_id", "url", "html", "dropped").mapInArrow(_texts, out)))
