"""Main text of web pages, with site templates removed.

Every page becomes a tree of elements. Each subtree with text is hashed; Spark counts
on how many different pages of a host each hash occurs; subtrees that recur on many
pages of their host are deleted. Pages are different if the texts of their articles
are (of their bodies, without article or main element), so copies count as one page
and the containers of a copied article are no templates. Then elements go whose kind, class or role marks menus,
headers, footers, sidebars, notices, adverts, forms, scripts and comments, and the
text of the article is read off, block by block; of several articles, or main
elements, all are read in page order.

A class or id is such a mark as a whole name: it consists of words for those parts,
and of words that say nothing, such as ``ad-box`` or ``site-footer``, but not
``has-sidebar`` or ``comments-open``. If a page marks no article, an element whose
name is a mark, other than of comments, stays if it holds nearly all text of the page.

Inside an element that the page itself marks as its article, prose (paragraphs,
headings, list items, quotes) is never taken for a template, as copies of one article
recur too; containers are. Without such an element the whole body is searched.

Edge cases: a null or empty page has an empty text; a null url, or one without a
host, belongs to no site, so nothing of it is a template; hosts with fewer than
``LEAST`` different pages have none; repeated rows count as one page; broken markup is read as far
as it goes; nesting of any depth and pages of any length are read whole. ``extract``
keeps other columns and refuses a clash with ``text``, ``n_chars``, ``_host``, ``_templates`` and ``_salt``.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import persisted, slices, without

#: A subtree is a template from this many different pages on, and this share of the host's.
LEAST, SHARE = 5, 0.3
#: Hashes of templates that are looked up by broadcast (under 100 bytes each); beyond, hosts are joined.
BROADCAST = 100_000
#: Parts that the pages of a host are dealt to in that join.
SALTS = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open paragraph.
_ENDS_P = BLOCK - {"br", "option", "caption", "tbody", "thead", "tfoot", "td", "th", "tr", "body", "html", "legend"}
#: Elements that an element of the same group ends, up to the element that holds them.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("table td th caption button object template".split())
DROP = frozenset("script style noscript template iframe object embed applet canvas svg math audio video form input button select textarea label fieldset nav footer aside menu dialog head title meta link frameset noframes".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre code td th tr b i em strong a span br q cite sup sub u s small mark abbr time".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MARKS = frozenset(
    "nav navbar navigation menu menubar sidebar footer masthead breadcrumb breadcrumbs ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal newsletter subscribe subscription comment comments disqus respond share sharing social related recommended widget pagination pager skip login signup".split()
)
#: Marks of reader comments, which go however long they are.
COMMENTS = frozenset("comment comments disqus respond".split())
#: Words that say nothing about a part of a page beside a mark.
PLAIN = frozenset(
    "area article aside bar block blocks bottom box button buttons col column container content form global group head heading icons inner item items left link links list main module outer page panel post posts primary region right row secondary section site slot stories story text title top unit wrap wrapper".split()
)
#: Share of the text that an element must hold to stay despite its name.
HOLDS = 0.9
_TAG = re.compile(r"<([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
_TOKEN = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


class Node:
    """An element: kind, attributes that matter, children (elements and strings)."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if source.strip(" /\t\n"):
        for name, value in _ATTR.findall(source):
            low = name.lower()
            if low in ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop") and low not in out:
                out[low] = _html.unescape(value.strip("\"'")).lower()
    return out


def parse(source: str) -> Node:
    """The tree of a page; every character outside markup ends up in some string."""
    root = Node("#root", {})
    stack = [root]
    opened: dict[str, int] = {}
    pos, size = 0, len(source)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    def close(tags, stop) -> None:
        if any(opened.get(t) for t in tags):
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag in tags:
                    pop_to(d)
                    return
                if stack[d].tag in stop:
                    return

    while pos < size:
        lt = source.find("<", pos)
        if lt < 0:
            stack[-1].children.append(source[pos:])
            break
        if lt > pos:
            stack[-1].children.append(source[pos:lt])
        after = source[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4 if not source.startswith("<!-->", lt) else lt + 2)
                pos = size if end < 0 else end + 3
            else:
                end = source.find(">", lt)
                pos = size if end < 0 else end + 1
        elif after == "/" and source[lt + 2 : lt + 3].isalpha():
            end = source.find(">", lt)
            tag = re.split(r"[\s/]", source[lt + 2 : end if end >= 0 else size], maxsplit=1)[0].lower()
            pos = size if end < 0 else end + 1
            if opened.get(tag):
                for d in range(len(stack) - 1, 0, -1):
                    if stack[d].tag == tag:
                        pop_to(d)
                        break
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
        elif after.isalpha() and after.isascii():
            m = _TAG.match(source, lt)
            if m:
                tag, attrs, pos = m[1].lower(), _attributes(m[2]), m.end()
            else:  # an unclosed quotation mark or the end of the page
                end = source.find(">", lt)
                tag, attrs, pos = re.match(r"[A-Za-z0-9]+", source[lt + 1 : lt + 40])[0].lower(), {}, size if end < 0 else end + 1
            if tag in _ENDS_P:
                close(("p",), _SCOPE)
            if tag in _SIBLINGS:
                close(*_SIBLINGS[tag])
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag in RAW:
                end = _END[tag].search(source, pos)
                pos = size if end is None else end.end()
            elif tag not in VOID:
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
        else:
            stack[-1].children.append("<")
            pos = lt + 1
    return root


def _named(node: Node) -> frozenset[str]:
    """The marks in the class and id of an element, of names that are marks as a whole."""
    found: set[str] = set()
    for key in ("class", "id"):
        for name in node.attrs.get(key, "").split():
            parts = set(_TOKEN.findall(name))
            if parts & MARKS and parts <= MARKS | PLAIN:
                found |= parts & MARKS
    return frozenset(found)


def _marked(node: Node, spared: frozenset[int] = frozenset()) -> bool:
    """Whether kind, class or role say that an element isn't part of an article; ``spared`` stay despite their names."""
    if node.tag in DROP:
        return True
    a = node.attrs
    if not a or node.tag in ("body", "html", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    return id(node) not in spared and bool(_named(node))


def _spared(root: Node) -> frozenset[int]:
    """Elements with a mark for a name, but not of comments, that hold nearly all text outside other marked elements."""
    held: list[int] = [0]
    named: list[tuple[int, int]] = []
    skip = 0
    for node, enter in _walk(root):
        marks = _named(node) if node.attrs else frozenset()
        gone = bool(marks & COMMENTS) or node.tag == "header" or _marked(node, frozenset((id(node),)))
        if enter:
            skip += gone
            held.append(0 if skip else sum(len(c) for t in node.children if isinstance(t, str) for c in t.split()))
        else:
            skip -= gone
            own = held.pop()
            held[-1] += own
            if marks and not gone:
                named.append((id(node), own))
    return frozenset(n for n, own in named if own and own >= held[0] * HOLDS)


def _walk(root: Node):
    """(node, whether entering) of all elements, without recursion."""
    stack = [(root, True)]
    while stack:
        node, enter = stack.pop()
        yield node, enter
        if enter:
            stack.append((node, False))
            stack.extend((c, True) for c in reversed(node.children) if isinstance(c, Node))


def _outermost(root: Node, spared: frozenset[int]) -> list[Node]:
    found: dict[str, list[Node]] = {"article": [], "main": []}
    skip, inside, in_main = 0, 0, 0
    for node, enter in _walk(root):
        drop = _marked(node, spared) or (node.tag == "header" and not inside)
        article = node.tag == "article" or node.attrs.get("itemprop") == "articlebody"
        main = node.tag == "main" or node.attrs.get("role") == "main"
        if enter:
            if not skip and not drop:
                if article and not inside:
                    found["article"].append(node)
                if main and not in_main:
                    found["main"].append(node)
            skip += drop
            inside += article
            in_main += main
        else:
            skip -= drop
            inside -= article
            in_main -= main
    return found["article"] or found["main"]


def _articles(root: Node) -> tuple[list[Node], frozenset[int]]:
    """The outermost elements that the page marks as its article, outside marked elements, or its main elements; and the spared elements."""
    found = _outermost(root, frozenset())
    if found:
        return found, frozenset()
    spared = _spared(root)
    return (_outermost(root, spared) if spared else []), spared


def hashes(root: Node) -> dict[int, list[Node]]:
    """Hashes of the subtrees that may be templates, each with its elements."""
    prose = set()
    for article in _articles(root)[0]:
        prose.update(id(n) for n, enter in _walk(article) if enter and (n.tag in PROSE or n is article))
    digests: dict[int, bytes] = {}
    out: dict[int, list[Node]] = {}
    for node, enter in _walk(root):
        if enter:
            continue
        h, some = hashlib.blake2b(node.tag.encode(), digest_size=8), False
        for c in node.children:
            if isinstance(c, Node):
                d = digests.pop(id(c), None)
                if d is not None:
                    h.update(b"<" + d)
                    some = True
            elif text := " ".join(c.split()):
                h.update(b"=" + text.encode("utf-8", "surrogatepass") + b"\0")
                some = True
        if some:
            digests[id(node)] = h.digest()
            if node.tag not in ("#root", "html", "body", "head", "main") and id(node) not in prose:
                out.setdefault(int.from_bytes(h.digest(), "little", signed=True), []).append(node)
    return out


def text_of(source: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The main text of a page without the subtrees whose hashes are ``templates``."""
    if not source:
        return ""
    root = parse(source)
    if templates:
        gone = {id(n) for h, nodes in hashes(root).items() if h in templates for n in nodes}
    else:
        gone = set()
    articles, spared = _articles(root)
    texts = [_blocks(a, gone, True, spared) for a in articles] or [_blocks(root, gone, False, spared)]
    return " ".join(t for t in texts if t)


def page_key(root: Node) -> int:
    """A hash of the text that tells different pages of a host from copies of one: of all articles or main, else of the body."""
    articles, spared = _articles(root)
    texts = [_blocks(a, set(), True, spared) for a in articles] or [_blocks(root, set(), False, spared)]
    h = hashlib.blake2b("\0".join(texts).encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(h.digest(), "little", signed=True)


def _blocks(root: Node, gone: set[int], in_article: bool, spared: frozenset[int]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            if text := " ".join(_html.unescape("".join(line)).split()):
                blocks.append(text)
            line.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            end()
        elif id(x) in gone or (x is not root and (_marked(x, spared) or (x.tag == "header" and not in_article))):
            if x.tag in BLOCK:
                end()
        else:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return " ".join(blocks)


def host() -> Column:
    """The host of ``url``, in lower case, without user and port; null if there is none."""
    found = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def templates(pages: DataFrame) -> DataFrame:
    """(_host, hash) of the subtrees that recur on many pages of their host."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            hosts, found, keys = [], [], []
            for name, source in zip(batch.column("_host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                root = parse(source)
                mine = [None, *hashes(root)]  # null stands for the page itself
                hosts += [name] * len(mine)
                found += mine
                keys += [page_key(root)] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(keys, pa.int64())], names=["_host", "hash", "page"])

    sited = pages.select(host().alias("_host"), "html").where("_host is not null and html is not null")
    counts = sited.mapInArrow(run, "_host string, hash long, page long").groupBy("_host", "hash").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= LEAST)
    counts = persisted(counts, "counts")
    sizes = counts.where("hash is null").select("_host", F.col("n").alias("pages"))
    return counts.where("hash is not null").join(sizes, "_host").where(F.col("n") >= F.col("pages") * SHARE).select("_host", "hash")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its length in code points."""
    without(pages, "text", "n_chars", "_host", "_templates", "_salt")
    found = persisted(templates(pages), "templates")
    # A host has fewer templates than its mean page has subtrees, over SHARE: its list is bounded.
    lists = found.groupBy("_host").agg(F.collect_list("hash").alias("_templates"))
    sited = pages.withColumn("_host", host())
    if found.count() <= BROADCAST:
        joined = sited.join(F.broadcast(lists), "_host", "left")
    else:  # a host with a third of all pages is dealt to SALTS tasks
        salted = sited.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
        joined = salted.join(lists.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["_host", "_salt"], "left")
    joined = joined.select(*pages.columns, "_templates")
    names = pages.columns
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            sets = [frozenset(t or ()) for t in batch.column("_templates").to_pylist()]
            texts = [text_of(s, t) for s, t in zip(batch.column("html").to_pylist(), sets, strict=True)]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return joined.mapInArrow(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its main text and the length."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
