"""HTML extraction with site template removal.

1. Every page is read once into a stream of elements. Each element's subtree (tag, text, children) is hashed; with the hash goes
   a hash of the page's own main text.
2. Spark counts, per host and subtree hash, on how many pages with different main texts the subtree occurs, so copies of one article don't make its
   parts look like a template. Subtrees on at least ``least_pages`` such pages, and ``least_share`` of the host's, are the host's template.
   A subtree that isn't mostly links must be on ``often_share`` of the host's if it is inside an article or is or holds a paragraph, heading or other CONTENT.
3. Pages are joined with the template subtrees they hold (a bounded list each), those are deleted, and the main text is written.

What is main text besides: scripts, styles, forms, menus, footers, sidebars and other elements that say what they are by tag, role, class
or id are left out; if a page marks its article (or main part), only that is kept. Paragraphs, headings, quotations, tables and the like
inside the article are never template by themselves: a licence line that many articles share is part of each; a div, section or list that recurs is,
with what it holds. Elements that hold the article are never deleted.

An article in a wrapper that is left out by its tag or name (a form around the page, "modal-open"), or one so named itself, is the page's article if no other
is marked; if the page has more text outside of the wrapper, both are kept. Of several, those in the fewest wrappers count. Articles in elements
that hold those of other pages (BOXED) are taken only if the page has no text else; in comments, asides, scripts and templates never.

Blocks are block-level elements; white space inside a block becomes one space (``<br>`` is such white space), blocks are joined by a line feed.
Character references are decoded after markup is split. Broken markup: unclosed elements end where HTML says or with the page.

Null or empty html: empty text. Null url: a host of its own. Repeated rows and null ids: one row each. Empty table: empty result. Further columns aren't read.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEAST_PAGES = 4
LEAST_SHARE = 0.01
OFTEN_SHARE = 0.2

TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)|</?[a-zA-Z][^>]*(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([a-zA-Z-]+)""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe svg canvas object embed dialog menu noembed noframes audio video map datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tfoot tr td th caption figure figcaption dl dt dd address li article main".split())
#: Opening one of these ends an open p.
ENDS_P = BLOCK - {"body", "html", "tbody", "tfoot", "thead", "tr", "caption", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMED = re.compile(
    r"^(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notice\w*|popup\w*|modal|overlay|newsletter\w*|subscri\w*|sidebar\w*|sidenav|rail|nav|navbar\w*|navigation|menu\w*|"
    r"breadcrumb\w*|footer\w*|masthead|topbar|comment\w*|disqus\w*|replies|reply|respond|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|toolbar|pagination|pager|login|signup|search\w*|skip)$"
)
#: Elements left out whose articles are other pages' ...
BOXED = re.compile(r"^(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|related\w*|recommend\w*|widget\w*|sidebar\w*|sidenav|rail|nav|navbar\w*|navigation|menu\w*|footer\w*)$")
BOXED_TAGS = frozenset("nav footer button dialog menu".split())
#: ... and none at all.
COMMENT = re.compile(r"^(?:comment\w*|disqus\w*|replies|reply|respond)$")
#: What an element left out counts: its articles are taken in the order of the sum, below NEVER.
KEPT, WRAPPER, BOX, NEVER = 0, 1, 1_000, 1_000_000
HEADER_NAMED = re.compile(r"^(?:header\w*|banner)$")
LAYOUT = frozenset("has layout main no page site with without".split())
BREAK = None


def _attributes(raw: str) -> dict[str, str]:
    return {(k or bare).lower(): _html.unescape(v.strip("\"'")) for k, v, bare in ATTRIBUTE.findall(raw)}


class _Element:
    __slots__ = ("tag", "start", "says_no", "drops", "holds_article", "in_article", "parts", "text", "link_text", "content", "articles")

    def __init__(self, tag: str, start: int, says_no: int, drops: int, in_article: bool):
        self.tag, self.start, self.says_no, self.drops, self.in_article = tag, start, says_no, drops, in_article
        self.holds_article, self.parts, self.text, self.link_text = False, [], 0, 0
        self.content = tag in CONTENT
        self.articles: list[str | None] = []  # what stays if the element is left out


def _says_no(tag: str, raw: str, in_article: bool) -> int:
    """Whether an element is none of the article by its tag or by what its attributes say, and what that means for articles in it."""
    no = KEPT
    if tag in DROPPED or tag == "header" and not in_article:
        no = WRAPPER if tag in ("form", "header") else BOX if tag in BOXED_TAGS else NEVER
    if no == NEVER or not raw or tag in ("html", "body"):
        return no
    a = _attributes(raw)
    role = a.get("role", "").lower()
    if role in ROLES:
        no = max(no, NEVER if role == "complementary" else WRAPPER if role in ("form", "search", "banner") else BOX)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        no = max(no, BOX)
    # a name of several parts ("post-comments") is judged by each, unless it describes a layout ("page-with-sidebar")
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if not LAYOUT.intersection(parts):
            for p in parts:
                if NAMED.match(p) or not in_article and HEADER_NAMED.match(p):
                    no = max(no, NEVER if COMMENT.match(p) else BOX if BOXED.match(p) else WRAPPER)
    return no


def _blocks(tokens: list[str | None]) -> str:
    blocks, block = [], []
    for t in [*tokens, BREAK]:
        if t is BREAK:
            if words := "".join(block).split():
                blocks.append(" ".join(words))
            block = []
        else:
            block.append(t)
    return "\n".join(blocks)


class Page:
    """A page read with the hashes of its host's template, and of its part found often (none on the first reading)."""

    def __init__(self, source: str, template: frozenset[int] = frozenset(), often: frozenset[int] = frozenset()):
        self.template, self.often = template, often
        self.out: list[str | None] = []
        self.saved: dict[str, dict[int, list[str | None]]] = {"article": {}, "main": {}}
        self.subtrees: set[int] = set()
        self.stack = [_Element("", 0, KEPT, KEPT, False)]
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = TAG.search(source, at)
            if not m:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._open(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._close()
            elif tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                self._close()
        while len(self.stack) > 1:
            self._close()

    def _add(self, raw: str) -> None:
        text = _html.unescape(raw)
        if text:
            self.out.append(text)
            shown = " ".join(text.split())
            if shown:
                top = self.stack[-1]
                top.parts.append(shown)
                top.text += len(shown)

    def _open(self, tag: str, raw: str) -> None:
        if tag in ENDS_P:
            self._end_open({"p"}, {"article", "section", "div", "table", "td", "th", "body", "main", "blockquote", "li"})
        if tag in SIBLINGS:
            self._end_open(SIBLINGS[tag], SCOPES[tag])
        if tag == "br":
            self.out.append(" ")
        if tag in BLOCK:
            self.out.append(BREAK)
        parent = self.stack[-1]
        in_article = parent.in_article or tag in ("article", "main")
        says_no = NEVER if parent.drops >= NEVER else _says_no(tag, raw, parent.in_article)
        self.stack.append(_Element(tag, len(self.out), says_no, parent.drops + says_no, in_article))

    def _end_open(self, tags: set[str], scope: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                while len(self.stack) > k:
                    self._close()
                return
            if self.stack[k].tag in scope:
                return

    def _end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._close()
                return

    def _close(self) -> None:
        e = self.stack.pop()
        parent = self.stack[-1]
        if e.tag == "a":
            e.link_text = e.text
        h = 0
        if e.text:
            h = int.from_bytes(hashlib.blake2b("\x00".join([e.tag, *e.parts]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            parent.parts.append(str(h))
            parent.text += e.text
            parent.link_text += e.link_text
            parent.content = parent.content or e.content
        marks = outer = None
        if e.tag in ("article", "main") and e.drops < NEVER and e.text:
            outer = next((x for x in self.stack if x.tag in ("article", e.tag) and x.drops < NEVER), None)
            marks = outer is None or outer.drops == e.drops  # not what an article leaves out
        holds = marks and e.drops < BOX
        deletable = e.tag in BLOCK and e.tag not in ("html", "body") and not e.holds_article and not marks
        if deletable and parent.in_article:  # in an article only what isn't its content
            deletable = e.tag not in CONTENT
        if deletable and e.text:
            self.subtrees.add(h)
        template = self.often if (parent.in_article or e.content) and 2 * e.link_text <= e.text else self.template
        if deletable and h in template:
            del self.out[e.start :]
        if marks and outer is None:
            self.saved[e.tag].setdefault(e.drops, []).extend([*self.out[e.start :], BREAK])
        if holds:
            e.articles = [BREAK, *self.out[e.start :], BREAK]
        if e.says_no:
            self.out[e.start :] = e.articles
        if holds or e.holds_article:
            parent.holds_article = True
            if parent.articles:
                parent.articles += e.articles
            else:
                parent.articles = e.articles  # the element is done with it
        if e.tag in BLOCK:
            self.out.append(BREAK)

    def text(self) -> str:
        """Blocks of the article, else of the main part, else of the page."""
        article, main = ({d: t for d, tokens in self.saved[tag].items() if (t := _blocks(tokens))} for tag in ("article", "main"))
        if KEPT in article:
            return article[KEPT]
        page = main[KEPT] if KEPT in main else _blocks(self.out)
        marked = article or main
        least = min(marked, default=KEPT)
        if KEPT < least < BOX and len(page) <= 2 * len(marked[least]) and (KEPT not in main or marked[least] in page):
            return marked[least]
        return page or marked.get(least, "")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, often_share: float = OFTEN_SHARE) -> DataFrame:
    """One row per input row: id, url, text and n_chars (code points)."""
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(html_col, F.lit("")).alias("_html"))
    base = base.withColumn("_host", F.xxhash64(host_of(F.col("_url")))).withColumn("_key", F.xxhash64("_url", "_html"))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                own, main = [], []
                for source in batch.column(2).to_pylist():
                    page = Page(source)
                    own.append(sorted(page.subtrees))
                    main.append(int.from_bytes(hashlib.blake2b(page.text().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(main, pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["_host", "_key", "main", "own"])

    read = base.select("_host", "_key", "_html").mapInArrow(subtrees, "_host long, _key long, main long, own array<long>")
    read = written(read, "html-subtrees")
    texts = read.groupBy("_host", "main").agg(F.lit(1).alias("x")).groupBy("_host").agg(F.count(F.lit(1)).alias("of")).withColumnRenamed("_host", "h2")
    each = read.select("_host", "main", F.explode("own").alias("subtree")).distinct().groupBy("_host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    template = each.join(texts, F.col("_host") == F.col("h2")).where(F.col("n") >= least_share * F.col("of")).select(F.col("_host").alias("h3"), F.col("subtree").alias("s3"), (F.col("n") >= often_share * F.col("of")).alias("often"))
    template = written(template, "html-template")
    held = read.select("_host", "_key", F.explode("own").alias("subtree")).join(template, (F.col("_host") == F.col("h3")) & (F.col("subtree") == F.col("s3")))
    lists = held.groupBy("_key").agg(F.collect_set("subtree").alias("gone"), F.collect_set(F.when(F.col("often"), F.col("subtree"))).alias("often")).withColumnRenamed("_key", "k2")  # at most a page's elements
    joined = base.join(lists, F.col("_key") == F.col("k2"), "left").select("_id", "_url", "_html", "gone", "often")
    kinds = {c: base.schema[c].dataType.simpleString() for c in ("_id", "_url")}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [Page(s, frozenset(g or ()), frozenset(o or ())).text() for s, g, o in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(write, f"`{id_col}` {kinds['_id']}, `{url_col}` {kinds['_url']}, text string, n_chars long")
