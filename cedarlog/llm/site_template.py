"""Main text of web pages: subtrees that recur across a host's pages are its template.

Each page is read into a tree of elements. A subtree is hashed from its tag, class, id,
text and the hashes of its children. Spark counts on how many addresses of a host each
hash occurs; subtrees found on many of them are deleted from that host's pages. What a
page says about itself follows: navigation, headers, footers, sidebars, forms, notices,
adverts, comments and hidden elements by tag, role or name, for pages whose template is
rare. Inside a marked article (``article``, ``main``, such roles or names) prose is never
template, however often it recurs; only subtrees made mostly of links are.

* NULL and empty html give an empty text. A NULL address, or one without a host, belongs
  to no host: nothing recurs there, and only the second step applies.
* Equal addresses count once, so repeated rows and captures do not make a template. Each
  row is extracted for itself, whatever its id.
* Whole pages are read, of any length, in time linear in their length; a page is one row
  of one task.
* Broken markup is read as browsers do: missing and stray end tags, unquoted attributes,
  references without a semicolon, an end inside a tag. Text in no element is kept.
* Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cedarlog.session import fits_broadcast, materialize

#: Template subtrees of all hosts together up to which they are broadcast (8 bytes each).
BROADCAST_TEMPLATES = 1_000_000
#: Copies of each host's templates, so that a host with a third of all pages is many tasks.
SALTS = 64
#: Bytes of html a Python worker turns into trees before it hands them on.
BATCH_BYTES = 4 << 20

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[a-z]+(?![a-z])|[A-Z][a-z]*")

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that neither part text nor have a subtree of their own.
PLAIN = frozenset(
    "abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr output picture q rp rt ruby s samp"
    " small source strike strong sub sup time tt u var wbr".split()
)
INLINE = PLAIN | {"a", "span"}
HEAD_PARTS = frozenset("base link meta noscript script style template title".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: What a start tag ends besides, as far as the nearest of the elements named second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Where the search for an end tag's start stops.
SCOPE = frozenset("table td th caption template object html".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())

DROP_TAGS = frozenset(
    "head script style noscript template nav footer aside button select textarea title iframe object canvas svg dialog menu noembed"
    " noframes applet audio video datalist".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog alertdialog tablist".split())
MAIN_ROLES = frozenset(["main", "article"])
MAIN_NAMES = frozenset("article article-body articlebody content main main-content maincontent post post-body post-content entry entry-content story story-body".split())
#: Parts of class names and ids that name what is not the article.
DROP_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar"
    " breadcrumb breadcrumbs sidebar masthead footer cookie cookies consent gdpr notice newsletter subscribe subscription social share"
    " sharing related recommended recommendations comment comments commentlist respond disqus popup modal overlay banner toolbar pagination"
    " pager login signup".split()
)
#: First parts of names that speak of a page's layout: ``has-sidebar`` is not a sidebar.
LAYOUT = frozenset(["has", "no", "with", "without", "is", "not"])


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _named(names: str) -> bool:
    """Whether a class or id names an element that is not the article."""
    for name in names.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(name)]
        if parts and parts[0] not in LAYOUT and not DROP_NAMES.isdisjoint(parts):
            return True
    return False


class PageTree:
    """Text pieces of a page in order, and for each element which of them are its own.

    ``candidates`` are (hash, first piece, end) of the subtrees that may be template, one
    for each stretch of pieces; ``apart`` the stretches that tag, role or name set apart.
    """

    def __init__(self, source: str) -> None:
        self.pieces: list[str] = []
        self.tags: list[str] = ["#page"]
        self.parents: list[int] = [-1]
        self.firsts: list[int] = [0]
        self.ends: list[int] = [0]
        self.hashes: list[int] = [0]
        self.chars: list[int] = [0]
        self.link_chars: list[int] = [0]
        self.marks: list[tuple[bool, bool, bool]] = [(False, False, False)]  # set apart, main by tag or role, main by name
        self._content: list[list[bytes]] = [[]]
        self._open: list[int] = [0]
        self._of: dict[str, list[int]] = {}
        self._blocks: list[int] = [0]
        self._scopes: list[int] = [0]
        self._read(source)
        while self._open:
            self._close()
        self._judge()

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        name, ids, role = attributes.get("class", ""), attributes.get("id", ""), attributes.get("role", "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        apart = hidden or role in DROP_ROLES or (tag not in PROSE and (_named(name) or _named(ids)))
        main = tag in ("article", "main") or role in MAIN_ROLES or "articlebody" in attributes.get("itemprop", "").lower()
        k = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.firsts.append(len(self.pieces))
        self.ends.append(0)
        self.hashes.append(0)
        self.chars.append(0)
        self.link_chars.append(0)
        self.marks.append((apart, main, any(x.lower() in MAIN_NAMES for x in (*name.split(), *ids.split()))))
        self._content.append([f"{tag}\x02{' '.join(sorted(name.split()))}\x02{ids}".encode("utf-8", "replace")])
        self._open.append(k)
        self._of.setdefault(tag, []).append(k)
        if tag not in INLINE:
            self._blocks.append(k)
        if tag in SCOPE:
            self._scopes.append(k)

    def _close(self) -> None:
        k = self._open.pop()
        if k:
            self._of[self.tags[k]].pop()
            for stack in (self._blocks, self._scopes):
                if stack[-1] == k:
                    stack.pop()
        self.ends[k] = len(self.pieces)
        digest = xxhash.xxh3_64_digest(b"\x00".join(self._content[k]))
        self._content[k] = []
        self.hashes[k] = int.from_bytes(digest, "little", signed=True)
        up = self.parents[k]
        if up >= 0:
            if self.tags[k] == "a":
                self.link_chars[k] = self.chars[k]
            self.chars[up] += self.chars[k]
            self.link_chars[up] += self.link_chars[k]
            self._content[up].append(b"\x01" + digest)

    def _close_to(self, k: int) -> None:
        while self._open[-1] >= k:
            self._close()

    def _innermost(self, tags: set[str]) -> int:
        return max((self._of[t][-1] for t in tags if self._of.get(t)), default=0)

    def _part(self) -> None:
        if self.pieces and self.pieces[-1] != " ":
            self.pieces.append(" ")

    def _say(self, text: str) -> None:
        text = html.unescape(text)
        self.pieces.append(text)
        bare = " ".join(text.split())
        if bare:
            k = self._open[-1]
            self.chars[k] += len(bare)
            self._content[k].append(bare.encode("utf-8", "replace"))

    def _read(self, source: str) -> None:
        at = 0
        token = _TOKEN.search(source)
        while token:
            if token.start() > at:
                self._say(source[at : token.start()])
            at = token.end()
            if token[2]:
                tag = token[2].lower()
                if token[1]:
                    self._end_tag(tag)
                elif token[4]:  # a tag that the page ends in is none
                    at = self._start_tag(tag, token[3], source, at)
            token = _TOKEN.search(source, at)
        if at < len(source):
            self._say(source[at:])

    def _start_tag(self, tag: str, attributes: str, source: str, at: int) -> int:
        if tag in ("html", "body") and self._of.get(tag):
            return at
        if tag not in HEAD_PARTS and self._of.get("head") and tag != "head":
            self._close_to(self._of["head"][-1])
        if tag in ENDS_P and (p := self._of.get("p")) and p[-1] > self._scopes[-1]:
            self._close_to(p[-1])
        if tag in ENDS:
            ended, until = ENDS[tag]
            while (k := self._innermost(ended)) > self._innermost(until):
                self._close_to(k)
        if tag not in INLINE:
            self._part()
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            return close.end() if close else len(source)
        if tag not in VOID and tag not in PLAIN:
            self._start(tag, _attributes(attributes))
        return at

    def _end_tag(self, tag: str) -> None:
        if tag not in INLINE:
            self._part()
        if tag in PLAIN or tag in VOID or tag in ("html", "body"):
            return
        k = self._of[tag][-1] if self._of.get(tag) else 0
        if tag in INLINE:  # does not reach out of its block
            if k > self._blocks[-1]:
                self._close_to(k)
        elif k and (k > self._scopes[-1] or tag in SCOPE):
            self._close_to(k)
            self._part()

    def _judge(self) -> None:
        n = len(self.tags)
        heads, articles = [False] * n, [False] * n  # holds h1 or main; holds an article
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            heads[up] |= heads[k] or self.tags[k] in ("h1", "main")
            articles[up] |= articles[k] or self.marks[k][1]
        apart, mains = [False] * n, []
        for by in (1, 2):  # by tag or role; by name only where nothing is marked so
            inside = [False] * n
            for k in range(1, n):
                up, tag = self.parents[k], self.tags[k]
                named = self.marks[k][0] and not heads[k] and tag not in ("html", "body", "main")
                self_apart = tag in DROP_TAGS or named or (tag == "form" and not articles[k]) or (tag == "header" and not inside[up])
                apart[k] = apart[up] or self_apart
                inside[k] = inside[up] or (self.marks[k][by] and not apart[k])
                if inside[k] and not inside[up] and self.chars[k]:
                    mains.append(k)
            if mains:
                break
        holds = [False] * n
        for k in mains:
            while k >= 0 and not holds[k]:
                holds[k] = True
                k = self.parents[k]
        prose = [t in PROSE for t in self.tags]
        for k in range(n - 1, 0, -1):
            prose[self.parents[k]] |= prose[k]
        seen: set[tuple[int, int]] = set()
        self.candidates: list[tuple[int, int, int]] = []
        self.apart: list[tuple[int, int]] = []
        for k in range(n - 1, 0, -1):
            span = (self.firsts[k], self.ends[k])
            if not self.chars[k]:
                continue
            if apart[k] and not apart[self.parents[k]]:
                self.apart.append(span)
            links = 2 * self.link_chars[k] >= self.chars[k] and not prose[k]
            if holds[k] or self.tags[k] in ("html", "body") or (inside[k] and not apart[k] and not (links and self.tags[k] != "a")):
                continue
            if span not in seen:  # the innermost of elements with the same text
                seen.add(span)
                self.candidates.append((self.hashes[k], *span))


def _trees(kind: pa.DataType):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "pieces", "hashes", "firsts", "ends", "apart_firsts", "apart_ends"]
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        for batch in batches:
            rows: list[tuple] = []
            first, size = 0, 0
            for k in range(batch.num_rows):
                source = batch.column(2)[k].as_py() or ""
                tree = PageTree(source)
                hashes, firsts, ends = zip(*tree.candidates, strict=True) if tree.candidates else ((), (), ())
                a, b = zip(*tree.apart, strict=True) if tree.apart else ((), ())
                rows.append((tree.pieces, hashes, firsts, ends, a, b))
                size += len(source)
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    lists = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.list_(pa.string()), longs, ints, ints, ints, ints), strict=True)]
                    own = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([own.column(0).cast(kind), own.column(1).cast(pa.string()), *lists], names=names)
                    rows, first, size = [], k + 1, 0

    return read


def page_trees(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, the text pieces, and the hashes and stretches of subtrees; written once to the shared folder."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = base.schema["page_id"].dataType
    schema = f"page_id {kind.simpleString()}, url string, pieces array<string>, hashes array<long>, firsts array<int>, ends array<int>, apart_firsts array<int>, apart_ends array<int>"
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    trees = base.mapInArrow(_trees(to_arrow_type(kind)), schema)
    return materialize(trees.withColumn("host", F.nullif(host, F.lit(""))), "page-trees")


def host_templates(trees: DataFrame, min_pages: int = 4, min_share: float = 0.01) -> DataFrame:
    """(host, hash) of the subtrees on at least ``min_pages`` addresses and ``min_share`` of a host's addresses.

    A host has at most (candidates on a page) / ``min_share`` of them, however many pages it has.
    """
    # 0 stands for the page itself; the first grouping is spread by address, so no host is one task
    seen = trees.where("host IS NOT NULL").select("host", F.xxhash64("url").alias("address"), F.explode(F.array_append(F.array_distinct("hashes"), F.lit(0).cast("long"))).alias("hash"))
    counts = seen.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    often = materialize(counts.where((F.col("n") >= min_pages) | (F.col("hash") == 0)), "subtree-counts")
    totals = often.where("hash = 0").select("host", F.col("n").alias("total"))
    if fits_broadcast(totals, BROADCAST_TEMPLATES):
        totals = F.broadcast(totals)
    enough = (F.col("n") >= min_pages) & (F.col("n") >= F.lit(min_share) * F.col("total"))
    return often.where("hash <> 0").join(totals, "host").where(enough).select("host", "hash")


def _texts(kind: pa.DataType):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for row in range(batch.num_rows):
                pieces, hashes, firsts, ends, a, b, template = (batch.column(k)[row].as_py() for k in range(2, 9))
                template = set(template)
                gone = [(f, e) for h, f, e in zip(hashes, firsts, ends, strict=True) if h in template]
                depth = [0] * (len(pieces) + 1)
                for first, end in (*gone, *zip(a, b, strict=True)):
                    depth[first] += 1
                    depth[end] -= 1
                level, kept = 0, []
                for piece, change in zip(pieces, depth, strict=False):
                    level += change
                    kept.append(" " if level else piece)
                texts.append(" ".join("".join(kept).split()))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(kind), batch.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int64())],
                names=["page_id", "url", "text", "n_template"],
            )

    return keep


def extract_text(pages: DataFrame, min_pages: int = 4, min_share: float = 0.01, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template (template subtrees deleted), one row per row of ``pages``."""
    trees = page_trees(pages, id_col, url_col, html_col)
    templates = materialize(host_templates(trees, min_pages, min_share), "host-templates")
    by_host = templates.groupBy("host").agg(F.collect_list("hash").alias("template"))
    if fits_broadcast(templates, BROADCAST_TEMPLATES):
        joined = trees.join(F.broadcast(by_host), "host", "left")
    else:
        by_host = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = trees.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(by_host, ["host", "salt"], "left")
    own = F.coalesce(F.array_intersect("hashes", "template"), F.array().cast("array<bigint>"))
    rows = joined.select("page_id", "url", "pieces", "hashes", "firsts", "ends", "apart_firsts", "apart_ends", own.alias("template"))
    kind = trees.schema["page_id"].dataType
    found = rows.mapInArrow(_texts(to_arrow_type(kind)), f"page_id {kind.simpleString()}, url string, text string, n_template long")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")
