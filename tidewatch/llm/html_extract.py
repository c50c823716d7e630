"""Main text of web pages by consensus host paths.

Each page is read into blocks of text below containers. Containers are scored by the unlinked text of their blocks; the path of the
best one, its ancestors' tags with their first class or id and digits generalised, is the page's vote. Votes are counted per host, and
each page is read again for the path of its host that has most votes and occurs in it: a page whose longest part is not its article follows
the other pages of the host. Without such a path its own best one stands.

Paths are named by a running hash, so nesting of any depth costs a page no more than its length. Pages are not shuffled unless the
winning paths are too large for Spark to broadcast; then both sides are spread over `SALTS` keys per host.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .url_filter import host_of

#: Elements whose content is not text, elements without content, elements that begin a block, and elements of no article.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("html body div section article main p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address center details summary fieldset legend header footer nav aside form dialog menu search head".split())
DROP = frozenset("nav header footer aside form noscript template svg math canvas audio video object button select dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: First or last words of classes and ids of such elements, and those of reader comments.
WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification"
    " alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations trending pagination pager toolbar".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond responses discussion disqus".split())
NOT = frozenset("has no with without is js".split())
#: Leaves: blocks that are no containers of an article. A start tag of a key ends an open element of its values, up to the nearest of the stops.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd caption tr thead tbody tfoot pre blockquote figure figcaption address summary legend ul ol dl".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
STOPS = frozenset("ul ol dl table menu div section article main body".split())
#: Paths with this share of a host's votes are its winners; keys of a host if pages have to be shuffled.
SHARE, SALTS = 0.02, 64

_TAG = re.compile(r"""<(?:(!--)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([!?/A-Za-z]))""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


class Page:
    """The elements and blocks of a page. Elements: parent, path, tag, why they are dropped; blocks: element, text, unlinked characters."""

    def __init__(self, html: str):
        self.parent, self.path, self.tag, self.drop = [-1], [b"body"], ["body"], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._open, self._parts, self._link, self._linked, self._mute = [0], Counter(), [], False, 0, 0
        self._read(html)
        self._flush()
        gone = [False]
        for p, d in zip(self.parent[1:], self.drop[1:], strict=True):
            gone.append(bool(d) or gone[p])
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while m := _TAG.search(html, at):
            self._text(html[at : m.start()])
            at = m.end()
            comment, close, name, attributes, _ = m.groups()
            if comment:
                found = html.find("-->", at)
                at = at + 1 if html.startswith(">", at) else found + 3 if found >= 0 else end
            elif not name:  # a declaration, or a tag with an open quote: it ends at the next >
                at = html.find(">", at) + 1 or end
            elif close:
                self._end(name.lower())
            elif name.lower() in RAW:
                found = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = found.end() if found else end
            else:
                self._start(name.lower(), attributes)
        self._text(html[at:])

    def _text(self, text: str) -> None:
        if text and not self._mute:
            text = unescape(text) if "&" in text else text
            self._parts.append(text)
            if self._link:
                self._linked += len(text)

    def _flush(self) -> None:
        """Ends the block that is being read."""
        text = " ".join("".join(self._parts).split())
        if text:
            own = next(i for i in reversed(self._stack) if self.tag[i] in BLOCK)
            self.blocks.append((own, text, max(0, len(text) - self._linked)))
        self._parts.clear()
        self._linked, self._link = 0, False

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text(" ")
        elif name == "a":
            self._link = True
        elif name == "hr":
            self._flush()
        if name in VOID or name in ("a", "html", "head"):
            return
        block = name in BLOCK
        if block:
            self._flush()
            self._close_implied(name)
        if name == "body":
            return
        had = {k.lower(): (a or b or c).strip() for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        drop = self._why(name, had)
        if not block and (not drop or attributes.endswith("/")):
            return
        if name in ("article", "main") and not drop:  # what holds an article is no menu by its class, and no form
            for i in self._stack:
                if self.drop[i] in ("class", "form"):
                    self.drop[i] = ""
        label = had.get("class", "").split()[:1] or had.get("id", "").split()[:1]
        step = f"/{name}.{_DIGITS.sub('#', label[0].lower())}" if label else f"/{name}"
        above = self._stack[-1]
        self.parent.append(above)
        self.path.append(blake2b(self.path[above] + step.encode("utf-8", "replace"), digest_size=12).digest())
        self.tag.append(name)
        self.drop.append(drop)
        self._stack.append(len(self.tag) - 1)
        self._open[name] += 1
        self._mute += not block  # a dropped element within a block

    def _close_implied(self, name: str) -> None:
        """Ends what a block's start tag ends: an open paragraph, an item before an item, a cell before a cell."""
        if self.tag[self._stack[-1]] == "p":
            self._pop()
        for i in range(len(self._stack) - 1, 0, -1) if name in ENDS else ():
            tag = self.tag[self._stack[i]]
            if tag in STOPS:
                break
            if tag in ENDS[name]:
                while len(self._stack) > i:
                    self._pop()

    def _pop(self) -> None:
        tag = self.tag[self._stack.pop()]
        self._open[tag] -= 1
        self._mute -= tag not in BLOCK

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = False
        elif name == "br":
            self._text(" ")
        elif self._open[name]:
            if name in BLOCK:
                self._flush()
            while True:
                tag = self.tag[self._stack[-1]]
                self._pop()
                if tag == name:
                    break
        elif name == "p":
            self._flush()

    def _why(self, name: str, had: dict[str, str]) -> str:
        """Why an element is no part of an article: its tag, role or class, or a form; empty if it is."""
        if name == "form":
            return "form"
        if name in DROP:
            return "tag"
        if had.get("role", "").lower() in ROLES:
            return "role"
        for value in (*had.get("class", "").split(), *had.get("id", "").split()):
            words = [w.lower() for w in _WORD.findall(value)]
            if words and words[0] not in NOT and (COMMENTS & {words[0], words[-1]} or name not in ("article", "main", "body") and WORDS & {words[0], words[-1]}):
                return "class"
        return ""

    def scores(self) -> dict[bytes, float]:
        """Path -> unlinked characters: of a container's own blocks, half of those one container further down, and all within an article."""
        found: dict[bytes, float] = {}
        article = [-1] * len(self.tag)  # the outermost around each element
        up = [0] * len(self.tag)  # the container around or at each element
        for i, (p, tag) in enumerate(zip(self.parent, self.tag, strict=True)):
            article[i] = article[p] if p >= 0 and article[p] >= 0 else i if tag == "article" else -1
            up[i] = up[p] if p >= 0 and (tag in LEAVES or tag not in BLOCK) else i
        for i, _, n in self.blocks:
            own = up[i]
            gets = {own: 1.0}
            if self.parent[own] >= 0:
                gets[up[self.parent[own]]] = 0.5
            if article[i] >= 0:
                gets[article[i]] = 1.0
            for k, share in gets.items():
                found[self.path[k]] = found.get(self.path[k], 0.0) + share * n
        return found

    def best(self) -> tuple[bytes, float] | None:
        """The path with the highest score and its share of all; of equal ones the outermost, which comes first in the page."""
        found = self.scores()
        if not found:
            return None
        first: dict[bytes, int] = {}
        for i, p in enumerate(self.path):
            first.setdefault(p, i)
        path = min(found, key=lambda p: (-found[p], first[p]))
        return path, found[path] / (sum(found.values()) or 1.0)

    def text(self, path: bytes) -> str:
        """The blocks below all elements of a path, in page order."""
        inside: list[bool] = []
        for p, own in zip(self.parent, self.path, strict=True):
            inside.append(own == path or p >= 0 and inside[p])
        return "\n".join(t for i, t, _ in self.blocks if inside[i])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(host.as_py(), *found) for host, html in zip(*batch.columns, strict=True) if (found := Page(html.as_py() or "").best())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.float64()))], names=["host", "path", "share"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [read_page(html.as_py(), paths.as_py()) for html, paths in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def read_page(html: str | None, paths: list[bytes] | None) -> str:
    """The text below the first of the paths that the page has text at, else below its own best one."""
    page = Page(html or "")
    for path in paths or ():
        if path in page.path and (text := page.text(path)):
            return text
    own = page.best()
    return page.text(own[0]) if own else ""


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and its paths with at least `SHARE` of its pages' votes (1 / SHARE of them at most), the most wanted first."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path binary, share double")
    counted = written(votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("share"), 6).alias("share")), "votes")
    total = counted.groupBy("host").agg(F.sum("n").alias("total"))
    best = counted.join(total, "host").where(F.col("n") >= SHARE * F.col("total"))
    return best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("share")).alias("share"), "path"))), lambda p: p["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html gives an empty text. Null urls and those without :// are pages of the host ''. Pages that repeat are voters and
    rows each. White space is what Unicode calls so; <br> is white space, not the end of a block. Broken markup (open quotes, tags and
    comments) is read as far as it goes. An empty table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")
    winners = written(winning_paths(pages), "winners")  # its size is known before the join: small ones are broadcast
    salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = pages.withColumns({"host": host_of(F.col("url")), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    joined = keyed.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "paths")
    out = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(_texts, out)
