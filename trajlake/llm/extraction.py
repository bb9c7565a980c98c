"""Main text of web pages: structure names the article, site templates are counted per host and removed.

Every element that is not inline has a hash of its subtree (tags and text).  Spark counts on how many different pages of
a host a subtree stands, and subtrees that recur across many of them are template, wherever they stand: if they recur
beside the content, from ``OUTSIDE_SHARE`` of the host's pages (notices and adverts rotate), if within it, where a
passage may recur by itself, from ``INSIDE_SHARE``.  What lies in marked furniture is not counted apart.  The content is
the article, or the main element, or the whole body where there is neither.  Pages count as different by the smallest
hash of three words in a row in their longest block, so that copies and near copies of one text, which share all its
subtrees, count about once.  A second pass deletes the templates with what tags, roles and class names mark as menus,
headers, footers, sidebars, notices, adverts, forms, scripts and comments, and returns the rest of the content, one line
per block.  A host with few pages shows no recurrence; there the markup alone decides.

Defined results: NULL or empty html has an empty text; a NULL URL or one without a host has no templates, only the
structural rules; unclosed and misnested elements end with the element around them; very long pages are read whole;
repeated rows are extracted row by row and count as one page; an empty table gives an empty result.  Only ``page_id``,
``url`` and ``html`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import table, written
from trajlake.llm.urls import host_of

OUTSIDE_SHARE, OUTSIDE_PAGES = 0.01, 3
INSIDE_SHARE, INSIDE_PAGES = 0.7, 20
SHINGLE = 3
MIX = np.uint64(0x9E3779B97F4A7C15)
PAGE = 0
UNFINISHED = re.compile("<[a-zA-Z/!?]")
SEEN = pa.schema([("host", pa.string()), ("subtree", pa.int64()), ("inside", pa.bool_()), ("sketch", pa.int64())])

# Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPES = frozenset("html body table td th ul ol dl select button object article".split())
SILENT = frozenset("script style noscript template head title iframe object svg canvas audio video".split())
FURNITURE = frozenset("nav footer aside form menu button select textarea dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice pagination popup promo "
    "promoted related replies share sharing sidebar social sponsor sponsored subscribe widget".split()
)


class Page(HTMLParser):
    """Elements of one page with their subtree hashes, and its events in page order: (element, opens), text, (element, closes)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.marked, self.inside, self.covered, self.hashes = [], [], [], [], []
        self.parts: list[list[bytes]] = []
        self.open: list[int] = []
        self.counts: dict[str, int] = {}
        self.events: list[tuple[int, str | None]] = []
        self.feed(html)
        if UNFINISHED.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self._close_to(0)
        if "article" not in self.counts and "main" not in self.counts:
            self.inside = [True] * len(self.inside)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._end_nearest(("p",))
        if tag in SIBLINGS:
            self._end_nearest(SIBLINGS[tag])
        element = len(self.tags)
        content = self.counts.get("article", 0) + self.counts.get("main", 0) > 0
        self.tags.append(tag)
        self.inside.append(content)
        parent = self.open[-1] if self.open else -1
        self.covered.append(parent >= 0 and (self.covered[parent] or self.marked[parent]))
        self.marked.append(self._furniture(tag, attrs, content))
        self.hashes.append(0)
        self.parts.append([])
        self.events.append((element, None))
        self.open.append(element)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag in VOID:
            self._close_to(len(self.open) - 1)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if not self.counts.get(tag):
            return
        for at in range(len(self.open) - 1, -1, -1):
            here = self.tags[self.open[at]]
            if here == tag:
                return self._close_to(at)
            if tag in INLINE and here not in INLINE:
                return None
        return None

    def handle_data(self, data: str) -> None:
        self.events.append((-1, data))
        if self.open:
            self.parts[self.open[-1]].append(" ".join(data.split()).encode("utf-8", "surrogatepass"))

    @staticmethod
    def _furniture(tag: str, attrs: list[tuple[str, str | None]], content: bool) -> bool:
        if tag in FURNITURE or tag in SILENT or tag == "header" and not content:
            return True
        if tag in ("html", "body", "main", "article"):
            return False
        for name, value in attrs:
            if name == "role" and value and value.strip().lower() in ROLES:
                return True
            if name in ("class", "id") and value and not NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value.lower())):
                return True
            if name == "hidden":
                return True
        return False

    def _end_nearest(self, tags: tuple[str, ...]) -> None:
        if not any(self.counts.get(t) for t in tags):
            return
        for at in range(len(self.open) - 1, -1, -1):
            here = self.tags[self.open[at]]
            if here in tags:
                self._close_to(at)
                if "td" not in tags or here == tags[0]:
                    return
            elif here in SCOPES:
                return

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            element = self.open.pop()
            tag, parts = self.tags[element], [p for p in self.parts[element] if p]
            self.counts[tag] -= 1
            self.events.append((element, ""))
            self.parts[element] = []
            if parts and tag not in SILENT:
                digest = blake2b(b"\0".join((tag.encode("utf-8", "surrogatepass"), *parts)), digest_size=8).digest()
                self.hashes[element] = int.from_bytes(digest, "big", signed=True)
                if self.open:
                    self.parts[self.open[-1]].append(digest)

    def content(self) -> set[int]:
        """The elements whose text counts: outermost main or article elements; empty for the whole page."""
        for tag in ("main", "article"):
            found, depth = set(), 0
            for element, what in self.events:
                if element >= 0 and self.tags[element] == tag:
                    if what is None:
                        found |= set() if depth else {element}
                    depth += 1 if what is None else -1
            if found:
                return found
        return set()

    def counted(self) -> set[tuple[int, bool]]:
        """(hash, inside) of the subtrees to count: not inline, with text, and not within furniture."""
        rows = zip(self.hashes, self.inside, self.covered, self.tags, strict=True)
        return {(h, inside) for h, inside, covered, tag in rows if h and not covered and tag not in INLINE}

    def blocks(self, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
        """The content's blocks without furniture and without the listed subtrees."""
        wanted = self.content()
        out, text = [], []
        taken, dropped = 0 if wanted else 1, 0

        def end_block() -> None:
            line = " ".join("".join(text).split())
            if line:
                out.append(line)
            text.clear()

        for element, what in self.events:
            if element < 0:
                if taken and not dropped:
                    text.append(what)
                continue
            step = 1 if what is None else -1
            if self.tags[element] not in INLINE:
                end_block()
            elif self.tags[element] == "br":
                text.append(" ")
            if element in wanted:
                taken += step
            elif self.marked[element] or self.hashes[element] in template:
                dropped += step
        end_block()
        return out


def _sketch(blocks: list[str]) -> int:
    """The smallest hash of three words in a row in the longest block: equal for texts that are largely the same."""
    words = max(blocks, key=len, default="").encode("utf-8", "surrogatepass").split()
    codes = np.fromiter(map(crc32, words), np.uint64, len(words))
    if len(codes) < SHINGLE:
        return crc32(b" ".join(words))
    rolled = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        rolled = (rolled ^ codes[k : len(codes) - SHINGLE + 1 + k]) * MIX
        rolled ^= rolled >> np.uint64(29)
    return int(rolled.min() >> np.uint64(1))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, html in zip(batch["host"], batch["html"], strict=True):
            page = Page(html.as_py())
            host, sketch = host.as_py(), _sketch(page.blocks())
            rows += [(host, subtree, inside, sketch) for subtree, inside in page.counted() | {(PAGE, False)}]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SEEN.types, strict=True)], schema=SEEN) if rows else SEEN.empty_table().to_batches()[0]


def templates(pages: DataFrame) -> DataFrame:
    """(host, template: array of subtree hashes) of ``pages`` (host, html)."""
    seen = pages.filter((F.col("host") != "") & F.col("html").isNotNull()).select("host", "html")
    seen = seen.mapInArrow(_subtrees, "host string, subtree long, inside boolean, sketch long").distinct()
    counted = seen.groupBy("host", "subtree", "inside").agg(F.count("*").alias("pages")).filter((F.col("subtree") == PAGE) | (F.col("pages") >= OUTSIDE_PAGES))
    # A host's own row and those of its subtrees meet in one aggregation.
    listed = F.collect_list(F.when(F.col("subtree") != PAGE, F.struct("subtree", "inside", "pages")))
    hosts = counted.groupBy("host").agg(F.max(F.when(F.col("subtree") == PAGE, F.col("pages"))).alias("all"), listed.alias("listed"))
    share = lambda x: F.when(x["inside"], F.lit(INSIDE_SHARE)).otherwise(F.lit(OUTSIDE_SHARE)) * F.col("all")
    least = lambda x: F.when(x["inside"], F.lit(INSIDE_PAGES)).otherwise(F.lit(OUTSIDE_PAGES))
    kept = F.filter("listed", lambda x: (x["pages"] >= share(x)) & (x["pages"] >= least(x)))
    return hosts.select("host", F.array_distinct(F.transform(kept, lambda x: x["subtree"])).alias("template")).filter(F.size("template") > 0)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            "\n".join(Page(html.as_py() or "").blocks(set(template.values.to_numpy().tolist()) if template.is_valid else frozenset()))
            for html, template in zip(batch["html"], batch["template"], strict=True)
        ]
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("host"), "html")
    joined = rows.join(written(templates(rows)), "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op12(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
