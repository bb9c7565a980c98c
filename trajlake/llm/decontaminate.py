"""Benchmark decontamination by the q-gram lemma in diagonal bands.

Benchmark items are cut into overlapping windows of two lengths: short ones, so close that every excerpt of
``SHORT + SHORT_STRIDE - 1`` characters holds one, and long ones for passages with edits all over.  A text that holds
a window of L characters with k scattered edits shares at least L - q + 1 - k q of its character q-grams with it; if
one run of b characters is dropped, added or replaced (a changed word), L - b - 2 q + 2.  Both lie on diagonals (text
position minus window position) no further apart than the edits.  So the shared q-grams are counted in bands of
diagonals that overlap by half; a band that reaches the lower of the two bounds marks a region, and a banded alignment
decides whether the window really is there within its edits.  The bounds hold for ``EDIT_SHARE`` scattered edits or
one changed run of ``WORD_SHARE``; other mixtures up to ``WORD_SHARE`` are found if they share enough q-grams.

A region's ``windows`` are those that lie side by side in it, so windows inside one another count once.

The index of the benchmark goes to every task, so its size is checked: beyond ``INDEX_CHARS`` characters the items
are taken in blocks, one pass over the texts for each.

Texts are compared with A-Z in lower case and white space characters as spaces, which keeps every position.

Defined results: NULL, empty or short texts hold nothing; NULL or blank items and those shorter than ``LEAST``
characters find nothing; items under 24 characters are found verbatim, those under 40 within one edit; very long texts are searched whole, in pieces that overlap by more than a window; repeated rows are
searched row by row; empty tables give an empty result.  Other columns are not read by the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import table

Q = 12
WINDOW = 120
STRIDE = 40
SHORT = 50
SHORT_STRIDE = 10
LEAST = Q
EDIT_SHARE = 0.05
WORD_SHARE = 0.2
INDEX_CHARS = 1_500_000  # a character is in three long and five short windows
PIECE = 1 << 20
BITS = 22

_MULTIPLIER = 0x9E3779B97F4A7C15
_SPACES = bytes.maketrans(bytes(range(9, 14)), b" " * 5)


def code_points(text: str) -> np.ndarray:
    """Code points with A-Z in lower case and U+0009 to U+000D as spaces; positions stay."""
    plain = text.encode("utf-8", "surrogatepass").lower().translate(_SPACES)
    return np.frombuffer(plain.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``Q`` code points: runs of 1, 2 and 4, joined to 12."""
    if len(c) < Q:
        return np.empty(0, np.uint64)
    h, span, mult = c.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        while span < 4:
            h = h[:-span] * mult + h[span:]
            mult, span = mult * mult, span * 2
        m = len(c) - Q + 1
        h = (h[:m] * mult + h[4 : m + 4]) * mult + h[8 : m + 8]
        return h * np.uint64(_MULTIPLIER)


def edits_allowed(length: int) -> int:
    """Edits of a window that still count as found: a changed word, or in a short item one edit or none."""
    if length < 40:
        return 1 if length >= 2 * Q else 0
    return int(length * WORD_SHARE)


def grams_needed(length: int) -> int:
    """The q-grams that a window keeps under scattered edits or one changed run, whichever leaves fewer."""
    run = edits_allowed(length)
    scattered = min(run, int(length * EDIT_SHARE))
    return max(1, length - Q + 1 - max(scattered * Q, run + Q - 1 if run else 0))


def window_bounds(length: int) -> list[tuple[int, int]]:
    """(start, size) of an item's windows, long ones first."""
    out = {}
    for size, stride in ((WINDOW, STRIDE), (SHORT, SHORT_STRIDE)):
        last = max(0, length - size)
        out |= dict.fromkeys((start, min(size, length)) for start in sorted({*range(0, last, stride), last}))
    return list(out)


class Index:
    """Sorted q-gram hashes of the windows of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.windows: list[tuple[int, int, np.ndarray]] = []  # (item, start, code points)
        hashes, owners, places = [], [], []
        for item, text in items:
            c = code_points(text)
            if len(c) < LEAST or (c == ord(" ")).all():
                continue
            for start, size in window_bounds(len(c)):
                w = c[start : start + size]
                h = gram_hashes(w)
                hashes.append(h)
                owners.append(np.full(len(h), len(self.windows), np.int64))
                places.append(np.arange(len(h), dtype=np.int64))
                self.windows.append((item, start, w))
        joined = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.hashes = joined[order]
        self.owners = np.concatenate(owners)[order] if hashes else np.empty(0, np.int64)
        self.places = np.concatenate(places)[order] if hashes else np.empty(0, np.int64)
        self.need = np.array([grams_needed(len(w)) for _, _, w in self.windows], np.int64)
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - BITS)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, window, window position) of every shared q-gram."""
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - BITS)])
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        where = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        return np.repeat(at, n), self.owners[where], self.places[where]


def banded_distance(window: np.ndarray, text: np.ndarray, k: int, band: int) -> tuple[int, int, int] | None:
    """Least edits of ``window`` against any stretch of ``text`` that begins near its middle diagonal.

    Returns (edits, start, end) in ``text`` or None beyond ``k``.  Only diagonals within ``band`` of the expected
    one, which is ``band`` itself, are computed; row i of the table holds cells j with |j - i - band| <= band.
    """
    width = 2 * band + 1
    size = len(text)
    text = np.append(text, np.zeros(max(0, len(window) + width - len(text)), np.uint32))  # never equal to a window's character
    row = np.zeros(width, np.int64)  # free start: an empty window prefix costs nothing anywhere
    begin = np.arange(width)  # where the stretch of a cell began
    steps = np.arange(width)
    skip, shifted = np.full(width, k + 1), np.zeros(width, np.int64)
    for i in range(len(window)):
        new, origin = row + (text[i : i + width] != window[i]), begin
        skip[:-1], shifted[:-1] = row[1:] + 1, begin[1:]  # a window character without counterpart
        less = skip < new
        new, origin = np.where(less, skip, new), np.where(less, shifted, origin)
        lowest = np.minimum.accumulate(new - steps)  # text characters without counterpart, along the row
        source = np.maximum.accumulate(np.where(new - steps == lowest, steps, 0))
        run = lowest + steps
        less = run < new
        row, begin = np.where(less, run, new), np.where(less, origin[source], origin)
        if row.min() > k:
            return None
    best = int(row.argmin())
    end = len(window) + best
    return (int(row[best]), int(begin[best]), min(end, size)) if row[best] <= k else None


def search(index: Index, c: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, start, end, edits) of every window that the text holds.

    A window inside one that was found is not looked at again in that place, as it adds nothing to the region.
    """
    found = {}
    for shift in range(0, max(1, len(c)), PIECE):
        piece = c[shift : shift + PIECE + 2 * WINDOW]
        text_at, owner, place = index.hits(gram_hashes(piece))
        if not len(text_at):
            continue
        diagonal = text_at - place
        enough = np.bincount(owner, minlength=len(index.windows)) >= index.need
        if not enough.any():
            continue
        text_at, owner, place = (x[enough[owner]] for x in (text_at, owner, place))
        diagonal = text_at - place
        order = np.lexsort((diagonal, owner))
        owner, diagonal = owner[order], diagonal[order]
        edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        held: dict[int, list[tuple[int, int, int, int]]] = {}  # by item: diagonal, start and end in the item, edits
        for lo, hi in zip(edges, np.append(edges[1:], len(owner)), strict=True):
            item, start, w = index.windows[owner[lo]]
            k, need = edits_allowed(len(w)), index.need[owner[lo]]
            d, step = diagonal[lo:hi], k + 1
            lines, counts = np.unique(d, return_counts=True)
            done = [(line + start, e) for line, a, b, e in held.get(item, ()) if a <= start and start + len(w) <= b]
            for at in lines[counts >= need].tolist():  # no gaps: the edits on one diagonal are plain mismatches
                here = piece[max(at, 0) : at + len(w)] if at >= 0 else piece[:0]
                if (at, 0) not in done and len(here) == len(w) and (edits := int((here != w).sum())) <= k:
                    done.append((at, edits))
                    held.setdefault(item, []).append((at - start, start, start + len(w), edits))
                    key, value = (item, start, len(w), shift + at), (edits, shift + at + len(w))
                    found[key] = min(found.get(key, value), value)
            for half in (0, 1):  # bands of width 2 (k + 1) that overlap by half
                band = (d + half * step) // (2 * step)
                cells, counts = np.unique(band, return_counts=True)
                for cell in cells[counts >= need].tolist():
                    base = cell * 2 * step - half * step + step
                    if any(abs(base - at) <= step + e for at, e in done):
                        continue
                    low = max(0, base - 2 * step)
                    got = banded_distance(w, piece[low : low + len(w) + 4 * step + 1], k, 2 * step)
                    if got:
                        edits, a, b = got
                        done.append((low + a, edits))
                        held.setdefault(item, []).append((low + a - start, start, start + len(w), edits))
                        key, value = (item, start, len(w), shift + low + a), (edits, shift + low + b)
                        found[key] = min(found.get(key, value), value)
    return sorted((item, start, a, b, e) for (item, start, _, a), (e, b) in found.items())


def regions(index: Index, text: str | None) -> list[tuple[int, int, int, int, int]]:
    """(item, start, end, windows, edits): overlapping windows of one item joined to regions of the text."""
    out: list[list[int]] = []
    free = 0  # where the last counted window ends
    got = search(index, code_points(text)) if text else []
    for item, _, a, b, e in sorted(got, key=lambda x: (x[0], x[2])):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
            if a >= free:
                out[-1][3], free = out[-1][3] + 1, b
            out[-1][4] = max(out[-1][4], e)
        else:
            out.append([item, a, b, 1, e])
            free = b
    return [tuple(r) for r in out]


FOUND = pa.list_(pa.struct([(f, pa.int64()) for f in ("item_id", "start", "end", "windows", "edits")]))
FOUND_DDL = "array<struct<item_id:bigint,start:bigint,end:bigint,windows:bigint,edits:bigint>>"


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            rows = [[dict(zip(("item_id", "start", "end", "windows", "edits"), r, strict=True)) for r in regions(index, t.as_py())] for t in b.column(1)]
            full = pa.array([i for i, r in enumerate(rows) if r], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(full), pa.array([r for r in rows if r], type=FOUND)], names=["doc_id", "found"])

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read in the order of their ids; the driver holds one block at a time."""
    block, held = [], 0
    items = benchmark.filter(F.col("text").isNotNull() & (F.length("text") >= LEAST)).select("item_id", "text")
    for r in items.sort("item_id", "text").toLocalIterator():
        if held and held + len(r["text"]) > INDEX_CHARS:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
    yield block


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, windows, edits): a row per region of a text that holds part of an item."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        got = docs.select("doc_id", "text").mapInArrow(_find(shared), f"doc_id {kind}, found {FOUND_DDL}")
        out = got if out is None else out.union(got)
    return out.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def op6(spark, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any passage of the benchmark, with their columns; a row is known by its id and the hash of its text."""
    known = docs.select(F.struct("doc_id", F.xxhash64("text").alias("print")).alias("doc_id"), "text")
    found = find_passages(known, table(spark, sf_dir, "benchmark")).select(F.col("doc_id.doc_id").alias("_hit"), F.col("doc_id.print").alias("_hp")).distinct()
    names = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_print"), *names)
    out = rows.join(found, F.col("_doc").eqNullSafe(F.col("_hit")) & (F.col("_print") == F.col("_hp")), "left_anti")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
