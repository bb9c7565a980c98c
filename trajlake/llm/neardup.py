"""Near duplicates by a chosen-path similarity join.

Every distinct shingle set gets a vector of minwise tokens.  In each of several independent trees a node picks two
coordinates of the vector by a hash of its path, and its sets move on to the child named by their token there.
Children with one set end; small ones are compared exhaustively; in a large one every set is compared with one
pivot and branches again.  A pair of similarity s meets in a child with probability s, two children are tried at
each node, so a tree loses a pair of similarity 0.8 about once in 17 times and ``TREES`` trees once in a million.
What is still large at the last level is a group of near copies.  Its members meet again on ``MEETINGS`` single
tokens, where sets outside the largest component are compared with all members, in blocks of bounded size.

Candidates are thinned by the number of agreeing tokens (six standard deviations below the threshold) and by the
exact bound on set sizes, then confirmed on the full shingle sets, read from the texts again.  Confirmation first
ties each set to its smallest likely partner, and then takes only pairs whose components still differ, so a group
of copies costs about one comparison per member.  Equal sets are one node from the start.

Defined results: NULL or blank text has an empty set, is linked with nothing and is its own component; fewer words
than a shingle make one shingle; very long texts are read whole; rows are nodes, so repeated rows form one group; a
NULL ``doc_id`` never names a component unless no member has another; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import let, table, written
from trajlake.llm.components import connected_components, forest_roots, moved_on
from trajlake.session import cut_lineage

TOKENS = 64
TREES = 5
BRANCHES = 2
LEVELS = 4
SMALL_NODE = 16
KNOWN_WORDS = 400_000
CHUNK = 1 << 15
MEETINGS = 9  # a pair of similarity 0.8 agrees on none of them once in two millions
OUTSIDE_BLOCK = 512
MEMBER_BLOCK = 2048


class _WordHashes(dict):
    """64-bit hashes of the words met so far; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: str | None, k: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z lower-cased, split at ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    k = min(k, len(h))
    m = len(h) - k + 1
    out = h[:m].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : m + j]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    odd = rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, TOKENS, dtype=np.uint64)


def minwise_tokens(hashes: np.ndarray, odd: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The smallest value of each of the ``TOKENS`` hash functions over the set, 32 bits each."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        part = (hashes[i : i + CHUNK, None] ^ salt) * odd
        best = np.minimum(best, part.min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


SIGNED = pa.schema([("n", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int32()))])


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (odd, salt) = _WordHashes(), _coefficients()
        for b in batches:
            sizes, keys, sigs = [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), k, known)
                sizes.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sigs.append(minwise_tokens(h, odd, salt) if len(h) else None)
            columns = [pa.array(x, type=f.type) for x, f in zip((sizes, keys, sigs), SIGNED, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], names=["doc_id", "print", *SIGNED.names])

    return run


def signed_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, print, n, key, sig) per row: a hash of the text, the set's size and identity, its minwise tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    return rows.mapInArrow(_sign(k), f"doc_id {kind}, print bigint, n bigint, key binary, sig array<int>")


def _children(node: Column, sig: Column) -> Column:
    """Ids of the children that a set goes to: two different coordinates, chosen by the node."""
    first, stride = F.pmod(node, F.lit(TOKENS)), 1 + F.pmod(F.shiftright(node, 20), F.lit(TOKENS - 1))
    at = [F.pmod(first + j * stride, F.lit(TOKENS)).cast("int") for j in range(BRANCHES)]
    return F.array(*[F.xxhash64(node, c, F.get(sig, c)) for c in at])


def candidate_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of set keys that meet in some tree, and the (node, key) rows that are still large at the end."""
    roots = F.flatten(F.array(*[let(F.xxhash64(F.lit(t), F.lit(19)), lambda r: _children(r, F.col("sig"))) for t in range(TREES)]))
    frontier = nodes.select("key", F.explode(roots).alias("node"))
    pairs: DataFrame | None = None
    for level in range(1, LEVELS + 1):
        sizes = frontier.groupBy("node").agg(F.count("*").alias("size"), F.min("key").alias("pivot")).filter("size > 1")
        held = cut_lineage(frontier.join(sizes, "node"))
        together = held.filter(F.col("size") <= SMALL_NODE).groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("ks"))
        each = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, SMALL_NODE), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        large = held.filter(F.col("size") > SMALL_NODE)
        found = together.select(F.explode(each).alias("p")).select("p.a", "p.b")
        found = found.union(large.filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")))
        pairs = found if pairs is None else pairs.union(found)
        if large.isEmpty() or level == LEVELS:
            break
        frontier = large.select("node", "key").join(nodes.select("key", "sig"), "key").select("key", F.explode(_children(F.col("node"), F.col("sig"))).alias("node"))
    return pairs.distinct(), large.select("node", "key")


def thinned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that can reach the threshold, with the share of agreeing tokens as ``like``."""
    low = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / TOKENS) ** 0.5
    brief = nodes.select("key", "n", F.transform("sig", lambda x: x.bitwiseAND(127).cast("byte")).alias("s"))
    side = lambda c: brief.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e)) / TOKENS
    return met.select("a", "b", agree.alias("like")).filter(F.col("like") >= low)


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            a_keys, b_keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            good, last, left = [], None, None
            for i, (ka, kb) in enumerate(zip(a_keys, b_keys, strict=True)):
                if ka != last:
                    last, left = ka, shingle_hashes(b.column(2)[i].as_py(), k, known)
                right = shingle_hashes(b.column(3)[i].as_py(), k, known)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both * 100 >= percent * (len(left) + len(right) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good, pa.int32())), b.column(1).take(pa.array(good, pa.int32()))], names=["a", "b"])

    return run


def texts_of(keys: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, text) for the sets whose ``key`` is asked for, fetched once and written compressed."""
    asked = keys.distinct().join(nodes.select("key", F.col("first.doc_id").alias("_id"), F.col("first.print").alias("_print")), "key")
    met = docs.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_print")))
    return written(met.groupBy("key").agg(F.min("text").alias("text")))


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    at_a, at_b = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    met = pairs.join(at_b, "b").join(at_a, "a").select("a", "b", "ta", "tb")
    return met.mapInArrow(_confirm(k, percent), "a binary, b binary")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, print, n, root, least) per row of ``docs``: the component and its smallest id; no root for an empty set."""
    signed = cut_lineage(signed_sets(docs, k))
    nodes = signed.filter("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = cut_lineage(nodes)
    met, crowded = candidate_pairs(nodes)
    pairs = cut_lineage(thinned(met, nodes, percent))

    # The smallest likely partner of every set first: most groups are tied together by that alone.
    ties = pairs.filter(100 * F.col("like") >= percent).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    crowded = cut_lineage(crowded.select("key").distinct())
    texts = texts_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(crowded), nodes, docs)
    links = cut_lineage(confirmed(ties, texts, k, percent))
    roots = forest_roots(links.select(F.col("b").alias("v"), F.col("a").alias("root")))
    roots = tied(roots, cut_lineage(confirmed(apart(pairs, roots), texts, k, percent)))
    rest = cut_lineage(crossing(crowded, roots, nodes, texts, k, percent))
    if not rest.isEmpty():
        roots = tied(roots, cut_lineage(confirmed(rest, texts, k, percent)))

    named = nodes.select("key", "id").join(roots.withColumnRenamed("v", "key"), "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    named = named.join(least, "root").select(F.col("key").alias("_key"), "root", "least")
    out = signed.join(named, (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "print", "n", "root", "least")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    component = F.coalesce("least", "doc_id")
    return grouped(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def tied(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links between its components."""
    if links.isEmpty():
        return roots
    at_a, at_b = roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), roots.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    between = links.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    further = cut_lineage(connected_components(between).filter(F.col("v") != F.col("root")))  # what moves; ``roots`` has no roots as v
    return cut_lineage(moved_on(roots, further).union(further))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose sets are not in one component yet."""
    at_a, at_b = roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), roots.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    met = pairs.join(at_a, "a", "left").join(at_b, "b", "left")
    return met.filter(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))).select("a", "b")


def _cut_ids(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            ids = [np.unique((shingle_hashes(t.as_py(), k, known) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    return run


def _meet(percent: int):
    """Links between different components inside one block, as a spanning forest."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        ids, out = [np.asarray(i, np.int32) for i in block["ids"]], []
        sizes = np.array([len(i) for i in ids])
        names, root = np.unique(np.array([bytes(r).hex() for r in block["root"]]), return_inverse=True)
        joined = np.concatenate(ids)
        order = np.argsort(joined, kind="stable")
        joined, owner = joined[order], np.repeat(np.arange(len(ids)), sizes)[order]
        parent = np.arange(len(names))
        for x in np.flatnonzero(block["outside"].to_numpy(bool)):
            lo = np.searchsorted(joined, ids[x], "left")
            count = np.searchsorted(joined, ids[x], "right") - lo
            where = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            both = np.bincount(owner[where], minlength=len(ids))
            other = parent[root] != parent[root[x]]
            # Two more than counted: ids are cut to 32 bits, and the full sets decide later.
            near = np.flatnonzero(other & ((both + 2) * 100 >= percent * (sizes + sizes[x] - both - 2)))
            for y in near[np.argsort(-both[near], kind="stable")]:
                px, py = parent[root[x]], parent[root[y]]
                if px != py:
                    out.append((x, y))
                    if both[y] * 100 >= percent * (sizes[x] + sizes[y] - both[y]):
                        parent[parent == py] = px
        keys = block["key"].to_numpy()
        return pd.DataFrame([(min(keys[x], keys[y]), max(keys[x], keys[y])) for x, y in out], columns=["a", "b"])

    return run


def crossing(crowded: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Likely links that the trees left untested: between members of nodes that stayed large.

    Those sets meet on each of ``MEETINGS`` minwise tokens.  Where a meeting holds several components, the sets
    outside its largest one are compared with all members, in blocks of bounded size, on their whole sets.
    """
    held = crowded.join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    met = held.join(nodes.select("key", F.slice("sig", 1, MEETINGS).alias("s")), "key").select("key", "root", F.posexplode("s").alias("j", "token"))
    parts = met.groupBy("j", "token", "root").agg(F.count("*").alias("c"))
    main = parts.groupBy("j", "token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts"), F.max("c").alias("most"), F.sum("c").alias("all")).filter("parts > 1")
    rows = met.join(main, ["j", "token"]).withColumn("out", F.col("root") != F.col("main"))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    rows = rows.withColumns({"obs": F.ceil((F.col("all") - F.col("most")) / OUTSIDE_BLOCK).cast("int"), "mbs": blocks("all", MEMBER_BLOCK)})
    spot = F.xxhash64("key")
    each = F.explode(F.sequence(F.lit(0), F.col("obs") - 1))
    # A member goes to its own member block for every outside block; an outside set also to its outside block for every member block.
    as_member = rows.select("j", "token", "key", "root", F.lit(False).alias("outside"), each.alias("ob"), F.pmod(spot, F.col("mbs")).cast("int").alias("mb"))
    as_outside = rows.filter("out").select("j", "token", "key", "root", F.lit(True).alias("outside"), F.pmod(spot, F.col("obs")).cast("int").alias("ob"), F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"))
    placed = as_member.union(as_outside).groupBy("j", "token", "ob", "mb", "key", "root").agg(F.max("outside").alias("outside"))
    sets = cut_lineage(texts.join(crowded, "key", "left_semi").select("key", "text").mapInArrow(_cut_ids(k), "key binary, ids array<int>"))
    full = placed.join(sets, "key")
    return full.groupBy("j", "token", "ob", "mb").applyInPandas(_meet(percent), "a binary, b binary").distinct()


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; of rows that repeat an id and its text, one stays.

    A row is known by its id and the hash of its text, so unlike texts under one id, or none, are told apart.
    """
    rows_of = cut_lineage(grouped(docs).select("doc_id", "print", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("f")
    alone = rows_of.filter("root IS NULL").select("doc_id", "print").distinct()
    stay = rows_of.filter("root IS NOT NULL").groupBy("root").agg(first).select("f.doc_id", "f.print").union(alone)
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("print").alias("_p"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_print"))
    met = rows.join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_p")), "left_semi")
    one = met.groupBy("_doc", "_print").agg(F.min_by("_row", F.coalesce(F.col("_row")["text"], F.lit(""))).alias("_row"))
    return one.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
