"""Spelling variants: words one edit apart, found by search schemes over suffix ranks.

A pattern's one error lies in one of its halves, so the other half matches exactly: one scheme matches the right half
and extends to the left allowing one error, the other matches the left half and extends to the right.  Both step
through suffix-rank intervals of the delimited vocabulary (``suffixes``).  The vocabulary is dealt to buckets by what
must match exactly, up to ``DEPTH`` code points of a half, so that a word is looked up in one bucket a scheme.  A bucket
over ``BLOCK_CHARS`` is cut into blocks of words and of patterns that all meet: memory stays bounded and no pair is
lost.  A pair that both schemes find is reported by the left-extending one alone.

Defined results: NULL or empty text has no words; a NULL doc_id counts as empty in the hash; repeated rows count once
per row; very long texts and words are taken whole; ties of n go to the smaller word in code-point order; an empty table
gives an empty result.  Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import let, table
from trajlake.llm.suffixes import Suffixes
from trajlake.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT = 5, 3
DAMAGE = 97
DEPTH = 4
BLOCK_CHARS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least ``LEAST_LENGTH`` code points that occur ``LEAST_COUNT`` times."""
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    runs = runs.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    damaged = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _exact(length: Column, left: int) -> Column:
    """Code points of the half that must match: the right half, or the left half for the mirrored scheme."""
    half = F.floor(length / 2)
    return half if left else length - half


def _key(spelled: Column, exact: Column, left: int) -> Column:
    return F.concat(F.lit(f"{left}:"), F.right(spelled, F.least(exact, F.lit(DEPTH)).cast("int")))


def _bucket(key: Column, left: int, buckets: int) -> Column:
    return (F.pmod(F.xxhash64(key), F.lit(buckets)) * 2 + left).cast("long")


def _registered(words: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Vocabulary rows and pattern rows as (bucket, word, n): a word stands wherever a pattern of its length or one
    code point more or less looks, and looks in one bucket a scheme itself."""
    def places(lengths: list[int]) -> Column:
        per_side = []
        for left in (0, 1):
            spelled = F.reverse("word") if left else F.col("word")
            per_side += [_bucket(_key(spelled, _exact(F.greatest(F.length("word") + d, F.lit(LEAST_LENGTH)), left), left), left, buckets) for d in lengths]
        return F.array_distinct(F.array(*per_side))

    text = words.select(F.explode(places([-1, 0, 1])).alias("bucket"), "word", "n")
    return text, words.select(F.explode(places([0])).alias("bucket"), "word")


def _found(group: pd.DataFrame) -> pd.DataFrame:
    """One block of words (with n) met by one turn of patterns (without)."""
    left = int(group["bucket"].iloc[0]) % 2
    listed = group["n"].notna()
    words, counts, asked = group["word"][listed].tolist(), group["n"][listed].astype("int64").tolist(), group["word"][~listed].tolist()
    rows = []
    if words and asked:
        spelled = (lambda w: w[::-1]) if left else (lambda w: w)
        exact = [len(w) // 2 if left else len(w) - len(w) // 2 for w in asked]
        p, w = Suffixes([spelled(x) for x in words]).one_error([spelled(x) for x in asked], exact)
        rows = [(asked[i], words[j], counts[j]) for i, j in zip(p.tolist(), w.tolist(), strict=True)]
        if left:
            rows = [r for r in rows if not r[1].endswith(r[0][len(r[0]) // 2 :])]
    return pd.DataFrame(rows, columns=["word", "near", "near_n"])


def near_pairs(words: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, near, near_n): every ordered pair of different words of ``words`` (word, n) one edit apart, once."""
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    text, patterns = _registered(words, max(1, ceil(total / block_chars)))
    sizes = text.groupBy("bucket").agg(F.ceil(F.sum(F.length("word") + 1) / block_chars).alias("blocks"))
    asked = patterns.groupBy("bucket").agg(F.ceil(F.sum(F.length("word") + 1) / (4 * block_chars)).alias("turns"))
    sizes = sizes.join(asked, "bucket")
    deal = lambda k: F.pmod(F.xxhash64("word"), F.col(k)).alias(k[:-1])
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1)).alias(k[:-1])
    text = text.join(sizes, "bucket").select("bucket", "word", "n", deal("blocks"), every("turns"))
    patterns = patterns.join(sizes, "bucket").select("bucket", "word", F.lit(None).cast("long").alias("n"), every("blocks"), deal("turns"))
    keys, tasks = ["bucket", "block", "turn"], max(2, ceil(4 * total / block_chars))
    met = text.unionByName(patterns).repartition(tasks, *keys).groupBy(*keys)
    return met.applyInPandas(_found, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each; pointers double, so rounds grow with the logarithm of a chain."""
    reached = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        reached = cut_lineage(reached.join(onward, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")))
        if reached.filter("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def variants(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the documents."""
    words = cut_lineage(vocabulary(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_pairs(words, block_chars).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left")
    larger = -F.col("best.n") >= 2 * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(larger, F.col("best.word")).alias("form"), F.when(larger, -F.col("best.n")).alias("form_n"),
    )
    known = cut_lineage(known)
    roots = _roots(known.filter(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
