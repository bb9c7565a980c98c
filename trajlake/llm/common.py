"""What several text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.session import written  # noqa: F401

WORD_BREAKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once per row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; NULL text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_BREAKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that no learner sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, bound: int, learnable_only: bool = False) -> DataFrame:
    """About ``bound`` labelled ids at most, chosen by a hash of the id; one row (doc_id, y) per id.

    Rows without id or label are left out; an id with both labels takes the larger one.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if learnable_only:
        known = known.filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, bound / max(1, known.count()))
    return known if share == 1.0 else known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def with_sample(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Sampled documents with their label as ``y``; the sample is bounded by its parameter, so it is broadcast."""
    return docs.join(F.broadcast(sample), "doc_id")


def spans_digest(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the (listed) spans in their order, comma-joined."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
