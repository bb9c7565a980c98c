"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source).  A token budget goes down the tree: a node shares its budget among its children by
their weights, no child gets more than its subtree can give (its tokens times the epochs allowed), and what a child
cannot take goes to its siblings before anything is given back to the level above.  A leaf then takes whole seeded
epochs of its documents and of the last epoch the prefix whose tokens reach the rest of its budget.

The order of an epoch is a digest of (seed, epoch, id).  The prefix is found without gathering a leaf: token
sums by hash range tell in which range the budget ends, and only that range's rows are ordered.

Defined results: NULL domain, language or source is a leaf value of its own; NULL or blank text has no tokens and is
never taken; a document longer than what is left ends the prefix and is taken; rows that repeat an id are separate
documents that are ordered and taken together; a weight of zero or less takes
nothing; unlisted values weigh one; an empty table gives an empty result.  Added columns start with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import table, words
from trajlake.session import cut_lineage

LEVELS = ["domain", "lang", "source"]
SEED = 17
EPOCHS = 2
ROWS_PER_RANGE = 20_000
MOST_RANGES = 1 << 16
BROADCAST_LEAVES = 50_000

# The target weights of the registered query and the pipeline.
WEIGHTS = {
    "domain": {"web": 3.0, "books": 2.0, "code": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {},
}


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo three names one of web, books and code."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1)
    return F.get(F.array(F.lit("web"), F.lit("books"), F.lit("code")), F.coalesce(F.when(number != "", number.cast("int")), F.lit(0)) % 3)


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    listed = weights.get(level) or {}
    if not listed:
        return F.lit(1.0)
    pairs = F.create_map(*[F.lit(x) for kv in listed.items() for x in kv])
    return F.greatest(F.coalesce(F.try_element_at(pairs, F.col(level)), F.lit(1.0)), F.lit(0.0))


def share_out(children: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """``budget`` of each child from its parent's ``_total``, its ``_weight`` and its capacity ``_cap``.

    Children are filled in the order of capacity by weight: while the level that spends the rest evenly lies above a
    child's capacity, it is full; all others stop at that level.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    open_ = F.col("_weight") > 0
    ratio = F.when(open_, F.col("_cap") / F.col("_weight"))
    by = w.orderBy(F.col("_ratio").asc_nulls_last(), *order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    out = children.withColumn("_ratio", ratio)
    out = out.withColumn("_spent", F.coalesce(F.sum(F.when(open_, F.col("_cap"))).over(before), F.lit(0.0)))
    out = out.withColumn("_left", F.sum(F.when(open_, F.col("_weight"))).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    out = out.withColumn("_level", (F.col("_total") - F.col("_spent")) / F.col("_left"))
    # The first child that is not filled sets the level for itself and all after it.
    out = out.withColumn("_stop", F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", "_level"))).over(w)["_level"])
    full = F.col("_stop").isNull() | (F.col("_ratio") <= F.col("_stop"))
    budget = F.when(~open_, F.lit(0.0)).when(full, F.col("_cap")).otherwise(F.col("_stop") * F.col("_weight"))
    return out.withColumn("budget", F.greatest(budget, F.lit(0.0))).drop("_ratio", "_spent", "_left", "_level", "_stop")


def leaf_budgets(supply: DataFrame, weights: dict[str, dict[str, float]], total: float | None, epochs: int, levels: list[str] | None = None) -> DataFrame:
    """(levels, tokens, docs, budget) from a table of leaf ``tokens`` and ``docs``; NULL total: all tokens there are."""
    levels = LEVELS if levels is None else levels
    leaves = supply.withColumn("_cap", (F.col("tokens") * epochs).cast("double"))
    for level in levels:
        leaves = leaves.withColumn(f"_w_{level}", _weight(level, weights))
        leaves = leaves.withColumn("_cap", F.when(F.col(f"_w_{level}") > 0, F.col("_cap")).otherwise(F.lit(0.0)))
    everything = Window.partitionBy(F.lit(0))
    whole = F.lit(float(total)) if total is not None else F.sum("tokens").over(everything).cast("double")
    leaves = leaves.withColumn("_total", whole)
    # Each pass works on one row per node of a level, though kept on the leaves: the first leaf of a node speaks for it.
    for depth, level in enumerate(levels):
        parent, node = levels[:depth], levels[: depth + 1]
        held = leaves.groupBy(*node).agg(F.sum("_cap").alias("_cap"), F.first(f"_w_{level}").alias("_weight"), F.first("_total").alias("_total"))
        given = share_out(held, parent, node).select(*[F.col(c).alias(f"_n_{c}") for c in node], F.col("budget").alias("_given"))
        same = F.lit(True)
        for c in node:
            same = same & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
        leaves = leaves.join(given, same).drop(*[f"_n_{c}" for c in node]).withColumn("_total", F.col("_given")).drop("_given")
    return leaves.select(*levels, "tokens", "docs", F.col("_total").alias("budget"))


def _place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: 60 bits of a digest that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], total: float | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` that are taken, with ``_domain``, ``_tokens``, ``_copies`` (epochs that took the row)."""
    place_of = lambda full: _place(seed, full, F.col("_doc"))
    leaf = [F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"),
        F.size(words(F.col("text"))).cast("long").alias("_tokens"),
        domain_of(F.col("source")).alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"),
    ).filter("_tokens > 0")
    narrow = cut_lineage(rows.select(*leaf, "_doc", "_tokens"))
    supply = cut_lineage(narrow.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs")))
    plan = cut_lineage(leaf_budgets(supply, weights, total, epochs).withColumn("_full", F.floor(F.col("budget") / F.col("tokens")).cast("int")))
    rest = F.col("budget") - F.col("_full") * F.col("tokens")
    ranges = F.least(F.lit(MOST_RANGES), F.greatest(F.lit(1), F.ceil(F.col("docs") / ROWS_PER_RANGE))).cast("int")
    plan = plan.select(*[F.col(c).alias(f"_p_{c}") for c in LEVELS], "_full", rest.alias("_rest"), ranges.alias("_ranges"))
    few = supply.count() <= BROADCAST_LEAVES  # the number of leaves, not of documents; beyond it a plain join
    sized = lambda t: F.broadcast(t) if few else t
    at_leaf = (F.col("domain").eqNullSafe(F.col("_p_domain"))) & (F.col("lang").eqNullSafe(F.col("_p_lang"))) & (F.col("source").eqNullSafe(F.col("_p_source")))
    range_of = F.floor(F.col("_place") / F.lit(float(1 << 60)) * F.col("_ranges")).cast("int")

    placed = narrow.join(sized(plan), at_leaf).withColumn("_place", place_of(F.col("_full"))).withColumn("_range", range_of)
    sums = placed.groupBy(*LEVELS, "_range", "_rest").agg(F.sum("_tokens").alias("t"))
    upto = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The range in which the budget ends: all before it are taken, all after it are not.
    ends = sums.withColumn("_upto", F.sum("t").over(upto)).filter("_upto >= _rest").groupBy(*LEVELS).agg(F.min(F.struct("_range", (F.col("_upto") - F.col("t")).alias("_before"))).alias("e"))
    ends = cut_lineage(ends.select(*[F.col(c).alias(f"_e_{c}") for c in LEVELS], F.col("e._range").alias("_end"), F.col("e._before").alias("_before")))
    at_end = (F.col("domain").eqNullSafe(F.col("_e_domain"))) & (F.col("lang").eqNullSafe(F.col("_e_lang"))) & (F.col("source").eqNullSafe(F.col("_e_source"))) & (F.col("_range") == F.col("_end"))
    last = placed.join(sized(ends), at_end)
    # Equal places (rows that repeat an id) share one running sum.
    running = Window.partitionBy(*LEVELS).orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    together = last.withColumn("_run", F.col("_before") + F.sum("_tokens").over(running))
    at = together.withColumn("_self", F.sum("_tokens").over(Window.partitionBy(*LEVELS, "_place")))
    cut = at.filter(F.col("_run") - F.col("_self") < F.col("_rest")).groupBy(*LEVELS).agg(F.max("_place").alias("_cut"))
    limits = cut_lineage(cut.select(*[F.col(c).alias(f"_c_{c}") for c in LEVELS], "_cut"))

    same = F.lit(True)
    for c in LEVELS:
        same = same & F.col(f"_p_{c}").eqNullSafe(F.col(f"_c_{c}"))
    final = cut_lineage(plan.join(limits, same, "left").select(*[f"_p_{c}" for c in LEVELS], "_full", F.coalesce("_cut", F.lit(-1)).alias("_cut")))
    here = (F.col("_domain").eqNullSafe(F.col("_p_domain"))) & (F.col("_lang").eqNullSafe(F.col("_p_lang"))) & (F.col("_source").eqNullSafe(F.col("_p_source")))
    taken = rows.join(sized(final), here).withColumn("_copies", F.col("_full") + (place_of(F.col("_full")) <= F.col("_cut")).cast("int"))
    return taken.filter("_copies > 0").select("_row", "_domain", "_tokens", "_copies")


def op7(spark, sf_dir: str) -> DataFrame:
    taken = mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return taken.select(F.col("_row.doc_id").alias("doc_id"), F.col("_domain").alias("domain"), F.col("_row.lang").alias("lang"), F.col("_row.source").alias("source"), F.col("_tokens").alias("tokens"), F.col("_copies").alias("copies"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with their columns and the number of epochs that take them, ``mix_copies``.

    An input column of that name, in whatever case, gives way to the stage's own.
    """
    taken = mix(docs, WEIGHTS)
    kept = [c for c in docs.columns if c.lower() != "mix_copies"]
    return taken.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("_copies").alias("mix_copies"))
