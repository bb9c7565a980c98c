"""Quality rules: a decision list learned from labelled statistics, applied as ordered conditional expressions.

Statistics are column expressions over the whole text.  Sequential covering runs on a bounded sample of
labelled rows: a conjunction of thresholds is grown by information gain, pruned on rows it was not grown on,
kept while it is precise enough, and the rows it covers are taken away before the next one.

Defined results: NULL or blank text has no words and fails the base rule; very long texts are measured whole;
repeated rows are judged row by row; an empty table gives an empty result; without labels no rule is learned and
only the base rule decides.  Columns other than ``doc_id`` and ``text`` are never read, so they may have any name.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import labelled_sample, let, table, with_sample, words

WINDOW = 5
SAMPLE_ROWS = 20_000
BINS = 32
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
MIN_COVER = 5

FEATURES = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share"]


class Condition(NamedTuple):
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] > self.cut) == self.above


Rule = tuple[Condition, ...]


def _windows(w: Column) -> Column:
    """All runs of five words, as an array of structs with fields 0 to 4."""
    m = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(w, k + 1, m) for k in range(WINDOW)])


def _covered(w: Column) -> Column:
    """Words inside windows whose text occurs twice or more, counted once each."""
    keyed = F.transform(_windows(w), lambda s, i: F.struct(F.concat_ws(" ", *[s[str(k)] for k in range(WINDOW)]).alias("k"), i.alias("i")))

    def marked(s: Column) -> Column:
        twin = F.filter(s, lambda x, j: F.coalesce((j > 0) & (F.get(s, j - 1)["k"] == x["k"]), F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)))
        return let(F.sort_array(F.transform(twin, lambda x: x["i"])), total)

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(F.sort_array(keyed), marked)


def document_stats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id unless told otherwise), the base counts and the learner's features.

    Repeated windows are looked for by a 64-bit hash; only texts with equal hashes are compared window by window.
    """
    keep = ["doc_id"] if keep is None else keep
    step = docs.select(*[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    step = step.withColumn("_w", words(F.col("_text")))
    step = step.withColumn("_h", F.transform(_windows(F.col("_w")), lambda s: F.xxhash64(s)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long"),
        "_lines": lines,
        "n_repeat_words": F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(_covered(F.col("_w"))).cast("long"),
        "_upper": F.length(F.regexp_replace("_text", r"\P{Lu}+", "")),
        "_bang": F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit(""))),
        "_distinct": F.size(F.array_distinct("_w")),
    })
    step = step.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return step.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / n).alias("word_length"), (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("_upper") / chars).alias("upper_share"), (F.col("_bang") / chars).alias("bang_share"), (F.col("_distinct") / n).alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _cuts(values: list[float]) -> list[float]:
    """Midpoints between neighbouring quantiles."""
    s = sorted(values)
    at = sorted({s[min(len(s) - 1, len(s) * k // BINS)] for k in range(BINS)} | {s[-1]}) if s else []
    return [(a + b) / 2 for a, b in zip(at, at[1:], strict=False)]


def _grow(rows: list[dict], cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        bad = sum(r["bad"] for r in rows)
        good = len(rows) - bad
        if not bad or not good:
            break
        before, best, choice = math.log2(bad / len(rows)), 0.0, None
        for f, at in cuts.items():
            ordered = sorted((r[f], r["bad"]) for r in rows)
            i = low_bad = 0
            for cut in at:
                while i < len(ordered) and ordered[i][0] <= cut:
                    low_bad += ordered[i][1]
                    i += 1
                for above, p, n in ((False, low_bad, i), (True, bad - low_bad, len(ordered) - i)):
                    if p >= MIN_COVER and (gain := p * (math.log2(p / n) - before)) > best + 1e-9:
                        best, choice = gain, Condition(f, above, cut)
        if choice is None:
            break
        rule += (choice,)
        rows = [r for r in rows if choice.holds(r)]
    return rule


def _worth(rule: Rule, rows: list[dict]) -> tuple[float, int]:
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return (sum(hit) + 1) / (len(hit) + 2), sum(hit)


def learn(stats: DataFrame) -> list[Rule]:
    """Ordered rules that reject, from a bounded table of features with ``y`` (1: good, 0: bad)."""
    got = stats.select("doc_id", "y", *[F.col(f).cast("double").alias(f) for f in FEATURES]).orderBy("doc_id").collect()
    rows = [r.asDict() | {"bad": int(r["y"] == 0)} for r in got]
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    cuts = {f: _cuts([r[f] for r in rows]) for f in FEATURES}
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _grow(grow, cuts)
        if not rule:
            break
        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (_worth(r, prune)[0], len(r)))
        share, found = _worth(rule, prune)
        if share < MIN_PRECISION or found < MIN_COVER:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grow, prune))
    return rules


def rejected_by(rules: list[Rule]) -> Column:
    """Number of the first rule that fires, counted from 1, or NULL."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(i)).otherwise(out)
    return out


def learned_rules(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> list[Rule]:
    sample = labelled_sample(labels, "quality", bound)
    return learn(document_stats(with_sample(docs.select("doc_id", "text"), sample), ["doc_id", "y"]))


def judge(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """Statistics with ``base_failed``, ``rule`` (the first learned rule that rejects) and ``kept``."""
    out = document_stats(docs, keep).withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    out = judge(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, with their columns."""
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    # A filter would be pushed below the statistics and repeat them for each condition that names them.
    kept = judge(rows, rules, ["_row"]).select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
