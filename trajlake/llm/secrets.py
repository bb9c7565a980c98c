"""Secret scans over a trigram inverted index.

Each rule's pattern gives a Boolean trigram query.  The index holds one posting per (trigram, document) for the
trigrams that any query names, over all documents.  Intersecting the postings of a clause gives its candidates;
only they are verified with the pattern.  Rules without a mandatory trigram scan every text.

Defined results: NULL or empty text has no spans; positions are code points with an exclusive end; a match is
leftmost and does not overlap another of its kind; texts are scanned whole; repeated rows and rows that share
a ``doc_id`` are scanned row by row; a NULL ``doc_id`` is a key like any other; an empty table gives an empty
result.  Only ``doc_id`` and ``text`` are read by the scan; ``redact`` returns every column of its input.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import count_kind, let, spans_digest, table
from trajlake.llm.trigrams import query_of


class Rule(NamedTuple):
    """A kind of secret; ``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed values.  Minimal lengths stand inside a pattern where they cannot change which match is leftmost: a run of
# one character class fails as a whole or not at all.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}"),
]
MORE = [
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{30,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]
RULES = [*BASE, *MORE]
CHUNK = 128
MASK = "[REDACTED]"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): the inverted index of the listed trigrams over every text."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, kinds): documents that hold all trigrams of some clause of a rule."""
    spark = index.sparkSession
    asked = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(query_of(r.pattern) or []) for t in sorted(c)]
    clauses = spark.createDataFrame(asked, "kind string, clause int, trigram string, need int")
    met = index.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "kind", "clause", "need")
    full = met.agg(F.size(F.collect_set("trigram")).alias("have")).filter(F.col("have") == F.col("need"))
    return full.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _sums_before(lengths: Column) -> Column:
    """For each position the sum of what precedes it, by chunks, so that long lists stay cheap."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / CHUNK).cast("int") - 1, F.lit(0)))
    whole = F.transform(chunks, lambda c: add(F.slice(lengths, c * CHUNK + 1, CHUNK)))
    return let(whole, lambda s: F.transform(lengths, lambda _, i: add(F.slice(s, 1, F.floor(i / CHUNK).cast("int"))) + add(F.slice(lengths, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK))))


def matches(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches: the lengths of the pieces between them give their places."""
    pattern = F.lit(rule.pattern)
    found, measured = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def placed(parts: Column) -> Column:
        gaps, lengths = parts["gaps"], parts["lengths"]
        steps = F.transform(lengths, lambda n, i: F.get(gaps, i) + n)
        spans = let(_sums_before(steps), lambda before: F.transform(lengths, lambda n, i: F.struct(
            F.lit(rule.kind).alias("kind"),
            (F.get(before, i) + F.get(gaps, i)).cast("long").alias("start"),
            (F.get(before, i) + F.get(gaps, i) + n).cast("long").alias("end"),
            F.get(parts["sizes"], i).alias("size"),
        )))
        good = F.filter(spans, lambda s: s["size"] >= rule.least)
        return F.transform(good, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    parts = F.struct(
        F.transform(F.split(text, rule.pattern), lambda p: F.length(p)).alias("gaps"),
        F.transform(found, lambda m: F.length(m)).alias("lengths"),
        F.transform(measured, lambda m: F.length(m)).alias("sizes"),
    )
    return F.when(text.rlike(rule.pattern), let(parts, placed)).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, spans) for each row of ``docs``, spans by start, then by the order of the rules."""
    return _scanned(docs, RULES if rules is None else rules).select(F.col("_row.doc_id").alias("doc_id"), F.col("_spans").alias("spans"))


def _scanned(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(_row, _text, _spans): the whole row as a struct, so that its names meet no others."""
    indexed = [r for r in rules if query_of(r.pattern) is not None]
    wanted = sorted({t for r in indexed for c in query_of(r.pattern) for t in c})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    if indexed:
        found = candidates(postings(docs, wanted), indexed).select(F.col("doc_id").alias("_found"), "kinds")
        rows = rows.join(found, F.col("_id").eqNullSafe(F.col("_found")), "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    rows = rows.withColumn("_text", F.coalesce(F.col("_row")["text"], F.lit("")))  # after the join, which moves the text once
    text = F.col("_text")
    each = [F.when(F.array_contains("kinds", r.kind), matches(text, r)).otherwise(_none()) if r in indexed else matches(text, r) for r in rules]
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    keyed = F.transform(F.concat(*each), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("_row", "_text", spans.alias("_spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each stretch covered by spans replaced by one mask."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MASK)))
        more = F.when(s["start"] > acc["at"], gap).when((s["start"] == 0) & (acc["at"] == 0), F.lit(MASK)).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], more).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def op1(spark, sf_dir: str) -> DataFrame:
    base, spans = [r.kind for r in BASE], F.col("spans")
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[count_kind(spans, k).alias(f"n_{k}") for k in base],
        F.sha2(spans_digest(spans, base), 256).alias("base_sha256"), spans_digest(spans).alias("spans"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked and ``n_chars`` follows the new text."""
    hit = F.size("_spans") > 0
    out = _scanned(docs, RULES).withColumn("_new", F.when(hit, redacted(F.col("_text"), F.col("_spans"))).otherwise(F.col("_row")["text"]))
    changed = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        count = F.length("_new").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(hit, count).otherwise(F.col("_row")["n_chars"])
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
