"""URL filters: listed rules first, boosted trees on lexical features for the rest.

A rule names a host and a path prefix.  It fits the host and its subdomains where the path begins with its path, and
the longest fitting rule decides.  Pages without a rule are judged by gradient-boosted trees that learn from labelled
URLs, which are the pages that a rule blocks or allows; both kinds weigh the same in total.  What only repeats a rule is
no feature: the host, whose length alone can tell listed sites apart, and the language at the start of the path.  Suffix
statistics are the blocked share, drawn towards a half, of the labelled URLs whose last path part ends alike.  A page is
blocked where the trees are sure (``BLOCK_AT``), and only if that is borne out: of the quarter of the labelled URLs that
the trees do not learn from they must be sure of at least ``LEAST_SURE``, of which at least ``TRUST`` (by weight) are
blocked ones.  So labels which lexical features do not explain, or too few labels, block nothing.  Learning takes about
``SAMPLE_ROWS`` labelled URLs, chosen by a hash.

Defined results: a NULL URL or one without :// has an empty host and path, no rule, and is judged by the trees on its
characters; very long URLs are read whole; columns besides ``page_id`` and ``url`` are dropped, so none can clash; an empty
table gives an empty result; where only one kind of label exists, every other page is allowed; repeated rows are judged
row by row.  Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import let, table
from trajlake.session import cut_lineage

# The rules of the registered query as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MOST_RULES = 1_000
SAMPLE_ROWS = 20_000
MOST_SUFFIXES = 256
DOUBT = 20.0
BLOCK_AT = 0.8
TRUST, LEAST_SURE = 0.9, 30
TREES, DEPTH, LEAF = 12, 3, 10
FEATURES = ["length", "path_length", "depth", "digit_share", "hyphens", "parameters", "entropy", "path_entropy", "secure", "suffix_share", "suffix_known"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, else NULL."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: keep them in a table and join on host suffixes")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    def summed(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        bits = F.transform(F.array_distinct(chars), lambda c: let(share(c), lambda p: -p * F.log2(p)))
        return F.coalesce(F.aggregate(bits, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), summed)


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (url, path) with the features of what follows the host that need no statistics, and ``suffix``."""
    path = F.col("path")
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*", "")
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    return pages.withColumns({
        "length": F.length(rest), "path_length": F.length(path), "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")),
        "digit_share": F.length(F.regexp_replace(rest, "[^0-9]", "")) / F.greatest(F.length(rest), F.lit(1)), "hyphens": _count(rest, "-"),
        "parameters": F.when(query == "", F.lit(0)).otherwise(F.size(F.split(query, "&"))),
        "entropy": _entropy(rest), "path_entropy": _entropy(path), "secure": F.startswith(F.coalesce("url", F.lit("")), F.lit("https:")).cast("int"),
        "suffix": F.when(F.endswith(path, F.lit("/")), F.lit("/")).otherwise(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))),
    })


def _with_suffix(pages: DataFrame, shares: dict[str, float]) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]) if shares else F.create_map().cast("map<string,double>")
    share = F.try_element_at(known, F.col("suffix"))
    return pages.withColumns({"suffix_share": F.coalesce(share, F.lit(0.5)), "suffix_known": share.isNotNull().cast("int")})


def learn(labelled: DataFrame) -> tuple[GBTClassificationModel, dict[str, float], bool] | None:
    """Trees, suffix shares and whether the held-out quarter bears the trees out, from a bounded table (url, host, path, y)."""
    # The sample is cut first, by as many tasks as the table has; only what is left is folded together.
    rows = lexical(cut_lineage(labelled).coalesce(4))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(4)) == 0)
    sizes = {r["y"]: r["count"] for r in rows.filter("not held").groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    rows = rows.withColumn("weight", F.when(F.col("y") == 1.0, F.lit(0.5 / sizes[1.0])).otherwise(F.lit(0.5 / sizes[0.0])) * sum(sizes.values()))
    shares = rows.filter("not held").groupBy("suffix").agg(F.sum("weight").alias("w"), ((F.sum(F.col("y") * F.col("weight")) + DOUBT / 2) / (F.sum("weight") + DOUBT)).alias("p"))
    known = {r["suffix"]: r["p"] for r in shares.orderBy(F.desc("w"), "suffix").limit(MOST_SUFFIXES).collect()}
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_with_suffix(rows, known)).select("features", "y", "weight", "held")
    trees = GBTClassifier(labelCol="y", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, maxBins=32, seed=5, checkpointInterval=-1)
    model = trees.fit(ready.filter("not held"))
    sure = model.setProbabilityCol("probability").transform(ready.filter("held")).filter(vector_to_array("probability")[1] >= BLOCK_AT)
    tested = sure.agg(F.count("*").alias("rows"), F.sum("weight").alias("all"), F.sum(F.col("weight") * F.col("y")).alias("right")).first()
    return model, known, tested["rows"] >= LEAST_SURE and tested["right"] >= TRUST * tested["all"]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, blocked): the trees' probability is NULL where a rule decides."""
    rules = RULES if rules is None else rules
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = parts.select("page_id", "url", "host", "path", "_rule.rule", F.col("_rule.verdict").alias("listed"))
    listed = rows.filter("listed is not null")
    share = min(1.0, bound / max(1, listed.count()))
    sample = listed.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int(share * (1 << 20)))
    labelled = sample.select("url", "host", "path", (F.col("listed") == "block").cast("double").alias("y"))
    learned = learn(labelled)
    if learned is None:
        return rows.select("page_id", "url", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("blocked"))
    model, known, trusted = learned
    keep = ["page_id", "url", "host", "path", "rule", "listed"]
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_with_suffix(lexical(rows), known)).select(*keep, "features")
    scored = model.setProbabilityCol("probability").transform(ready).withColumn("_p", vector_to_array("probability")[1])
    verdict = F.coalesce("listed", F.when(F.lit(trusted) & (F.col("_p") >= BLOCK_AT), F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(*keep[:5], verdict.alias("verdict"), F.when(F.col("listed").isNull(), F.col("_p")).alias("blocked"))


def op5(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", F.round("blocked", 6).alias("blocked"))
