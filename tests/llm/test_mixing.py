import random

import pytest
from pyspark.sql import functions as F

from trajlake.llm import mixing


def fill(total, children):
    """{child: (weight, capacity)} by rounds: what a full child cannot take goes to its siblings."""
    given, open_ = dict.fromkeys(children, 0.0), {c for c, (w, cap) in children.items() if w > 0 and cap > 0}
    left = total
    while open_ and left > 1e-9:
        weights = sum(children[c][0] for c in open_)
        share = {c: left * children[c][0] / weights for c in open_}
        full = {c for c in open_ if given[c] + share[c] >= children[c][1] - 1e-9}
        if not full:
            for c in open_:
                given[c] += share[c]
            break
        for c in full:
            left -= children[c][1] - given[c]
            given[c] = children[c][1]
        open_ -= full
    return given


@pytest.mark.parametrize("total", [0, 500, 5_000, 40_000, None])
def test_budgets_equal_round_by_round_filling(spark, total):
    rnd = random.Random(8)
    leaves = [(d, x, s, rnd.randrange(1, 3000), 1) for d in ("web", "books", "code") for x in ("en", "de", None) for s in ("a", "b", "c") if rnd.random() < 0.8]
    supply = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint, docs bigint")
    weights = {"domain": {"web": 3.0, "books": 2.0, "code": 0.0}, "lang": {"en": 5.0}, "source": {"a": 2.0}}
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(supply, weights, total, 2).collect()}
    wd, wl, ws = ({"web": 3.0, "books": 2.0, "code": 0.0}.get, lambda x: 5.0 if x == "en" else 1.0, lambda x: 2.0 if x == "a" else 1.0)
    cap = {r[:3]: 2.0 * r[3] * (r[0] != "code") for r in leaves}
    whole = sum(r[3] for r in leaves) if total is None else total
    tops = fill(whole, {d: (wd(d), sum(c for k, c in cap.items() if k[0] == d)) for d in {k[0] for k in cap}})
    for d, b in tops.items():
        langs = fill(b, {x: (wl(x), sum(c for k, c in cap.items() if k[:2] == (d, x))) for x in {k[1] for k in cap if k[0] == d}})
        for x, bl in langs.items():
            for s, v in fill(bl, {k[2]: (ws(k[2]), c) for k, c in cap.items() if k[:2] == (d, x)}).items():
                assert got[(d, x, s)] == pytest.approx(v, abs=1e-6), (d, x, s)


def test_prefixes_reach_budgets_whatever_the_ranges(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    take = lambda: sorted((r["_row"]["doc_id"], r["_copies"]) for r in mixing.mix(docs, mixing.WEIGHTS, total=20_000).collect())
    one = take()
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert take() == one
    taken = mixing.mix(docs, mixing.WEIGHTS, total=20_000)
    used = taken.agg(F.sum(F.col("_tokens") * F.col("_copies"))).first()[0]
    longest = taken.agg(F.max("_tokens")).first()[0]
    leaves = docs.select("lang", "source").distinct().count()
    assert 20_000 <= used <= 20_000 + leaves * longest


def test_odd_rows(spark, odd_docs, sf):
    out = mixing.stage(spark, odd_docs, sf)
    assert out.columns == [*odd_docs.columns, "mix_copies"]
    ids = [r["doc_id"] for r in out.collect()]
    assert set(ids) <= {4, 5, 6, 7, None, 9} and ids.count(7) in (0, 2)
    assert mixing.mix(odd_docs.limit(0), mixing.WEIGHTS).count() == 0
    assert mixing.mix(odd_docs, mixing.WEIGHTS, total=0).count() == 0
    everything = mixing.mix(odd_docs, {"domain": {}, "lang": {}, "source": {}}, total=10**9, epochs=1)
    assert everything.count() == 7 and everything.filter("_copies <> 1").isEmpty()


def test_a_clashing_column_gives_way(spark, odd_docs, sf):
    docs = odd_docs.withColumn("mix_copies", F.lit("mine"))
    out = mixing.stage(spark, docs, sf)
    assert out.columns.count("mix_copies") == 1 and dict(out.dtypes)["mix_copies"] == "int" and "spans" in out.columns
    assert out.count() <= docs.count() and mixing.stage(spark, docs.limit(0), sf).count() == 0
