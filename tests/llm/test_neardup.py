import random

import pyarrow.dataset as ds
import pytest

from trajlake.llm import neardup
from trajlake.llm.components import connected_components, forest_roots


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + min(k, len(w))]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(rows, k, percent):
    sets, root = sets_of(rows, k), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                m = len(sets[a] & sets[b])
                if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def found(df):
    rows = df.collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force_on_the_given_documents(spark, sf, k):
    t = ds.dataset(f"{sf}/documents.parquet").to_table().to_pydict()
    assert found(neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), k)) == brute(list(zip(t["doc_id"], t["text"], strict=True)), k, 80)


def test_large_groups_of_copies_lose_no_link(spark, monkeypatch):
    """Groups far larger than a small node, with many pairs near the threshold, so the crowded path decides."""
    monkeypatch.setattr(neardup, "OUTSIDE_BLOCK", 20)
    monkeypatch.setattr(neardup, "MEMBER_BLOCK", 50)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, n = [], 0
    for size, edits in ((150, 7), (120, 4), (60, 0), (40, 12)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                w[rnd.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, " ".join(word() for _ in range(30))) for i in range(30)]
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2)) == brute(rows, 2, 80)


def test_threshold_is_exact(spark):
    a = " ".join(f"w{i}" for i in range(46))  # 45 pairs
    rows = [(1, a), (2, " ".join(f"w{i}" for i in range(41)) + " x y z u v"), (3, " ".join(f"w{i}" for i in range(42)) + " x y z"), (4, a.upper()), (5, "one"), (6, "ONE"), (7, "one two"), (8, None), (9, "")]
    got = found(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2))
    assert got == brute(rows, 2, 80) and got[6][1] == 5 and got[8] == (0, 8, True)


def test_odd_rows(spark, odd_docs, sf):
    rows = neardup.near_duplicates(odd_docs, 2).collect()
    assert len(rows) == odd_docs.count()
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] == 7] == [(7, True)] * 2
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert neardup.near_duplicates(odd_docs.limit(0)).count() == 0
    out = neardup.stage(spark, odd_docs, sf)
    assert out.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, None, 9]))


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(80)]
    got = {r["v"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert set(got) == set(near)
    for v, others in near.items():
        assert all(got[v] == got[o] for o in others)
    assert len(set(got.values())) == len({min(_reach(v, near)) for v in near})
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 30)], "v bigint, root bigint")
    assert {r["root"] for r in forest_roots(chain).collect()} == {0}


def _reach(v, near):
    seen, todo = {v}, [v]
    while todo:
        for o in near[todo.pop()]:
            if o not in seen:
                seen.add(o)
                todo.append(o)
    return seen


def test_a_null_id_inside_a_group_does_not_break_it(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (6, text), (None, text), (9, text + " more"), (None, "no other like it")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["n_shingles"] > 3) == [("5", 59, 5, True), ("6", 59, 5, False), ("9", 60, 5, False), ("None", 59, 5, False)]
    assert [(r["component_id"], r["kept"]) for r in got if r["n_shingles"] == 3] == [(None, True)]


def test_crowded_nodes_lose_no_more_pairs_than_the_trees():
    assert 0.2**neardup.MEETINGS < 1e-6 and neardup.MEETINGS <= neardup.TOKENS
