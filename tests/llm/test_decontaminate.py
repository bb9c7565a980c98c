import random

import numpy as np
import pyarrow.dataset as ds

from trajlake.llm import decontaminate as dc
from trajlake.llm.queries import QUERIES


def plain(t):
    return "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in t)


def test_every_verbatim_item_is_found_and_nothing_else(spark, sf):
    docs, bench = (ds.dataset(f"{sf}/{t}.parquet").to_table().to_pydict() for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontamination"](spark, sf).collect()}
    want = {(i, j) for i, t in zip(docs["doc_id"], docs["text"], strict=True) for j, b in zip(bench["item_id"], bench["text"], strict=True) if plain(b) in plain(t or "")}
    assert want and want <= got
    windows = {b: dc.Index([(0, b)]).windows for b in bench["text"]}
    by_item = dict(zip(bench["item_id"], bench["text"], strict=True))
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    for i, j in got - want:  # whatever else is found holds a window of the item within the edit budget
        assert any(edit_distance_in("".join(map(chr, w)), plain(texts[i])) <= dc.edits_allowed(len(w)) for _, _, w in windows[by_item[j]])


def edit_distance_in(pattern, text):
    """Least edit distance of the pattern to any stretch of the text."""
    a = np.array([ord(c) for c in text])
    row = np.zeros(len(a) + 1, int)
    for i, p in enumerate(pattern, 1):
        new = np.minimum(row[:-1] + (a != ord(p)), row[1:] + 1)
        full = np.concatenate(([i], new))
        steps = np.arange(len(full))
        row = np.minimum.accumulate(full - steps) + steps
    return int(row.min())


def test_edited_passages_within_the_budget_are_found():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(15, 60)))) for i in range(40)]
    index = dc.Index(items)
    for item, text in items:
        for share in (0.0, 0.02, 0.04):
            s = list(text)
            for _ in range(int(share * len(s))):
                p, o = rnd.randrange(len(s)), rnd.random()
                if o < 0.4:
                    s[p] = "#"
                elif o < 0.7:
                    s.insert(p, "#")
                else:
                    del s[p]
            before = " ".join(word() for _ in range(rnd.randrange(40)))
            assert any(r[0] == item for r in dc.regions(index, f"{before} {''.join(s).upper()} {word()} {word()}")), (item, share)
        assert dc.regions(index, " ".join(word() for _ in range(200))) == []


def test_positions_and_very_long_texts():
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew potions"
    index = dc.Index([(7, item)])
    far = "é " * (dc.PIECE // 2 - 20)
    (r,) = dc.regions(index, far + item.upper() + " end")
    assert r == (7, len(far), len(far) + len(item), 1, 0)
    assert dc.regions(index, None) == dc.regions(index, "") == dc.regions(dc.Index([]), item) == []
    assert dc.regions(dc.Index([(1, "too short")]), "too short") == []


def test_blocks_and_odd_rows(spark, odd_docs, sf, monkeypatch):
    bench = spark.createDataFrame([(1, None), (2, "short"), (3, "password = 'abcdefghijkl0123' word password = 'abcdefghijkl0123'"), (4, "same words here and there again and more of them")], "item_id bigint, text string")
    whole = sorted(map(tuple, dc.find_passages(odd_docs, bench).select("doc_id", "item_id").distinct().collect()))
    assert whole == [(5, 3), (7, 4)]
    monkeypatch.setattr(dc, "INDEX_CHARS", 10)
    assert sorted(map(tuple, dc.find_passages(odd_docs, bench).select("doc_id", "item_id").distinct().collect())) == whole
    assert dc.find_passages(odd_docs, bench.limit(0)).count() == 0 and dc.find_passages(odd_docs.limit(0), bench).count() == 0
    out = dc.stage(spark, odd_docs, sf)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()


def test_short_excerpts_at_every_offset(sf):
    bench = ds.dataset(f"{sf}/benchmark.parquet").to_table().to_pydict()["text"]
    index, size = dc.Index(list(enumerate(bench))), dc.SHORT + dc.SHORT_STRIDE - 1
    for i, b in enumerate(bench[:8]):
        for at in range(len(b) - size + 1):
            assert i in {r[0] for r in dc.regions(index, f"qq xx {b[at : at + size]} zz yy")}, (i, at)


def test_a_dropped_added_or_changed_word_hides_no_item():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 13)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((11, 12, 14, 16, 20, 26, 32, 40))]
    index = dc.Index(items)
    for i, text in items:
        w = text.split(" ")
        for j in range(len(w)):
            for new in ([], [w[j], "zebrafishes"], ["qqqqqqqqqqq"]):
                assert i in {r[0] for r in dc.regions(index, "x y " + " ".join(w[:j] + new + w[j + 1 :]) + " z v")}, (i, j, new)


def test_short_items_are_found():
    items = [(1, "name all of them"), (2, "what is the capital of peru"), (3, " " * 20)]
    index = dc.Index(items)
    assert [r[0] for r in dc.regions(index, "he said: name all of them, then" + " " * 30)] == [1]
    assert [r[0] for r in dc.regions(index, "so what is the capitol of peru, please")] == [2]
    assert dc.regions(index, "so what is the capital of chad, please") == []


def test_the_driver_holds_one_block_of_the_benchmark(spark, monkeypatch):
    # blocks are made while the items are read, not kept until all are there.
    monkeypatch.setattr(dc, "INDEX_CHARS", 100)
    items = spark.createDataFrame([(i, f"item {i:03d} " + "words " * 5) for i in range(9)], "item_id long, text string")
    blocks = dc.item_blocks(items)
    first = next(blocks)
    assert [i for i, _ in first] == [0, 1] and not isinstance(blocks, list)
    assert [i for b in [first, *blocks] for i, _ in b] == list(range(9))
    assert list(dc.item_blocks(items.limit(0))) == [[]]
