import re

import pyarrow.dataset as ds

from trajlake.llm import quality
from trajlake.llm.queries import QUERIES


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, sf):
    texts = ds.dataset(f"{sf}/documents.parquet").to_table().to_pydict()
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_rules"](spark, sf).collect()}
    for i, t in zip(texts["doc_id"], texts["text"], strict=True):
        r, want = got[i], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_repeats_overlap_and_ties(spark):
    texts = ["a a a a a a a", "a b c d e f a b c d e", "a b c d e x a b c d e b c d e f", "1 2 3 4", "x\n x\nx\n\n \n", " \x0b\x0cw\r\n", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality.document_stats(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])


def test_rules_are_learned_and_precise(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for i in range(1500):
        word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9)))
        bad = i % 5 == 0
        rows.append((i, " ".join(word().upper() + "!!" if bad else word() for _ in range(40)), int(not bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, q int").drop("q"), spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id bigint, quality int, toxic int")
    rules = quality.learned_rules(docs, labels)
    assert rules and all(len(r) <= quality.MAX_CONDITIONS for r in rules)
    kept = {r["doc_id"] for r in quality.judge(docs, rules).filter("kept").collect()}
    assert kept == {r[0] for r in rows if r[2]}


def test_without_labels_only_the_base_rule_decides(spark, odd_docs, sf):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.learned_rules(odd_docs, none) == []
    out = quality.judge(odd_docs, []).collect()
    assert len(out) == odd_docs.count() and all(r["kept"] == (not r["base_failed"]) for r in out)
    assert quality.judge(odd_docs.limit(0), []).count() == 0
    staged = quality.stage(spark, odd_docs, sf)
    assert staged.columns == odd_docs.columns and {r["doc_id"] for r in staged.collect()} <= {7, None}
