import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.dataset as ds

from trajlake.llm import spelling
from trajlake.llm.queries import QUERIES
from trajlake.llm.suffixes import Suffixes, suffix_order

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    gaps = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i] + "\0" + w[i + 1 :]].add(w)
            gaps[w[:i] + w[i + 1 :]].add(w)
        gaps[w].add(w)
    near = {w: set() for w in words}
    for group in gaps.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def collected(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark, sf):
    t = ds.dataset(f"{sf}/documents.parquet").to_table(["doc_id", "text"]).to_pydict()
    assert collected(QUERIES["op11_spelling_variants"](spark, sf)) == brute(brute_words(zip(t["doc_id"], t["text"], strict=True)))


def test_suffixes_are_sorted():
    rnd = random.Random(1)
    for text in ("aaaaaaa", "banana", "".join(rnd.choice("ab") for _ in range(200))):
        import numpy as np

        assert suffix_order(np.array([ord(c) for c in text])).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_both_schemes_find_every_edit_at_every_place():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randrange(5, 9))) for _ in range(900)} | {"aaaaa", "aaaaaa", "abababab", "bababab"})
    asked = words + ["aaaa", "zzzzz", "abcab"]
    right, _ = [], None
    for left in (0, 1):
        spell = (lambda w: w[::-1]) if left else (lambda w: w)
        exact = [len(w) // 2 if left else len(w) - len(w) // 2 for w in asked]
        p, w = Suffixes([spell(x) for x in words]).one_error([spell(x) for x in asked], exact)
        assert len(set(zip(p.tolist(), w.tolist(), strict=True))) == len(p)
        right += list(zip(p.tolist(), w.tolist(), strict=True))
    assert {(asked[i], words[j]) for i, j in right} == {(a, b) for a in asked for b in words if one_edit(a, b)}


def test_hot_bucket_is_cut_into_blocks_without_loss(spark):
    # All words share a long beginning and end, so one bucket a scheme holds them all.
    rnd = random.Random(3)
    words = sorted({"prefix" + "".join(rnd.choice("abc") for _ in range(4)) + "suffix" for _ in range(60)} | {"prefixabcsuffix", "prefixaabbasuffix"})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    for block in (100, 100_000):
        got = [(r["word"], r["near"]) for r in spelling.near_pairs(table, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert collected(spelling.variants(odd_docs)) == brute(brute_words(rows))
    assert spelling.variants(odd_docs.limit(0)).count() == 0


def test_chain_ties_and_case(spark):
    text = "GARTEN garten " * 20 + "gartan " * 9 + "gartann " * 4 + "house hause " * 5 + "hausa " * 3 + "ÄPFEL äpfel " * 4 + "×÷abcde " * 3
    docs = spark.createDataFrame([(10, text)], "doc_id bigint, text string")
    got = collected(spelling.variants(docs))
    assert got == brute(brute_words([(10, text)]))
    assert got["gartann"][1] == "garten" and got["Äpfel"[0] + "pfel"] and got["hausa"][0] is None
