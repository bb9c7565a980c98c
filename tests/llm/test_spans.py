"""Secret scans and personal data against a plain reading of their definitions."""

import hashlib
import random
import re

import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trajlake.llm import pii, secrets
from trajlake.llm.queries import QUERIES
from trajlake.llm.trigrams import query_of

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_base(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_registered_queries_equal_brute_force(spark, sf):
    texts = ds.dataset(f"{sf}/documents.parquet").to_table().to_pydict()
    for name, base in (("op1_secret_scan", secret_base), ("op8_pii", pii_base)):
        got = {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}
        assert len(got) == len(texts["doc_id"])
        for i, t in zip(texts["doc_id"], texts["text"], strict=True):
            want = base(t or "")
            assert got[i]["base_sha256"] == sha(want), (name, i)
            for k in {"op1_secret_scan": ("assign", "access", "hex"), "op8_pii": pii.BASE}[name]:
                assert got[i][f"n_{k}"] == sum(s[0] == k for s in want)


PARTS = st.lists(st.sampled_from(["a@b.c", "@", ".", "1", "255", "300", "+1 (23) 456-789", "4111 1111 1111 1111", "-", " ", "x_", "%", "é", "🙂", "a", "4111111111111111"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_pii_scan_equals_patterns(parts):
    text = "".join(parts)
    got = [(s["kind"], s["start"], s["end"]) for s in pii.scored(text) if s["kind"] in pii.BASE]
    assert got == pii_base(text)


def test_pii_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    found = lambda t: [s["kind"] for s in pii.scored(t)]
    assert found("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert found("nr 123-45-6789") == [] and found("SSN 123-45-6789") == ["ssn"]
    assert pii.scored("call +1 234 567 8901")[0]["score"] > pii.scored("+1 234 567 8901")[0]["score"]
    assert pii.scored(None) == [] and pii.scored("a" * 200_000) == [] and pii.scored("1" * 200_000) == []


def test_secrets_equal_brute_force_on_planted_texts(spark):
    texts = [
        "token=secret:abcdefghijklmnopq", "PASSWORD : \"abcdefghijkl\"", "api_key='short'", "apikey=ABCDEFGHIJKLMNOP.q", "🙂 AKIAABCDEFGHIJKLMN 🙂 0123456789abcdef0",
        "passwd==" + "a" * 30, "AKIAshort AKIAABCDEFGHIJKLM", "ghp_" + "a" * 36, "xoxb-1234567890ab", "token=abcdefghijkl token=abcdefghijkl", "deadbeef" * 400 + " é " + "tOkEn: 'deadbeefdeadbeef'",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in secrets.scan(docs).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert [s for s in got if s[0] in ("assign", "access", "hex")] == secret_base(texts[r["doc_id"]])
        assert got == sorted(got, key=lambda s: (s[1], [x.kind for x in secrets.RULES].index(s[0])))
    kinds = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in secrets.scan(docs).collect()}
    assert "forge" in kinds[7] and "chat" in kinds[8]


@pytest.mark.parametrize("pattern", ["abc(de|fg)+x", "(?:abc|xyz)d?[0-9]+", "a[bc]d{2}e", "x*abc", "(ab|c)*defg", "hello[ij]world", "ab"])
def test_trigram_queries_never_lose_a_match(pattern):
    import random

    rnd, query, rx = random.Random(1), query_of(pattern), re.compile(pattern)
    alphabet = sorted(set(re.sub(r"[^a-z0-9]", "", pattern))) + ["0"]
    for _ in range(20_000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(16)))
        if rx.search(text) and query is not None:
            assert any(all(t in text for t in clause) for clause in query), (text, query)


def test_rules_without_trigrams_scan_fully():
    assert query_of("[0-9a-f]+") is None and query_of("AKIA[A-Z]+") == [frozenset({"aki", "kia"})]
    assert {frozenset(c) for c in query_of("(?i:foobar|xyz)=")} == {frozenset({"foo", "oob", "oba", "bar", "ar="}), frozenset({"xyz", "yz="})}


def test_odd_rows(spark, odd_docs):
    rows = secrets.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r["spans"] for r in rows}
    assert by[1] == by[2] == by[3] == [] and len(by[5]) == 3000
    assert by[5][-1]["end"] == ("password = 'abcdefghijkl0123' word " * 3000).rindex("' word")
    assert secrets.scan(odd_docs.limit(0)).count() == 0
    assert len(pii.find_pii(odd_docs).collect()) == odd_docs.count() and pii.find_pii(odd_docs.limit(0)).count() == 0


def test_redaction_keeps_columns_and_clean_texts(spark, odd_docs, sf):
    out = secrets.stage(spark, odd_docs, sf)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    new = {r["doc_id"]: r for r in out.collect()}
    old = {r["doc_id"]: r for r in odd_docs.collect()}
    assert new[6]["text"] == "Ünï cödé 🙂 [REDACTED] tail" and new[6]["n_chars"] == len(new[6]["text"])
    assert new[5]["text"] == "[REDACTED]' word " * 3000
    for i in (1, 2, 3, 4, 7, 9, None):
        assert new[i] == old[i]


def test_patterns_begin_at_runs_of_digits():
    # one scan for digits stands for a scan of each pattern.
    rng = random.Random(7)
    parts = ["1", "12", "123", "4567", "0", "255", ".", "-", " ", "A", "DE", "GB82", "x", "\u0663", "123-45-6789", "1.2.3.4", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"]
    met = 0
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 12)))
        runs = [m.start() for m in pii.DIGITS.finditer(text)]
        letters = [r - 2 for r in runs if r >= 2 and "A" <= text[r - 1] <= "Z"]
        for pattern, starts in ((pii.IP, runs), (pii.CARD, runs), (pii.SSN, runs), (pii.IBAN, letters)):
            want = [m.span() for m in pattern.finditer(text)]
            assert [m.span() for m in pii.at_starts(pattern, text, starts)] == want
            met += len(want)
    assert met > 5_000
