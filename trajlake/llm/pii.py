"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Defined results: NULL or empty text has no spans; positions are code points with an exclusive end; texts are
scanned whole in linear time; repeated rows are scanned row by row; an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import count_kind, spans_digest, table

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
ACCEPT = 0.5
REACH = 40

# Words that make a kind likelier when they stand shortly before it.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
# What a span scores before its context is looked at; checksummed kinds start high.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3}

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]++")
# These begin where a run of digits begins (an IBAN two letters before): from inside a run it would be the same text, shorter.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run before it, the domain follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c.isascii() and c.isdigit())


def at_starts(pattern: re.Pattern, text: str, starts: Iterable[int]) -> Iterator[re.Match]:
    """Leftmost matches of a pattern that can begin at ``starts`` only."""
    done = 0
    for at in starts:
        if at >= done and (m := pattern.match(text, at)):
            done = m.end()
            yield m


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, kind by kind in the listed order."""
    yield from (("email", a, b) for a, b in emails(text))
    runs = [m.start() for m in DIGITS.finditer(text)]  # one scan finds where all the following can begin
    for m in at_starts(IP, text, runs):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in at_starts(CARD, text, runs):
        if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_only_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in at_starts(IBAN, text, (r - 2 for r in runs if r >= 2 and "A" <= text[r - 1] <= "Z")):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end()
    for m in at_starts(SSN, text, runs):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9":
            yield "ssn", m.start(), m.end()


def scored(text: str | None) -> list[dict]:
    """All base spans, and those of other kinds that reach the accepted score."""
    if not text:
        return []
    out = []
    for kind, start, end in proposals(text):
        near = text[max(0, start - REACH) : start].lower()
        score = min(1.0, PRIOR[kind] + 0.3 * any(w in near for w in CONTEXT[kind]))
        if kind in BASE or score >= ACCEPT:
            out.append({"kind": kind, "start": start, "end": end, "score": score})
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = pa.array([scored(t.as_py()) for t in b.column(1)], type=SPANS)
        yield pa.RecordBatch.from_arrays([b.column(0), spans], names=["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, spans {SPANS_DDL}")


def op8(spark, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count_kind(spans, k).alias(f"n_{k}") for k in BASE],
        F.sha2(spans_digest(spans, BASE), 256).alias("base_sha256"), spans_digest(spans).alias("spans"),
    )
