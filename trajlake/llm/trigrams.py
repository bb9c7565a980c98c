"""Boolean trigram queries of regular expressions.

A query is a list of clauses; a text can match only if it holds every trigram of at least one clause.  ``None``
means that nothing is mandatory, so such a rule has to scan every text.  Letters are compared in lower case.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

Clause = frozenset[str]
Query = list[Clause] | None

MOST_STRINGS = 32
MOST_CLAUSES = 32


def _lower(c: str) -> str:
    return c.lower() if c.isascii() else c


def trigrams_of(text: str) -> Clause:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _simplest(clauses: list[Clause]) -> Query:
    """Without clauses that another one implies; None if some clause asks for nothing."""
    distinct = set(clauses)
    if frozenset() in distinct:
        return None
    kept = [c for c in distinct if not any(d < c for d in distinct)]
    return sorted(kept, key=sorted)


def _any(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _simplest(a + b)


def _all(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_CLAUSES:  # either side alone is still mandatory
        return min(a, b, key=len)
    return _simplest([x | y for x in a for y in b])


def _of_strings(strings: set[str]) -> Query:
    return _simplest([trigrams_of(s) for s in strings])


def _set_chars(items: list) -> set[str] | None:
    """Members of a small character class; None for large or negated ones."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(_lower(chr(value)))
        elif kind is op.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {_lower(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_STRINGS else None


def _strings(node) -> set[str] | None:
    """All strings that an element can match, if they are few."""
    kind, value = node
    if kind is op.LITERAL:
        return {_lower(chr(value))}
    if kind is op.IN:
        return _set_chars(value)
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[-1])
    if kind is op.BRANCH:
        each = [_sequence_strings(b) for b in value[1]]
        out = set().union(*each) if all(x is not None for x in each) else None
        return out if out is not None and len(out) <= MOST_STRINGS else None
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[1] <= 8:
        one = _sequence_strings(value[2])
        if one is None:
            return None
        out, power = set(), {""}
        for k in range(value[1] + 1):
            out |= power if k >= value[0] else set()
            power = {a + b for a in power for b in one}
            if len(power) + len(out) > MOST_STRINGS * 2:
                return None
        return out if len(out) <= MOST_STRINGS else None
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        more = _strings(n)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _sequence(nodes) -> Query:
    query: Query = None
    run = {""}  # what the exactly known stretch before this element can be
    for n in nodes:
        known = _strings(n)
        if known is not None and len(run) * len(known) <= MOST_STRINGS:
            run = {a + b for a in run for b in known}
            continue
        query = _all(query, _of_strings(run))
        run = known if known is not None else {""}
        if known is None:
            query = _all(query, _element(n))
    return _all(query, _of_strings(run))


def _element(node) -> Query:
    kind, value = node
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        out = _sequence(value[1][0])
        for b in value[1][1:]:
            out = _any(out, _sequence(b))
        return out
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
        return _sequence(value[2])
    return None


def query_of(pattern: str) -> Query:
    """The Boolean trigram query of ``pattern``."""
    return _sequence(_parser.parse(pattern, re.UNICODE))
