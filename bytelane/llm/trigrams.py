"""Boolean trigram queries derived from regular expressions.

`trigram_query(pattern)` returns a disjunction of trigram sets: every text
that the pattern matches contains, after lower-casing A-Z, all trigrams of at
least one set. An empty set means that the pattern has no mandatory trigram;
such a rule has to scan every text.
"""

from __future__ import annotations

from itertools import product

try:  # the parser of the standard library, under its name since 3.11
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_parse as parser

MAX_STRINGS = 64
MAX_CLASS = 16


def trigram_query(pattern: str) -> list[frozenset[str]]:
    best: list[frozenset[str]] = [frozenset()]
    for strings in _runs(list(parser.parse(pattern))):
        alternatives = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() in alternatives:
            continue
        both = {a | b for a, b in product(best, alternatives)}
        if len(both) <= MAX_STRINGS:
            # a set that holds another one adds nothing to the disjunction
            best = [a for a in sorted(both, key=sorted) if not any(b < a for b in both)]
    return best


def _runs(items) -> list[set[str]]:
    """Sets of strings, one of which must occur, for each stretch of finite items."""
    runs, run = [], {""}
    for item in items:
        finite = _finite(item)
        if finite is not None and len(run) * len(finite) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, finite)}
            continue
        runs.append(run)
        run = finite or {""}
    runs.append(run)
    return [r for r in runs if r != {""}]


def _finite(item) -> set[str] | None:
    """All strings an item can match (case-folded), or None if there are too many."""
    op, arg = item
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < MAX_CLASS:
                chars |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= MAX_CLASS else None
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        out: set[str] = set()
        for branch in arg[1]:
            strings = _sequence(branch)
            if strings is None:
                return None
            out |= strings
        return out if len(out) <= MAX_STRINGS else None
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        strings = _sequence(inner)
        if strings is None or high == parser.MAXREPEAT or int(high) > 4:
            return None
        out = set()
        for n in range(low, int(high) + 1):
            out |= {"".join(x) for x in product(strings, repeat=n)}
            if len(out) > MAX_STRINGS:
                return None
        return out
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        strings = _finite(item)
        if strings is None:
            return None
        out = {a + b for a, b in product(out, strings)}
        if len(out) > MAX_STRINGS:
            return None
    return out

