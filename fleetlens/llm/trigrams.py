"""Boolean trigram queries of regular expressions.

A query is a list of conditions that must all hold; a condition is a list of
trigram sets, one of which must be present in full. Everything is in lower
case, so a query lets through every text its expression can match, and more.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser

MAX_STRINGS = 256


def _product(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= MAX_STRINGS else None


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MAX_STRINGS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def _strings(node) -> set[str] | None:
    """Every string the node can match, if there are few; else None."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        found = _class(value)
        return found if found is not None and len(found) <= 8 else None
    if kind is op.AT:
        return {""}
    if kind is op.BRANCH:
        found = [_sequence_strings(branch) for branch in value[1]]
        return None if None in found else set().union(*found)
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[-1])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, body = value
        once = _sequence_strings(body) if high is not op.MAXREPEAT and high <= 8 else None
        if once is None:
            return None
        out, run = set(), {""}
        for n in range(int(high) + 1):
            if n >= low:
                out |= run
            run = _product(run, once)
            if run is None or len(out) > MAX_STRINGS:
                return None
        return out
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out: set[str] | None = {""}
    for node in nodes:
        found = _strings(node)
        out = None if found is None else _product(out, found)
        if out is None:
            return None
    return out


def _condition(strings: set[str]) -> list[frozenset[str]]:
    """One trigram set per string, without sets that contain another; [] if a string has none."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _runs(nodes, out: list[set[str]]) -> None:
    run: set[str] = {""}

    def flush():
        if run != {""}:
            out.append(set(run))

    for node in nodes:
        found = _strings(node)
        joined = None if found is None else _product(run, found)
        if joined is not None:
            run = joined
            continue
        flush()
        run = found if found is not None else {""}
        kind, value = node
        if found is None and kind is op.SUBPATTERN:
            _runs(value[-1], out)
        elif found is None and kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            _runs(value[2], out)
    flush()


def query(pattern: str) -> list[list[frozenset[str]]]:
    """The conditions of a regular expression; empty if no trigram is mandatory."""
    runs: list[set[str]] = []
    _runs(_parser.parse(pattern), runs)
    found = [c for c in map(_condition, runs) if c]
    return [c for i, c in enumerate(found) if c not in found[:i]]
