"""Which trigrams must a text hold for a regular expression to match in it?

A query is True (no demand), a trigram, or ("and" | "or", [queries]).
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from itertools import product

MOST = 64  # strings followed exactly through one part of a pattern


def _of_string(s: str):
    s = s.lower()
    return _all([s[i : i + 3] for i in range(len(s) - 2)])


def _all(qs):
    qs = [q for q in qs if q is not True]
    flat = []
    for q in qs:
        flat.extend(q[1] if isinstance(q, tuple) and q[0] == "and" else [q])
    flat = list(dict.fromkeys(map(_freeze, flat)))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _any(qs):
    if any(q is True for q in qs):
        return True
    flat = list(dict.fromkeys(map(_freeze, qs)))
    # a branch that demands all that another does, and more, adds nothing
    sets = [frozenset(_list(q)) if not _has_or(q) else None for q in flat]
    flat = [q for q, s in zip(flat, sets) if s is None or not any(o is not None and o < s for o in sets)]
    return flat[0] if len(flat) == 1 else ("or", flat)


def _has_or(q) -> bool:
    return isinstance(q, tuple) and (q[0] == "or" or any(map(_has_or, q[1])))


def _list(q) -> list[str]:
    return [] if q is True else [q] if isinstance(q, str) else [t for part in q[1] for t in _list(part)]


def _freeze(q):
    return (q[0], tuple(q[1])) if isinstance(q, tuple) else q


def _demand(strings: set[str]):
    return _any([_of_string(s) for s in sorted(strings)]) if strings else True


def _node(op, arg):
    """(all strings that it matches or None, query)."""
    if op is K.LITERAL:
        return {chr(arg)}, True
    if op is K.IN:
        chars: set[str] = set()
        for kind, v in arg:
            if kind is K.LITERAL:
                chars.add(chr(v))
            elif kind is K.RANGE and v[1] - v[0] < 12:
                chars.update(map(chr, range(v[0], v[1] + 1)))
            else:
                return None, True
            if len(chars) > 8:
                return None, True
        return chars, True
    if op is K.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(exact is not None for exact, _ in parts):
            return set().union(*(exact for exact, _ in parts)), True
        return None, _any([q if exact is None else _demand(exact) for exact, q in parts])
    if op is K.SUBPATTERN:
        return _sequence(arg[3])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        low, high, body = arg
        exact, q = _sequence(body)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, True
        if exact is not None and low == high and len(exact) ** low <= MOST:
            return {"".join(x) for x in product(exact, repeat=low)}, True
        if low == 0:
            return None, True
        return None, (_demand(exact) if exact is not None else q)
    if op is K.AT:
        return {""}, True
    return None, True


def _sequence(items):
    demands, run, exact = [], {""}, True
    for op, arg in items:
        strings, q = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a in run for b in strings}
            continue
        demands.append(_demand(run))
        demands.append(q)
        run, exact = (strings, False) if strings is not None else ({""}, False)
    if exact:
        return run, True
    demands.append(_demand(run))
    return None, _all(demands)


def query_of(pattern: str):
    exact, q = _sequence(parser.parse(pattern))
    return _demand(exact) if exact is not None else q


def thin(q, most: int = 5):
    """A weaker query with at most ``most`` trigrams in each conjunction, spread over it."""
    if q is True or isinstance(q, str):
        return q
    parts = [thin(p, most) for p in q[1]]
    if q[0] == "and" and len(parts) > most:
        parts = [parts[i * (len(parts) - 1) // (most - 1)] for i in range(most)]
    return (q[0], parts)


def trigrams_of(q) -> list[str]:
    return sorted(set(_list(q)))
