"""Boolean trigram queries of regular expressions.

The expression's parse tree is folded from the leaves: of every part are known all strings
it can match, where these are few, or else how its matches can begin and end, and a query
that every text with a match satisfies. Concatenation adds the trigrams that lie across the
joint, alternation takes either side, repetition what its least number of rounds gives.
A query is an OR of alternatives, each the trigrams that must all occur in the lower-case
text; no alternatives: nothing is mandatory. What is given up (large classes, many strings,
references, characters beyond ASCII, whose lower case depends on the library) only weakens
a query. An expression that Python's parser rejects or may read otherwise than Java's has
no mandatory trigrams.
"""

import re
import warnings
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

# Most strings that a joint makes, alternatives of a query, and members of a class written out.
MOST = 16
ALTERNATIVES = 200
CLASS = 4
ROUNDS = 8
# Nested or intersected classes, vertical space, numbered escapes, Unicode case.
AMBIGUOUS = re.compile(r"&&|(?<!\\)\[(?:[^\]\\]|\\.)*?\[|\\[v0-9]|\(\?[a-zA-Z]*u", re.DOTALL)
ANYTHING = ((),)


def trigrams(literal: str) -> set[str]:
    low = literal.lower()
    return {low[i : i + 3] for i in range(len(low) - 2)}


def _once(values) -> tuple:
    return tuple(dict.fromkeys(values))


def _either(clauses) -> tuple:
    """OR; with an alternative that asks for nothing, nothing is mandatory."""
    clauses = _once(clauses)
    return clauses if all(clauses) and 0 < len(clauses) <= ALTERNATIVES else ANYTHING


def _fit(a: tuple, b: tuple) -> bool:
    """Whether all of one with all of the other are few; one with many stays as many."""
    return len(a) * len(b) <= (ALTERNATIVES if 1 in (len(a), len(b)) else MOST)


def _both(a: tuple, b: tuple) -> tuple:
    if a == b:
        return a
    if not _fit(a, b):
        return max(a, b, key=lambda q: min(map(len, q)))
    return _once(tuple(sorted({*x, *y})) for x, y in product(a, b))


def _of(strings) -> tuple:
    return _either(tuple(sorted(trigrams(s))) for s in strings)


@dataclass(frozen=True)
class Part:
    """``exact``: all that it matches, or None; else ``begins``, ``ends``: one of these is at
    either end of a match; ``query``: what a text with a match satisfies."""

    exact: tuple[str, ...] | None
    begins: tuple[str, ...] = ("",)
    ends: tuple[str, ...] = ("",)
    query: tuple = ANYTHING

    def needs(self) -> tuple:
        return self.query if self.exact is None else _of(self.exact)

    def open(self) -> "Part":
        """The same, as one of which not all strings are known."""
        if self.exact is None:
            return self
        begins, ends = _once(s[:2] for s in self.exact), _once(s[-2:] for s in self.exact)
        return Part(None, begins, ends, self.needs())

    def then(self, other: "Part") -> "Part":
        if self.exact is not None and other.exact is not None:
            if _fit(self.exact, other.exact):
                return Part(_once(a + b for a, b in product(self.exact, other.exact)))
        left = self.ends if self.exact is None else self.exact
        right = other.begins if other.exact is None else other.exact
        begins, ends, across = self.open().begins, other.open().ends, ANYTHING
        if _fit(left, right):
            joint = _once(a + b for a, b in product(left, right))
            across = _of(joint)
            # A short first or last part is followed or preceded by the other.
            begins = _once(s[:2] for s in joint) if self.exact is not None else begins
            ends = _once(s[-2:] for s in joint) if other.exact is not None else ends
        return Part(None, begins, ends, _both(_both(self.needs(), other.needs()), across))


NOTHING, UNKNOWN = Part(("",)), Part(None)


def _members(items) -> tuple[str, ...] | None:
    """The lower-case members of a class, if few."""
    found: dict[str, None] = {}
    for kind, value in items:
        low, high = (value, value) if kind is op.LITERAL else value if kind is op.RANGE else (0, 0x10FFFF)
        if high > 127 or high - low > 2 * CLASS:
            return None
        found |= dict.fromkeys(chr(c).lower() for c in range(low, high + 1))
    return tuple(found) if len(found) <= CLASS else None


def _part(kind, value) -> Part:
    if kind is op.LITERAL:
        return Part((chr(value).lower(),)) if value < 128 else UNKNOWN
    if kind is op.IN and value[0][0] is not op.NEGATE:
        return Part(members) if (members := _members(value)) else UNKNOWN
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return NOTHING
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value)
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        strings = _once(s for p in parts for s in p.exact or ())
        if all(p.exact is not None for p in parts) and len(strings) <= ALTERNATIVES:
            return Part(strings)
        begins, ends = (_once(s for p in parts for s in getattr(p.open(), x)) for x in ("begins", "ends"))
        return Part(None, begins, ends, _either(c for p in parts for c in p.needs()))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        one, out = _sequence(inner), NOTHING
        if least == 0:
            return Part(_once(("", *one.exact))) if most == 1 and one.exact is not None else UNKNOWN
        for _ in range(min(least, ROUNDS)):
            out = out.then(one)
        return out if least == most <= ROUNDS else out.open()
    return UNKNOWN


def _sequence(items) -> Part:
    out = NOTHING
    for kind, value in items:
        out = out.then(_part(kind, value))
    return out


def trigram_query(expression: str) -> list[list[str]]:
    """The alternatives, of which one holds in every text that the expression matches."""
    if AMBIGUOUS.search(expression):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(expression)
    except (re.error, Warning, OverflowError, RecursionError):
        return []
    if tree.state.flags & ~(re.UNICODE | re.IGNORECASE):
        return []
    query = _sequence(tree).needs()
    return [list(clause) for clause in query] if all(query) else []
