"""From a regular expression to the trigrams that any of its matches must hold.

The expression's syntax tree (Python's own parser) is read from the inside out. Each part has either the few
strings that it can match, or, where they are too many, the strings that its matches can begin and end with; and
a condition that every match meets. Conditions are ``None`` (no trigram is sure), a trigram, or
``("and" | "or", condition, ...)``. Trigrams are three bytes of UTF-8 text in which A-Z are lower-cased, as one
number; lower-casing both sides lets one index serve expressions with and without case.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as kind
from re import _parser as syntax

MOST_STRINGS = 32  # that a part is spelled out in
_AROUND = 2  # bytes of a beginning or an end that a trigram over its edge needs


def folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z alone


def number(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


def joined(how: str, parts: list):
    """The conjunction or disjunction of conditions, as small as it is easily made."""
    flat: list = []
    for p in parts:
        flat += p[1:] if isinstance(p, tuple) and p[0] == how else [p]
    if how == "or" and None in flat:
        return None
    flat = list(dict.fromkeys(p for p in flat if p is not None))
    if how == "or":  # what asks for more than another alternative adds nothing
        plain = [{p} if isinstance(p, int) else set(p[1:]) if p[0] == "and" and all(isinstance(x, int) for x in p[1:]) else None for p in flat]
        flat = [p for p, own in zip(flat, plain, strict=True) if own is None or not any(x is not None and x < own for x in plain)]
    return None if not flat else flat[0] if len(flat) == 1 else (how, *flat)


def _of_strings(strings: set[bytes]):
    """What holds if one of the strings occurs."""
    return joined("or", [joined("and", [number(s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


@dataclass
class Part:
    """What a part of an expression matches: ``exact`` strings, or else what matches begin and end with."""

    exact: set[bytes] | None
    begin: set[bytes]
    end: set[bytes]
    condition: object = None

    @staticmethod
    def spelled(strings: set[bytes]) -> Part:
        return Part(strings, strings, strings)

    def opened(self) -> Part:
        """The same with its strings turned into a condition, a beginning and an end."""
        if self.exact is None:
            return self
        edge = lambda cut: {cut(s) for s in self.exact}
        return Part(None, edge(lambda s: s[:_AROUND]), edge(lambda s: s[-_AROUND:]), joined("and", [self.condition, _of_strings(self.exact)]))

    def then(self, after: Part) -> Part:
        if self.exact is not None and after.exact is not None and len(self.exact) * len(after.exact) <= MOST_STRINGS:
            return Part.spelled({a + b for a, b in product(self.exact, after.exact)})
        a, b = self.opened(), after.opened()
        conditions = [a.condition, b.condition]
        ends, begins = self.exact or a.end, after.exact or b.begin
        if len(ends) * len(begins) <= MOST_STRINGS:  # trigrams over the edge
            conditions.append(_of_strings({x[-_AROUND:] + y[:_AROUND] for x, y in product(ends, begins)}))
        begin = {x + y for x, y in product(self.exact, b.begin)} if self.exact is not None else a.begin
        end = {x + y for x, y in product(a.end, after.exact)} if after.exact is not None else b.end
        return Part(None, begin if len(begin) <= MOST_STRINGS else {b""}, end if len(end) <= MOST_STRINGS else {b""}, joined("and", conditions))


_ANYTHING = Part(None, {b""}, {b""})
_NOTHING = {b""}


def _characters(items: list) -> Part:
    """A class: its characters, if they are few."""
    found: set[bytes] = set()
    for op, value in items:
        if op is kind.LITERAL:
            found.add(folded(chr(value)))
        elif op is kind.RANGE and value[1] - value[0] <= 2 * MOST_STRINGS:
            found |= {folded(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return _ANYTHING
    return Part.spelled(found) if len(found) <= MOST_STRINGS else _ANYTHING


def _either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
        return Part.spelled(set().union(*[p.exact for p in parts]))
    parts = [p.opened() for p in parts]
    edges = [set().union(*e) for e in ([p.begin for p in parts], [p.end for p in parts])]
    begin, end = (e if len(e) <= MOST_STRINGS else _NOTHING for e in edges)
    return Part(None, begin, end, joined("or", [p.condition for p in parts]))


def _repeated(part: Part, least: int, most: int) -> Part:
    if (least, most) == (0, 1):
        return _either([part, Part.spelled({b""})])
    if not least:
        return _ANYTHING
    whole = part
    for _ in range(min(least, 8) - 1):
        whole = whole.then(part)
    if least == most and least <= 8:
        return whole
    # more copies may follow: the first ones are at the beginning, the last ones at the end
    whole = whole.opened()
    return Part(None, whole.begin, whole.end, whole.condition)


def _part(tree) -> Part:
    found = Part.spelled({b""})
    for op, value in tree:
        if op is kind.LITERAL:
            part = Part.spelled({folded(chr(value))})
        elif op is kind.IN:
            part = _characters(value)
        elif op is kind.SUBPATTERN:
            part = _part(value[-1])
        elif op is kind.BRANCH:
            part = _either([_part(x) for x in value[1]])
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
            part = _repeated(_part(value[2]), value[0], value[1])
        elif op is kind.ATOMIC_GROUP:
            part = _part(value)
        elif op in (kind.AT, kind.ASSERT, kind.ASSERT_NOT):
            part = Part.spelled({b""})  # takes no characters, asks for no more than the rest
        else:
            part = _ANYTHING
        found = found.then(part)
    return found


def trigram_condition(pattern: str):
    """The condition that every text with a match of ``pattern`` meets; None if no trigram is sure.

    Case is taken as ASCII has it: a pattern that is matched without case must be matched with ``re.ASCII``.
    """
    return _part(syntax.parse(pattern)).opened().condition


def trigrams_of(condition) -> set[int]:
    if condition is None:
        return set()
    return {condition} if isinstance(condition, int) else set().union(*map(trigrams_of, condition[1:]))
