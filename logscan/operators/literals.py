"""Texts that every match of a pattern holds, so that most lines need no regular expression at all."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from re import _constants as sre
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of a pattern that are looked for, the longest ones.
MOST = 2


def _runs(parsed, out: list[str], now: list[str]) -> None:
    """Adds the runs of literal signs in a sequence; now is the run that is still open."""

    def close() -> None:
        if now:
            out.append("".join(now))
            now.clear()

    for op, value in parsed:
        if op is sre.LITERAL:
            now.append(chr(value))
        elif op is sre.SUBPATTERN and not value[1] and not value[2]:
            _runs(value[3], out, now)
        elif op is sre.ATOMIC_GROUP:
            _runs(value, out, now)
        else:
            close()
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0]:
                inner: list[str] = []
                _runs(value[2], out, inner)
                if inner:
                    out.append("".join(inner))


def _parsed(pattern: str):
    """What a pattern is, where both dialects of patterns read it alike as far as its literal texts go; else None."""
    # classes in classes; escapes that are a class here and one sign there; counts without a least
    if re.search(r"&&|\[[^\]]*\[|\\[vhHRXG0NcQE]|\{,", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = _parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    return None if parsed.state.flags & ~re.UNICODE else parsed


def required(pattern: str) -> tuple[list[str], bool]:
    """The longest literal texts of a pattern, and whether it is nothing but one; none where the two dialects of patterns might read it differently."""
    parsed = _parsed(pattern)
    if parsed is None:
        return [], False
    out: list[str] = []
    now: list[str] = []
    _runs(parsed, out, now)
    whole = not out and all(op is sre.LITERAL for op, _ in parsed)
    if now:
        out.append("".join(now))
    return sorted(set(out), key=lambda x: (-len(x), x))[:MOST], whole and bool(out)


def _alike(parsed) -> bool:
    """Whether all parts of a pattern mean the same in both dialects: signs, classes of signs, repeats, groups, alternatives, beginning and end."""
    for op, value in parsed:
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            inner = [value[2]]
        elif op is sre.SUBPATTERN:
            inner = [value[3]] if not value[1] and not value[2] else None
        elif op is sre.BRANCH:
            inner = value[1]
        elif op is sre.IN:
            inner = [] if all(o in (sre.LITERAL, sre.RANGE, sre.NEGATE, sre.CATEGORY) for o, _ in value) else None
        elif op is sre.AT:
            inner = [] if value in (sre.AT_BEGINNING, sre.AT_END) else None
        else:
            inner = [] if op in (sre.LITERAL, sre.NOT_LITERAL, sre.ANY) else None
        if inner is None or not all(map(_alike, inner)):
            return False
    return True


def plain(pattern: str) -> re.Pattern | None:
    """The pattern for Python, if whether it is found is the same for both dialects (with (?d) and no other flag)."""
    parsed = _parsed(pattern)
    return re.compile(pattern, re.ASCII) if parsed is not None and _alike(parsed) else None


def folded(text: str) -> str:
    """The text with A-Z in small letters, as patterns without case see it."""
    return text.translate(_SMALL)


_SMALL = {c: c + 32 for c in range(65, 91)}


def either(tests: list[Column], join: Callable[[Column, Column], Column] = lambda a, b: a | b) -> Column:
    """The tests joined, as a balanced tree."""
    while len(tests) > 1:
        tests = [join(*tests[i : i + 2]) if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def found(line: Column, pattern: str, flags: str, case: bool = True) -> Column:
    """Whether the pattern is found in the line: its literal texts are looked for first."""
    texts, whole = required(pattern)
    held = [F.contains(line if case else F.lower(line), F.lit(t if case else t.lower())) for t in texts]
    tests = held if whole and case else [*held, line.rlike(flags + pattern)]
    test = tests[0]
    for t in tests[1:]:
        test = test & t
    return test


def any_found(line: Column, patterns: list[str], flags: str, case: bool = True) -> Column:
    """Whether one of the patterns is found; those without literal texts are one alternation."""
    sifted = [p for p in patterns if required(p)[0]]
    plain = [p for p in patterns if p not in sifted]
    tests = [found(line, p, flags, case) for p in sifted]
    if plain:
        tests.append(line.rlike(flags + "|".join(f"(?:{p})" for p in plain)))
    return either(tests) if tests else F.lit(False)
