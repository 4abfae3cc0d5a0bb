"""Many searches or patterns at once: rules as data in place of an expression for each.

Every rule has texts that a line must hold for it (see literals). The texts of all searches that
look at a line are in one automaton, which finds them in one pass over the line, however many there are;
what a line has of them names the few rules that can apply to it, and lines without any go no further.
Patterns that mean the same in both dialects are decided right there, each compiled once; other
regular expressions, as values of a row, are looked for where they always are, in the JVM, and the rest
(prefilters, exceptions, preferred level) is a handful of expressions over the array of rules
found. So neither the plan nor the code that Spark makes of it grows with the searches.

A rule without such a text applies to every line of its search; those of one kind are one alternation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscan.model import MISSED, VISITED, Search
from logscan.operators.literals import folded, plain, required

#: Kinds of rules, the first three also of events: a match, an all-clear, the appearance of a pattern that must appear; what takes matches back, what lines must hold, what they must not.
MATCHED, CLEARED, APPEARED, EXCEPTED, NEEDED, SKIPPED = range(6)
RULE = "struct<kind:int,level:string,pat_idx:int,pat_key:string,pattern:string,regex:string,sure:boolean>"
#: So many patterns or searches are tried one after the other, in compiled code; more are dispatched.
PATTERNS, SEARCHES = 40, 20


@dataclass
class Rules:
    """The rules of searches, numbered; those of a search follow on each other, its matches in the order of levels and patterns."""

    rows: list[tuple] = field(default_factory=list)
    texts: list[tuple[str, ...]] = field(default_factory=list)
    case: list[bool] = field(default_factory=list)
    alike: list[str | None] = field(default_factory=list)
    of: list[int] = field(default_factory=list)
    searches: list[tuple[str, int, str, int]] = field(default_factory=list)
    numbers: list[list[int]] = field(default_factory=list)

    def add(self, s: Search) -> None:
        n, own = len(self.searches), []

        def rule(kind: int, level: str | None, i: int, key: str | None, pattern: str) -> None:
            texts, whole = required(pattern)
            own.append(len(self.rows))
            alike = s.case and not whole and plain(pattern) is not None
            self.rows.append((kind, level, i, key, pattern if kind == MATCHED else None, s.flags() + pattern, s.case and (whole or alike)))
            self.alike.append(pattern if alike else None)
            self.texts.append(tuple(t if s.case else folded(t) for t in texts))
            self.case.append(s.case)
            self.of.append(n)

        def either(kind: int, level: str | None, patterns) -> None:
            plain = [p for p in patterns if not required(p)[0]]
            for p in [*(p for p in patterns if p not in plain), *(["|".join(f"(?:{p})" for p in plain)] if plain else [])]:
                rule(kind, level, 0, None, p)

        for level in VISITED:
            for i, key, p in s.rules(level):
                rule(MATCHED, level, i, key, p)
        for level in VISITED:
            if s.rules(level):
                either(EXCEPTED, level, s.exceptions.get(level.lower(), ()))
        either(CLEARED, None, list(s.ok))
        for level in MISSED:
            for i, _, p in s.must_appear(level):
                rule(APPEARED, level, i, None, p)
        for p in s.needed():
            rule(NEEDED, None, 0, None, p)
        either(SKIPPED, None, list(s.skip))
        self.searches.append((s.tag, len(s.needed()), (s.preferred_level or "").upper(), s.maxlength or 0))
        self.numbers.append(own)


def many(searches: list[Search]) -> bool:
    """Whether these are more than code can be made for."""
    return len(searches) > SEARCHES or sum(len(s.rules(level)) for s in searches for level in VISITED) > PATTERNS


class _Group:
    """The rules of all searches that look at the same lines, and the automata of their texts."""

    def __init__(self, rules: Rules, searches: list[int]):
        self.rules, self.always = rules, []
        by_text: tuple[dict[str, list], dict[str, list]] = ({}, {})
        for n in searches:
            for r in rules.numbers[n]:
                if texts := rules.texts[r]:
                    # the longest text is in the automaton, the others are looked for where it is found
                    by_text[rules.case[r]].setdefault(texts[0], []).append((r, texts[1] if len(texts) > 1 else ""))
                else:
                    self.always.append(r)
        self.waiting = not any(rules.rows[r][0] <= APPEARED for r in self.always)
        self.machines = []
        for case in (True, False):
            if by_text[case]:
                machine = ahocorasick.Automaton()
                for n, (t, numbers) in enumerate(by_text[case].items()):
                    machine.add_word(t, (n, numbers))
                machine.make_automaton()
                self.machines.append((case, machine))
        self.events = [r[0] <= APPEARED for r in rules.rows]
        self.compiled: dict[int, Callable] = {}

    def candidates(self, line: str) -> dict[int, list[int]]:
        """By number of search, the rules that a line may have; none of searches without one that can be an event."""
        found = []
        for case, machine in self.machines:
            text = line if case else folded(line)
            for numbers in dict(value for _, value in machine.iter(text)).values():
                found += [r for r, other in numbers if other in text]
        if not found and self.waiting:
            return {}
        out: dict[int, list[int]] = {}
        of, events, alike, compiled = self.rules.of, self.events, self.rules.alike, self.compiled
        for r in sorted([*found, *self.always]):
            if alike[r] is not None:
                if (search := compiled.get(r)) is None:
                    search = compiled[r] = plain(alike[r]).search
                if not search(line):
                    continue
            out.setdefault(of[r], []).append(r)
        return {n: own for n, own in out.items() if any(events[r] for r in own)}


def _sifted(shared, by: str, looking: dict, always: list[int], names: list[str]) -> Callable:
    """Of batches the lines with a candidate, once for each search that has one."""
    fields = [("kind", pa.int32()), ("level", pa.string()), ("pat_idx", pa.int32()), ("pat_key", pa.string()), ("pattern", pa.string()), ("regex", pa.string()), ("sure", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        table = pa.StructArray.from_arrays([pa.array([r[i] for r in rules.rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
        info = [pa.array([s[i] for s in rules.searches], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32()))]
        groups: dict = {}
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns, strict=True))
            rows, searches, flat, ends = [], [], [], [0]
            for i, (key, line) in enumerate(zip(get[by].to_pylist(), get["line"].to_pylist(), strict=True)):
                if line is None:
                    continue
                if (group := groups.get(key)) is None:
                    group = groups[key] = _Group(rules, [*always, *looking.get(key, ())])
                for n, own in group.candidates(line).items():
                    rows.append(i)
                    searches.append(n)
                    flat += own
                    ends.append(len(flat))
            if rows:
                at, n = pa.array(rows, pa.int64()), pa.array(searches, pa.int64())
                cands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(pa.array(flat, pa.int64())))
                yield pa.RecordBatch.from_arrays([*(get[c].take(at) for c in names), *(x.take(n) for x in info), cands], names=[*names, "tag", "_needed", "_preferred", "_maxlength", "_rules"])

    return run


def rule_events(lines: DataFrame, searches: list[Search], by: str = "tag", looking: dict | None = None, always: list[int] | None = None) -> DataFrame:
    """lines with tag, kind, level, pat_idx, pat_key, pattern, pat_pos and message: all that lines have for the searches that look at them.

    looking: by values of the column by, the places in searches of those that look at such lines; without it by is the
    tag. always: the places of those that look at every line.
    """
    rules = Rules()
    for s in searches:
        rules.add(s)
    looking = {s.tag: [n] for n, s in enumerate(searches)} if looking is None and always is None else looking or {}
    names = [c for c in lines.columns if c != "tag"]
    kept = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in names)
    shared = lines.sparkSession.sparkContext.broadcast(rules)  # configuration, as the searches are
    given = lines.select(*dict.fromkeys([*names, by]))
    sifted = given.mapInArrow(_sifted(shared, by, looking, always or [], names), f"{kept}, tag string, _needed int, _preferred string, _maxlength int, _rules array<{RULE}>")
    rules_, kind = F.col("_rules"), lambda k: lambda r: r["kind"] == k
    real = sifted.withColumn("_rules", F.filter(rules_, lambda r: r["sure"] | F.regexp_like("line", r["regex"])))
    real = real.filter(~F.exists(rules_, kind(SKIPPED)) & (F.size(F.filter(rules_, kind(NEEDED))) == F.col("_needed")))
    excepted = F.transform(F.filter(rules_, kind(EXCEPTED)), lambda r: r["level"])
    real = real.withColumn("_out", excepted)
    real = real.withColumn("_m", F.filter(rules_, lambda r: (r["kind"] == MATCHED) & ~F.array_contains("_out", r["level"])))
    liked = lambda r: r["level"] == F.col("_preferred")
    real = real.withColumn("_m", F.when(F.exists("_m", liked), F.filter("_m", liked)).otherwise(F.col("_m")))
    event = lambda r, at: F.struct(r["kind"].alias("kind"), r["level"].alias("level"), r["pat_idx"].alias("pat_idx"), r["pat_key"].alias("pat_key"), r["pattern"].alias("pattern"), at.alias("pat_pos"))
    zero = F.lit(0)
    cleared = F.slice(F.filter(rules_, kind(CLEARED)), 1, 1)
    all_ = F.concat(F.transform("_m", lambda r, i: event(r, i)), F.transform(cleared, lambda r: event(r, zero)), F.transform(F.filter(rules_, kind(APPEARED)), lambda r: event(r, zero)))
    out = real.withColumn("_e", F.explode(all_)).select(*names, "tag", "_maxlength", "_e.*")
    cut = F.when(F.col("_maxlength") > 0, F.substring("line", F.lit(1), F.col("_maxlength"))).otherwise(F.col("line"))
    message = F.when(F.length("line") == 0, "_(null)_").otherwise(cut)
    return out.withColumn("message", F.when(F.col("kind") == MATCHED, message)).drop("_maxlength")
