"""Declarative line formats: a text of FORMAT blocks becomes columns of hits.

Compiling is driver work; matching is one expression over the line (and, for formats over
several lines, over the lines before it).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscan.tables import written

# Severities of formats, the keywords of slots, and what %t, %s, %s+, %s* and blanks stand for.
SEVERITIES = {"fatal": 2, "critical": 2, "severe": 2, "warning": 1, "minor": 1, "harmless": 0, "unknown": 0}
DISCARD, NO_RULE = "*DISCARD*", "NO MATCHING RULE"
DATE = r"(\w{3}\s+\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2})"
WORD, WORDS, TEXT, REST, BLANKS = r"([^\s]+)", r"([^\s]*?.+[^\s]*?)", r"(.*?)", r"(.*)", r"\s+"

HIT = "struct<exit_code:int,severity:string,format_name:string,subject:string,logline:string,slots:map<string,string>>"
#: Lines of a log that are looked at together, where formats span several lines.
BLOCK = 256


@dataclass
class Format:
    name: str
    follows: list[str] = field(default_factory=list)
    pattern: str = ""
    variables: dict[str, str] = field(default_factory=dict)
    slots: dict[str, str] = field(default_factory=dict)

    def patterns(self) -> list[str]:
        """A regular expression for each line of the format."""
        return [format_regex(p) for p in self.pattern.split("%n")]

    def can_match(self) -> bool:
        return self.name == DISCARD or "severity" in self.slots


def format_regex(pattern: str) -> str:
    """%s is a word, %s+ some words, %s* any text (to the end, if last), %t a date, blanks are any white space; all else is literal."""
    out, at = [], 0
    pattern = re.sub(r"%\[\d+\]s", "%s", pattern)
    for m in re.finditer(r"%s\+|%s\*\s*$|%s\*|%s|%t| +", pattern):
        out.append(_literal(pattern[at : m.start()]))
        token = m.group()
        out.append(BLANKS if token.isspace() else DATE if token == "%t" else WORDS if token == "%s+" else WORD if token == "%s" else REST if m.end() == len(pattern) else TEXT)
        at = m.end()
    out.append(_literal(pattern[at:]))
    # text in front needs no search for where it begins
    return ("(?m)^" if out[:2] in (["", TEXT], ["", REST]) else "") + "".join(out)


def _literal(text: str) -> str:
    """Brackets, ?, |, - and backslashes stand for themselves; other signs keep their meaning in patterns."""
    return re.sub(r"([\\()\[\]?|\-])", r"\\\1", text)


def parse_formats(text: str) -> list[Format]:
    """The formats of a text, in order; one that follows others starts with their variables and slots."""
    formats: list[Format] = []
    now: Format | None = None
    for raw in text.splitlines():
        line = raw.strip()
        if now is None:
            if m := re.match(r"FORMAT\s+(\S+)(?:\s+FOLLOWS\s+(.+))?$", line):
                now = Format(m[1], [f.strip() for f in (m[2] or "").split(",") if f.strip()])
                for name in now.follows:
                    for f in formats:
                        if f.name == name:
                            now.variables |= f.variables
                            now.slots |= f.slots
        elif line == "END":
            formats.append(now)
            now = None
        elif line.startswith("//") or not line:
            continue
        elif not now.pattern:
            now.pattern = line
        else:
            name, _, value = line.partition(" ")
            (now.variables if name.startswith("-") else now.slots)[name.lstrip("-")] = value.strip()
    return formats


def _value(f: Format, text: str, group, defaults: dict[str, str]) -> Column:
    if m := re.match(r"\$(\d+)", text):
        return group(int(m[1]))
    if text in ("LABEL", "FILENAME"):
        return F.lit(defaults.get(text, ""))
    return F.lit(text)


def _slots(f: Format, group, defaults: dict[str, str]) -> dict[str, Column]:
    plain = {k: v for k, v in f.slots.items() if not v.upper().startswith("PRINTF")}
    variables = {k: _value(f, v, group, defaults) for k, v in f.variables.items()}
    slots = {k: F.lit(defaults.get(k, defaults.get("DEFAULT", ""))) if v == "DEFAULT" else _value(f, v, group, defaults) for k, v in plain.items()}
    for k, v in f.slots.items():
        if k not in plain and (m := re.match(r'printf\("(.*?)"\s*,\s*(.*)\)', v, re.I)):
            names = re.split(r"\s*,\s*", m[2])
            slots[k] = F.format_string(m[1], *[variables.get(n, slots.get(n, F.lit(""))) for n in names])
    return slots


def format_hit(formats: list[Format], lines: list[Column], defaults: dict[str, str] | None = None, severity_map: dict[str, int] | None = None) -> Column:
    """The hit of the line (lines[0]; lines[i] is the i-th before it) as a struct (exit_code, severity, format_name, subject, logline, slots).

    The last format that matches wins; *DISCARD* gives null, and so does a line without any.
    """
    levels = SEVERITIES | {k.lower(): v for k, v in (severity_map or {}).items()}
    line, out = lines[0], None
    for f in reversed([f for f in formats if f.can_match()]):
        patterns = f.patterns()
        if len(patterns) > len(lines):
            continue
        at = [("(?d)" + p, lines[len(patterns) - 1 - i]) for i, p in enumerate(patterns)]
        found = None
        for p, x in at:
            test = F.coalesce(x.rlike(p), F.lit(False))
            found = test if found is None else found & test
        groups = [(p, x, i) for p, x in at for i in range(1, re.compile(p[4:]).groups + 1)]
        group = lambda n, groups=groups: F.regexp_extract(groups[n - 1][1], groups[n - 1][0], groups[n - 1][2]) if n <= len(groups) else F.lit("")
        if f.name == DISCARD:
            hit = F.lit(None).cast(HIT)
        else:
            slots = _slots(f, group, defaults or {})
            severity = slots["severity"]
            code = F.lit(None).cast("int")
            for name, n in levels.items():
                code = F.when(F.lower(severity) == name, n).otherwise(code)
            subject = F.coalesce(F.nullif(slots.get("msg", F.lit("")), F.lit("")), line)
            made = F.create_map(*[x for k, v in slots.items() for x in (F.lit(k), v)])
            hit = F.struct(code.alias("exit_code"), severity.alias("severity"), F.lit(f.name).alias("format_name"), subject.alias("subject"), line.alias("logline"), made.alias("slots"))
        out = F.when(found, hit) if out is None else out.when(found, hit)
    return out


def span(formats: list[Format]) -> int:
    """The most lines that one of the formats looks at."""
    return max((len(f.patterns()) for f in formats if f.can_match()), default=1)


def with_before(lines: DataFrame, most: int, order: tuple = ("file_seq", "line_no"), key: tuple = ("logfile",), carried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """lines with before, the most lines before each in its key, nearest first; and key, tail: those that the next run's first line has before it.

    carried: such tails of the run before. Lines are put together in blocks of BLOCK numbers
    of a file, so that no log is sorted in one task; what a block needs of those before it are the
    last lines of at most so many blocks, and only these go over the whole log. Equal places go by the line.
    """
    *above, last = order
    rest = [c for c in lines.columns if c not in (*key, *order, "line")]
    part = [*key, *above]
    rows = lines.withColumn("_block", F.floor(F.col(last) / BLOCK))
    by_place = lambda a, b: F.when(F.struct(a[last], a["line"]) < F.struct(b[last], b["line"]), -1).when(F.struct(a[last], a["line"]) > F.struct(b[last], b["line"]), 1).otherwise(0)
    blocks = written(rows.groupBy(*part, "_block").agg(F.array_sort(F.collect_list(F.struct(last, "line", *rest)), by_place).alias("_l")))
    none = F.array().cast("array<string>")
    tails = blocks.select(*part, "_block", F.slice(F.reverse(F.transform("_l", lambda x: x["line"])), 1, most).alias("_t"))
    w = Window.partitionBy(*key).orderBy(*above, "_block")  # over the ends of a log's blocks
    if carried is not None:
        tails = tails.join(carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("tail").alias("_c")), _same(key, [f"_k{i}" for i in range(len(key))]), "left").drop(*[f"_k{i}" for i in range(len(key))])
    farthest = F.coalesce("_c", none) if carried is not None else none
    halo = F.slice(F.concat(*[F.coalesce(F.lag("_t", i).over(w), none) for i in range(1, most + 1)], farthest), 1, most)
    ends = written(tails.withColumn("_h", halo))
    tail = ends.groupBy(*key).agg(F.max_by(F.slice(F.concat("_t", "_h"), 1, most), F.struct(*above, "_block")).alias("tail"))
    names = [f"_p{i}" for i in range(len(part) + 1)]
    halos = ends.select(*[F.col(c).alias(n) for c, n in zip([*part, "_block"], names, strict=True)], "_h")
    joined = blocks.join(halos, _same([*part, "_block"], names))
    line = lambda i: F.get(F.col("_l"), i)["line"]
    before = lambda i: F.array(*[F.when(i >= j, line(i - j)).otherwise(F.get(F.col("_h"), F.lit(j - 1) - i)) for j in range(1, most + 1)])
    each = F.transform("_l", lambda x, i: F.struct(x[last].alias(last), x["line"].alias("line"), *[x[c].alias(c) for c in rest], before(i).alias("before")))
    return joined.select(*part, F.explode(each).alias("_e")).select(*part, "_e.*").select(*lines.columns, "before"), tail


def _same(left: list[str] | tuple, right: list[str]) -> Column:
    """Whether columns are equal, nulls too."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def match_formats(lines: DataFrame, formats: list[Format], order: tuple = ("file_seq", "line_no"), key: tuple = ("logfile",), **given) -> DataFrame:
    """lines with hit, for those that a format matches. Lines before are looked up only if a format spans several."""
    most = span(formats) - 1
    if most:
        rows, _ = with_before(lines, most, order, key)
        before = [F.get(F.col("before"), F.lit(i)) for i in range(most)]
        return rows.withColumn("hit", format_hit(formats, [F.col("line"), *before], **given)).filter("hit is not null").drop("before")
    return lines.withColumn("hit", format_hit(formats, [F.col("line")], **given)).filter("hit is not null")
