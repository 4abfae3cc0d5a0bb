"""Rules on lines: prefilters, patterns with exceptions, preferred level, all-clear and must-appear patterns.

The pass over lines is one narrow projection: an array of what a line has for its search,
exploded. Nothing is shuffled before that; all that follows works on matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscan.model import KEY, MISSED, ORD, VISITED, Search
from logscan.operators.dispatch import APPEARED, CLEARED, MATCHED, many, rule_events
from logscan.operators.formats import format_hit, parse_formats, span
from logscan.operators.literals import any_found, found
from logscan.tables import BROADCAST_ROWS

MATCH = "struct<tag:string,level:string,pat_idx:int,pat_key:string,pattern:string,text:string>"
EVENT = "struct<kind:int,level:string,pat_idx:int,pat_key:string,pattern:string,text:string,pat_pos:int>"
#: Levels by the exit codes of formats; lines of other codes are no matches.
BY_CODE = {1: "WARNING", 2: "CRITICAL", 3: "UNKNOWN"}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of value, which is computed once."""
    return F.transform(F.array(value), then)[0]


def _any(line: Column, search: Search, patterns: list[str]) -> Column:
    return any_found(line, list(patterns), search.flags(), search.case)


def accepted(line: Column, search: Search) -> Column:
    """Lines that hold all need patterns and no skip pattern."""
    needed = [found(line, p, search.flags(), search.case) for p in search.needed()]
    return reduce(lambda a, b: a & b, needed, F.lit(True)) & ~_any(line, search, search.skip)


def _match(search: Search, level: Column, i: int, key: Column, pattern: str, text: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(search.tag).alias("tag"), level.alias("level"), F.lit(i).alias("pat_idx"), key.alias("pat_key"), F.lit(pattern).alias("pattern"), (none if text is None else text).alias("text"))


def lines_before(search: Search) -> int:
    """How many lines before a line the search's formats look at."""
    return span(parse_formats(search.formats)) - 1 if search.formats else 0


def line_matches(line: Column, search: Search, before: tuple | list = ()) -> Column:
    """All matches of a line as an array: every pattern of a level counts, unless an exception of its level is found.

    before: the lines before it that passed the prefilter, nearest first, for formats over several lines; without them these do not match.
    """
    levels = []
    for level in VISITED:
        rules = search.rules(level)
        if not rules:
            continue
        each = F.array_compact(F.array(*[F.when(found(line, p, search.flags(), search.case), _match(search, F.lit(level), i, F.lit(k), p)) for i, k, p in rules]))
        exceptions = search.exceptions.get(level.lower(), ())
        excepted = _any(line, search, exceptions)  # looked for only if there is a match
        levels.append(F.filter(each, lambda _: ~excepted) if exceptions else each)
    if search.formats:
        hit = format_hit(parse_formats(search.formats), [line, *before], {"LABEL": search.host or "", "FILENAME": search.logfile or ""}, search.format_levels)
        if hit is not None:
            named = lambda h: reduce(lambda out, c: F.when(h["exit_code"] == c, BY_CODE[c]).otherwise(out), BY_CODE, F.lit(None).cast("string"))
            made = _let(hit, lambda h: F.when(named(h).isNotNull(), _match(search, named(h), 0, h["format_name"], "", h["subject"])))
            levels.append(F.array_compact(F.array(made)))
    if not levels:
        return F.array().cast(f"array<{MATCH}>")
    all_ = F.concat(*levels) if len(levels) > 1 else levels[0]
    preferred = (search.preferred_level or "").upper()
    if preferred in VISITED:
        is_preferred = lambda m: m["level"] == preferred
        all_ = _let(all_, lambda a: F.when(F.exists(a, is_preferred), F.filter(a, is_preferred)).otherwise(a))
    return F.when(accepted(line, search), all_)


def _message(line: Column, lengths: dict[str, int]) -> Column:
    """The line as a message, cut for the tags that ask for it."""
    message = line
    for tag, n in lengths.items():
        message = F.when(F.col("tag") == tag, F.substring(line, 1, n)).otherwise(message)
    return F.when(F.length(line) == 0, "_(null)_").otherwise(message)


def _lengths(searches: list[Search]) -> dict[str, int]:
    return {s.tag: s.maxlength for s in searches if s.maxlength}


def classify(lines: DataFrame, searches: list[Search]) -> DataFrame:
    """The columns of lines with tag, level, pat_idx, pat_key, pattern, pat_pos (place among the line's matches of the tag) and message, a row for each match.

    All searches look at a line in one pass; a search with a logfile sees only its lines. Formats over several lines need lines with
    their before (see formats.with_before) and do not match here.
    """
    plain = [s for s in searches if not s.formats]
    if many(plain):
        by_log: dict[str, list[int]] = {}
        for n, s in enumerate(plain):
            if s.logfile:
                by_log.setdefault(s.logfile, []).append(n)
        given = lines.drop("tag") if "logfile" in lines.columns else lines.drop("tag").withColumn("logfile", F.lit(None).cast("string"))
        out = rule_events(given, plain, "logfile", by_log, [n for n, s in enumerate(plain) if not s.logfile]).filter(F.col("kind") == MATCHED)
        out = out.select(*[c for c in lines.columns if c != "tag"], "tag", "level", "pat_idx", "pat_key", "pattern", "pat_pos", "message")
        rest = [s for s in searches if s.formats]
        return out.unionByName(classify(lines, rest)) if rest else out
    arrays = []
    for s in searches:
        each = F.transform(line_matches(F.col("line"), s), lambda m, i: F.struct(*[m[n].alias(n) for n in ("tag", "level", "pat_idx", "pat_key", "pattern", "text")], i.alias("pat_pos")))
        seen = F.col("logfile") == s.logfile if s.logfile else F.lit(True)
        arrays.append(F.coalesce(F.when(seen, each), F.array().cast(f"array<{MATCH[:-1]},pat_pos:int>>")))
    # the outer form, as the inner one would first test the array's size and so make it twice
    out = lines.withColumn("_m", F.explode_outer(F.concat(*arrays))).filter("_m is not null")
    out = out.select(*[c for c in lines.columns if c != "tag"], "_m.*")
    return out.withColumn("message", F.coalesce("text", _message(F.col("line"), _lengths(searches)))).drop("text")


def line_events(lines: DataFrame, searches: list[Search]) -> DataFrame:
    """key, file_seq, line_no, kind, level, pat_idx, pat_key, pattern, pat_pos, message: all that the lines (tag, host, logfile, ...) have for the searches of their tags, in one pass.

    kind tells matches, all-clear lines and appearances of patterns that must appear; lines with none of these give no row. Where
    lines have before (see formats.with_before), formats over several lines match too.
    """
    plain = [s for s in searches if not s.formats]
    if many(plain):
        out = rule_events(lines, plain).select(*KEY, *ORD, "kind", "level", "pat_idx", "pat_key", "pattern", "pat_pos", "message")
        rest = [s for s in searches if s.formats]
        return out.unionByName(line_events(lines, rest)) if rest else out
    line, none = F.col("line"), F.lit(None).cast("string")
    event = lambda kind, level, i: F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("string").alias("level"), F.lit(i).alias("pat_idx"), none.alias("pat_key"), none.alias("pattern"), none.alias("text"), F.lit(0).alias("pat_pos"))
    events = F.lit(None).cast(f"array<{EVENT}>")
    for s in searches:
        before = [F.get(F.col("before"), F.lit(i)) for i in range(lines_before(s))] if "before" in lines.columns else []
        parts = [F.transform(line_matches(line, s, before), lambda m, i: F.struct(F.lit(MATCHED).alias("kind"), *[m[n].alias(n) for n in ("level", "pat_idx", "pat_key", "pattern", "text")], i.alias("pat_pos")))]
        if s.ok:
            parts.append(F.array_compact(F.array(F.when(_any(line, s, s.ok), event(CLEARED, None, 0)))))
        wanted = [(level, i, p) for level in MISSED for i, _, p in s.must_appear(level)]
        if wanted:
            parts.append(F.array_compact(F.array(*[F.when(found(line, p, s.flags(), s.case), event(APPEARED, level, i)) for level, i, p in wanted])))
        own = F.concat(*parts) if len(parts) > 1 else parts[0]
        events = F.when(F.col("tag") == s.tag, F.when(accepted(line, s), own)).otherwise(events)
    out = lines.select(*KEY, *ORD, "line", F.explode_outer(events).alias("_e")).filter("_e is not null").select(*KEY, *ORD, "line", "_e.*")
    message = F.when(F.col("kind") == MATCHED, F.coalesce("text", _message(line, _lengths(searches))))
    return out.withColumn("message", message).drop("line", "text")


def classify_by_table(lines: DataFrame, rules: DataFrame, chunk: int = 100) -> DataFrame:
    """Matches for rules (level, pat_idx, regex, and any other columns) given as a table: lines with the columns of rules.

    rules is configuration: it is read on the driver, and each pattern becomes a test that is compiled once, sifted by its literal texts.
    """
    rows = rules.collect()
    if not rows:
        return lines.join(rules.limit(0), F.lit(False))
    rule = lambda r: F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in rules.schema.fields])
    tests = [F.when(found(F.col("line"), r["regex"], "(?d)"), rule(r)) for r in rows]
    parts = [F.array_compact(F.array(*tests[i : i + chunk])) for i in range(0, len(tests), chunk)]
    hits = F.concat(*parts) if len(parts) > 1 else parts[0]
    return lines.withColumn("_r", F.explode_outer(hits)).filter("_r is not null").select(*lines.columns, "_r.*")


def all_clear(lines: DataFrame, search: Search, key: tuple = KEY) -> DataFrame:
    """The last line of each key that an OK pattern clears, as ok_at."""
    cleared = lines.filter(accepted(F.col("line"), search) & _any(F.col("line"), search, search.ok))
    return cleared.groupBy(*key).agg(F.max(F.struct(*ORD)).alias("ok_at"))


def wipe(matches: DataFrame, clear: DataFrame, key: tuple = KEY) -> DataFrame:
    """Matches after the last all-clear line of their key; those on that line go too."""
    return matches.join(clear, list(key), "left").filter(F.col("ok_at").isNull() | (F.struct(*ORD) > F.col("ok_at"))).drop("ok_at")


def appearances(lines: DataFrame, search: Search, keys: DataFrame | None = None, key: tuple = KEY) -> DataFrame:
    """A row (key, level, pat_idx, message, seen: 1 or 0) for each key and must-appear pattern; keys: those to judge, even without lines."""
    wanted = [(level, i, p) for level in MISSED for i, _, p in search.must_appear(level)]
    ok = accepted(F.col("line"), search)
    flags = [F.max(F.when(ok & found(F.col("line"), p, search.flags(), search.case), 1).otherwise(0)).alias(f"_p{n}") for n, (_, _, p) in enumerate(wanted)]
    seen = lines.groupBy(*key).agg(*flags)
    if keys is not None:
        seen = keys.select(*key).distinct().join(seen, list(key), "left")
    rows = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(i).alias("pat_idx"), F.lit(f"MISSING: {p}").alias("message"), F.coalesce(F.col(f"_p{n}"), F.lit(0)).alias("seen")) for n, (level, i, p) in enumerate(wanted)])
    return seen.select(*key, F.explode(rows).alias("_r")).select(*key, "_r.*")


def missing_patterns(lines: DataFrame, search: Search, keys: DataFrame | None = None, key: tuple = KEY) -> DataFrame:
    """A row (key, level, pat_idx, message) for each must-appear pattern that no line of the key has; keys: those to report even without lines."""
    return appearances(lines, search, keys, key).filter("seen = 0").drop("seen")


def missing_events(events: DataFrame, searches: list[Search], keys: DataFrame) -> DataFrame | None:
    """The same from line_events for all searches, of the sources keys; None if no pattern must appear."""
    wanted = [(s.tag, level, i, p, f"MISSING: {p}") for s in searches for level in MISSED for i, _, p in s.must_appear(level)]
    if not wanted:
        return None
    rules = events.sparkSession.createDataFrame(wanted, "tag string, level string, pat_idx int, pattern string, message string")
    seen = events.filter(F.col("kind") == APPEARED).select(*KEY, "level", "pat_idx").distinct()
    asked = keys.select(*KEY).distinct().join(F.broadcast(rules) if len(wanted) <= BROADCAST_ROWS else rules, "tag")
    return asked.join(seen, [*KEY, "level", "pat_idx"], "left_anti").select(*KEY, "level", "pat_idx", "pattern", "message")


def with_captures(matches: DataFrame, regex: str, groups: int, column: str = "line") -> DataFrame:
    """captures: the groups of the pattern (null if a group is empty), and highest, the number of the last that is not."""
    each = F.array(*[F.nullif(F.regexp_extract(column, regex, i), F.lit("")) for i in range(1, groups + 1)])
    last = F.array_max(F.transform(each, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)))
    return matches.withColumns({"captures": each, "highest": last})


def row_captures(matches: DataFrame, search: Search) -> DataFrame:
    """captures: what the groups of a match's own pattern hold in its message, null for groups that hold nothing; empty for formats and for patterns without groups."""
    none = F.array().cast("array<string>")
    out = none
    for p in dict.fromkeys(p for level in VISITED for _, _, p in search.rules(level)):
        groups = matches.sparkSession._jvm.java.util.regex.Pattern.compile(search.flags() + p).matcher("").groupCount()
        if groups:
            each = F.array(*[F.nullif(F.regexp_extract("message", search.flags() + p, i), F.lit("")) for i in range(1, groups + 1)])
            out = F.when(F.col("pattern") == p, each).otherwise(out)
    return matches.withColumn("captures", out)
