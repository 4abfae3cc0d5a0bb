"""Registered queries: each operator on the given tables, with the SQL that gives the same rows.

Lines are the lines of `documents` (logfile = source, file_seq = doc_id) and `conversations`;
structured events are `events` (host = user_id; error is CRITICAL, purchase is WARNING, signup
clears). A previous run is everything before SPLIT.
"""

from __future__ import annotations

import uuid
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscan.functions.text import html_encode, html_escape, url_decode
from logscan.jobs import scan, sinks
from logscan.model import Search, merge_searches, newest_configs, with_rules
from logscan.operators import callbacks, classify, events, formats, report, sticky, thresholds
from logscan.sources import feeds, incremental, records
from logscan.sources.lines import text_lines
from logscan.streaming import stream
from logscan.tables import shared_dir

SPLIT, END = "2024-01-15 00:00:00", "2024-01-31 00:00:00"
HOST = ("host",)
BY_LEVEL = ("host", "level")

SEARCH = Search(
    tag="docs",
    critical={"year": "[0-9]{4}", "mail": "@", "hash": "###"},
    warning={"junk": "%%%", "license": "[Ll]icense"},
    unknown={"the": r"\bthe the\b"},
    exceptions={"critical": ["[0-9]{16}"], "warning": ["&&&"]},
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(_table(spark, sf_dir, "documents"), "text", "source", "doc_id").withColumn("tag", F.lit("docs"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    level = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "WARNING")
    return e.select("event_id", F.col("user_id").cast("string").alias("host"), F.lit("events").alias("tag"), F.lit("events").alias("logfile"), F.lit(0).alias("file_seq"), F.unix_micros("ts").alias("line_no"), F.lit(0).alias("pat_pos"), "ts", level.alias("level"), "event_type", "value", F.col("props").alias("message"))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("level is not null")


def _cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("event_type = 'signup'").groupBy("host").agg(F.max(F.struct("file_seq", "line_no")).alias("ok_at"))


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def _text(ts) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


LINES = """lines AS (
  SELECT source AS logfile, doc_id AS file_seq, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"""
EVENTS = """ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS host, epoch_us(ts) AS line_no, ts, event_type, value, props AS message,
         CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'WARNING' END AS level FROM events)"""
#: Each pattern of SEARCH with its exceptions.
MATCHES = (
    LINES
    + """, rules(level, pat_idx, pat_key, re) AS (VALUES ('CRITICAL', 0, 'year', '[0-9]{4}'), ('CRITICAL', 1, 'mail', '@'), ('CRITICAL', 2, 'hash', '###'),
  ('WARNING', 0, 'junk', '%%%'), ('WARNING', 1, 'license', '[Ll]icense'), ('UNKNOWN', 0, 'the', '\\bthe the\\b')
), matches AS (
  SELECT l.*, r.level, r.pat_idx, r.pat_key FROM lines l JOIN rules r ON regexp_matches(l.line, r.re)
  WHERE NOT (r.level = 'CRITICAL' AND regexp_matches(l.line, '[0-9]{16}')) AND NOT (r.level = 'WARNING' AND regexp_matches(l.line, '&&&')))"""
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- lines and rules


@register(f"WITH {LINES} SELECT logfile, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM lines GROUP BY logfile")
def lines_per_source(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("logfile").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line").cast("long")).alias("bytes"))


@register(f"WITH {MATCHES} SELECT logfile, level, pat_idx, count(*) AS n FROM matches GROUP BY ALL")
def classify_exceptions(spark, sf_dir):
    return classify.classify(_lines(spark, sf_dir), [SEARCH]).groupBy("logfile", "level", "pat_idx").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {LINES} SELECT logfile, file_seq, line_no, level, pat_idx FROM lines, (VALUES ('CRITICAL', 0, '[0-9]{{4}}'), ('CRITICAL', 1, '@'), ('WARNING', 0, 'icense')) r(level, pat_idx, re)
  WHERE regexp_matches(line, re)""")
def classify_patterns(spark, sf_dir):
    s = Search(tag="docs", critical=["[0-9]{4}", "@"], warning=["icense"])
    return classify.classify(_lines(spark, sf_dir), [s]).select("logfile", "file_seq", "line_no", "level", "pat_idx")


@register(f"WITH {MATCHES} SELECT level, pat_key, count(*) AS n, count(DISTINCT logfile) AS sources FROM matches GROUP BY ALL")
def pattern_keys(spark, sf_dir):
    return classify.classify(_lines(spark, sf_dir), [SEARCH]).groupBy("level", "pat_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("logfile").alias("sources"))


@register(f"""WITH {MATCHES}, pref AS (SELECT DISTINCT file_seq, line_no FROM matches WHERE level = 'WARNING')
SELECT m.logfile, m.level, count(*) AS n FROM matches m LEFT JOIN pref p USING (file_seq, line_no) WHERE p.file_seq IS NULL OR m.level = 'WARNING' GROUP BY ALL""")
def preferred_level(spark, sf_dir):
    from dataclasses import replace

    return classify.classify(_lines(spark, sf_dir), [replace(SEARCH, preferred_level="warning")]).groupBy("logfile", "level").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {MATCHES}, clear AS (SELECT logfile, max((file_seq, line_no)) AS ok_at FROM lines WHERE regexp_matches(line, 'Apache License') GROUP BY logfile)
SELECT m.logfile, m.file_seq, m.line_no, m.level, m.pat_idx FROM matches m LEFT JOIN clear c USING (logfile) WHERE c.ok_at IS NULL OR (m.file_seq, m.line_no) > c.ok_at""")
def ok_wipe(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    clear = classify.all_clear(lines, Search(tag="docs", ok=["Apache License"]))
    return classify.wipe(classify.classify(lines, [SEARCH]), clear).select("logfile", "file_seq", "line_no", "level", "pat_idx")


@register(f"""WITH {LINES}, wanted(level, pat_idx, re) AS (VALUES ('CRITICAL', 1, 'no such text'), ('CRITICAL', 2, 'Apache License'), ('WARNING', 0, '[0-9]{{16}}')),
logs AS (SELECT DISTINCT logfile FROM lines)
SELECT g.logfile, w.level, w.pat_idx, 'MISSING: ' || w.re AS message FROM logs g, wanted w
WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.logfile = g.logfile AND regexp_matches(l.line, w.re))""")
def missing_patterns(spark, sf_dir):
    s = Search(tag="docs", critical=["@", "!no such text", "!Apache License"], warning=["![0-9]{16}"])
    return classify.missing_patterns(_lines(spark, sf_dir), s).select("logfile", "level", "pat_idx", "message")


@register(f"WITH {LINES} SELECT logfile, count(*) AS n FROM lines WHERE regexp_matches(line, 'the') AND regexp_matches(line, 'ing') AND NOT regexp_matches(line, '%%%|###') GROUP BY logfile")
def need_skip_filter(spark, sf_dir):
    s = Search(tag="docs", need=["the", "ing"], skip=["%%%", "###"])
    return _lines(spark, sf_dir).filter(classify.accepted(F.col("line"), s)).groupBy("logfile").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {LINES} SELECT logfile, count(*) AS n FROM lines WHERE regexp_matches(line, '(?i)LICENSE|WAS THE') GROUP BY logfile")
def nocase_match(spark, sf_dir):
    s = Search(tag="docs", critical=["LICENSE|WAS THE"], case=False)
    return classify.classify(_lines(spark, sf_dir), [s]).groupBy("logfile").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {LINES} SELECT file_seq, line_no, regexp_extract(line, '([A-Za-z]+)[.]([0-9]+)@([a-z0-9]+)', 1) AS c1, regexp_extract(line, '([A-Za-z]+)[.]([0-9]+)@([a-z0-9]+)', 3) AS c3, 3 AS highest
FROM lines WHERE regexp_matches(line, '([A-Za-z]+)[.]([0-9]+)@([a-z0-9]+)')""")
def capture_groups(spark, sf_dir):
    rx = "([A-Za-z]+)[.]([0-9]+)@([a-z0-9]+)"
    found = classify.with_captures(classify.classify(_lines(spark, sf_dir), [Search(tag="docs", critical=[rx])]), rx, 3)
    return found.select("file_seq", "line_no", F.col("captures")[0].alias("c1"), F.col("captures")[2].alias("c3"), "highest")


@register(f"""WITH {LINES}, rules AS (SELECT n_nationkey AS pat_idx, CASE n_regionkey WHEN 0 THEN 'CRITICAL' ELSE 'WARNING' END AS level, 'th' || substr('abcdefghijklmnopqrstuvwxyz', n_nationkey + 1, 1) || '[a-z]+t' AS re FROM nation)
SELECT r.level, r.pat_idx, count(*) AS n FROM lines l JOIN rules r ON regexp_matches(l.line, r.re) GROUP BY ALL""")
def pattern_table(spark, sf_dir):
    letter = F.expr("substr('abcdefghijklmnopqrstuvwxyz', n_nationkey + 1, 1)")
    rules = _table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") == 0, "CRITICAL").otherwise("WARNING").alias("level"), F.col("n_nationkey").alias("pat_idx"), F.concat(F.lit("th"), letter, F.lit("[a-z]+t")).alias("regex"))
    return classify.classify_by_table(_lines(spark, sf_dir), rules).groupBy("level", "pat_idx").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {EVENTS} SELECT host, count(*) AS n FROM ev WHERE host IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 5) GROUP BY host""")
def host_semi_join(spark, sf_dir):
    hosts = _table(spark, sf_dir, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("host"))
    return events.of_hosts(_events(spark, sf_dir), hosts).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS conv, turn, 'host_' || CAST(conv_id % 3 AS VARCHAR) AS host, text FROM conversations)
SELECT 'talk_' || host AS tag, count(*) AS n FROM t WHERE regexp_matches(text, '[.]$') GROUP BY host""")
def expand_templates(spark, sf_dir):
    from logscan.model import expand_templates as expand

    lines = _table(spark, sf_dir, "conversations").select(F.concat(F.lit("host_"), (F.col("conv_id") % 3).cast("string")).alias("logfile"), F.col("text").alias("line"))
    lines = lines.withColumn("line", F.concat("logfile", F.lit(" "), "line"))
    return classify.classify(lines, expand([Search(tag="talk", critical=["[.]$"], template=True)], ["host_0", "host_1", "host_2"])).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT p_brand AS tag, p_type AS template, p_partkey AS version FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1""")
def merge_configs(spark, sf_dir):
    """Each part as a configuration of its brand; the newest counts."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag"), F.col("p_type").alias("template"), F.col("p_partkey").alias("version"))
    return newest_configs(rows).select("tag", "template", "version")


@register(f"""WITH {LINES}, rules(tag, level, pat_idx, re) AS (VALUES ('a', 'CRITICAL', 0, '[0-9]{{16}}'), ('a', 'CRITICAL', 1, '###'), ('a', 'CRITICAL', 2, '@'), ('a', 'WARNING', 0, '%%%'), ('b', 'CRITICAL', 0, '[Ll]icense'))
SELECT r.tag, r.level, r.pat_idx, count(*) AS n FROM lines l JOIN rules r ON regexp_matches(l.line, r.re) WHERE NOT (r.tag = 'a' AND r.level = 'CRITICAL' AND regexp_matches(l.line, '&&&|the the')) GROUP BY ALL""")
def rule_sets(spark, sf_dir):
    """A search with the rules of two sets in front of its own, and a configuration that takes the place of an older one of the same tag."""
    a = Search(tag="a", critical={"mail": "@"}, exceptions={"critical": ["&&&"]})
    a = with_rules(a, [{"critical": {"hash": "###"}, "warning": ["%%%"]}, {"critical": ["[0-9]{16}"], "exceptions": {"critical": ["the the"]}}])
    merged = merge_searches([[a, Search(tag="b", critical=["never"])], [Search(tag="b", critical=["[Ll]icense"])]])
    return classify.classify(_lines(spark, sf_dir), merged).groupBy("tag", "level", "pat_idx").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH t AS (SELECT CASE conv_id % 4 WHEN 3 THEN 'localhost' ELSE 'web.' || CAST(conv_id % 4 AS VARCHAR) END AS host, text FROM conversations), l AS (SELECT host, host || ' ' || text AS line FROM t)
SELECT 'client' AS tag, host, count(*) AS n FROM l WHERE regexp_matches(line, 'web.[12]') AND regexp_matches(line, 'the') GROUP BY host
UNION ALL SELECT 'server', host, count(*) FROM l WHERE regexp_matches(line, '(web[.]0|localhost)') AND regexp_matches(line, 'the') GROUP BY host""")
def client_server(spark, sf_dir):
    """Lines of the hosts that a search is for, and those of a host itself."""
    c = _table(spark, sf_dir, "conversations")
    host = F.when(F.col("conv_id") % 4 == 3, "localhost").otherwise(F.concat(F.lit("web."), (F.col("conv_id") % 4).cast("string")))
    lines = c.select(host.alias("host"), F.lit("talk").alias("logfile"), F.concat(host, F.lit(" "), "text").alias("line"))
    searches = [Search(tag="client", critical=["the"], client="web.[12]"), Search(tag="server", critical=["the"], server="web.0")]
    return classify.classify(lines, searches).groupBy("tag", "host").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- thresholds and sticky alerts

NUMBERED = f"{EVENTS}, num AS (SELECT *, row_number() OVER (PARTITION BY host, level ORDER BY line_no) AS k FROM ev WHERE level IS NOT NULL)"


@register(f"WITH {NUMBERED} SELECT host, level, event_id FROM num WHERE k % 10 = 0")
def threshold_every_nth(spark, sf_dir):
    return thresholds.apply_threshold(_alerts(spark, sf_dir), 10, key=BY_LEVEL).select("host", "level", "event_id")


@register(f"WITH {EVENTS}, num AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY line_no) AS k FROM ev WHERE level IS NOT NULL) SELECT level, event_id FROM num WHERE k % 25 = 0")
def threshold_hot_key(spark, sf_dir):
    """One key for all events: numbered by day, with the days' counts added up."""
    rows = _alerts(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return thresholds.apply_threshold(rows, 25, key=("level",), hot="day").select("level", "event_id")


def _carry(spark, sf_dir) -> DataFrame:
    return thresholds.next_carry(_alerts(spark, sf_dir).filter(F.col("ts") < _ts(SPLIT)), 10, key=BY_LEVEL)


@register(f"""WITH {EVENTS}, old AS (SELECT host, level, count(*) % 10 AS c FROM ev WHERE level IS NOT NULL AND ts < '{SPLIT}' GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY host, level ORDER BY line_no) AS k FROM ev WHERE level IS NOT NULL AND ts >= '{SPLIT}')
SELECT n.host, n.level, n.event_id FROM num n LEFT JOIN old o USING (host, level) WHERE (coalesce(o.c, 0) + n.k) % 10 = 0""")
def threshold_carry(spark, sf_dir):
    new = _alerts(spark, sf_dir).filter(F.col("ts") >= _ts(SPLIT))
    return thresholds.apply_threshold(new, 10, _carry(spark, sf_dir), key=BY_LEVEL).select("host", "level", "event_id")


@register(f"""WITH {EVENTS} SELECT host, level, count(*) % 10 AS carry FROM ev WHERE level IS NOT NULL GROUP BY ALL""")
def threshold_next_carry(spark, sf_dir):
    new = _alerts(spark, sf_dir).filter(F.col("ts") >= _ts(SPLIT))
    return thresholds.next_carry(new, 10, _carry(spark, sf_dir), key=BY_LEVEL)


@register(f"""WITH {EVENTS} SELECT host, level, count(*) FILTER (WHERE epoch(TIMESTAMP '{SPLIT}') - floor(epoch(ts)) <= 86400) AS carry FROM ev WHERE level IS NOT NULL AND ts < '{SPLIT}' GROUP BY ALL""")
def threshold_expiry(spark, sf_dir):
    return thresholds.live_counts(_alerts(spark, sf_dir).filter(F.col("ts") < _ts(SPLIT)), _ts(SPLIT), 86400, key=BY_LEVEL, when="ts")


@register(f"""WITH {EVENTS}, clear AS (SELECT host, max(ts) AS ok FROM ev WHERE event_type = 'signup' AND ts >= '{SPLIT}' AND ts < '2024-01-16' GROUP BY host)
SELECT e.host, e.level, count(*) AS n FROM ev e LEFT JOIN clear c USING (host)
WHERE e.level IS NOT NULL AND e.ts < '2024-01-16' AND CASE WHEN e.ts < '{SPLIT}' THEN c.ok IS NULL AND epoch(TIMESTAMP '2024-01-16') - floor(epoch(e.ts)) <= 5 * 86400 ELSE c.ok IS NULL OR e.ts > c.ok END GROUP BY ALL""")
def sticky_alerts(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("when", F.col("ts"))
    alerts, now = e.filter("level is not null"), _ts("2024-01-16")
    new = (F.col("ts") >= _ts(SPLIT)) & (F.col("ts") < now)
    clear = e.filter((F.col("event_type") == "signup") & new).groupBy("host").agg(F.max("ts").alias("ok_when"))
    kept = sticky.apply_sticky(alerts.filter(new), alerts.filter(F.col("ts") < _ts(SPLIT)), clear, now, 5 * 86400, key=HOST)
    return kept.groupBy("host", "level").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {EVENTS}, c AS (SELECT host, level, date_trunc('second', ts) AS s, count(*) AS n FROM ev WHERE level IS NOT NULL GROUP BY ALL),
l AS (SELECT host, level, arg_max(message, ts) AS last_message FROM ev WHERE level IS NOT NULL GROUP BY ALL)
SELECT c.host, c.level, strftime(c.s, '%Y-%m-%d %H:%M:%S') AS second, c.n, l.last_message FROM c JOIN l USING (host, level)""")
def sticky_compact(spark, sf_dir):
    out = sticky.compact_sticky(_alerts(spark, sf_dir).withColumn("when", F.col("ts")), key=HOST)
    return out.select("host", "level", _text("when").alias("second"), "n", "last_message")


# ---------------------------------------------------------------- reports

COUNTS = "count(*) FILTER (WHERE level = 'CRITICAL') AS criticals, count(*) FILTER (WHERE level = 'WARNING') AS warnings, count(*) FILTER (WHERE level = 'UNKNOWN') AS unknowns"


@register(f"""WITH {MATCHES}, r AS (SELECT logfile, count(*) AS lines FROM lines GROUP BY ALL), m AS (SELECT logfile, {COUNTS} FROM matches GROUP BY ALL)
SELECT logfile, lines, coalesce(criticals, 0) AS criticals, coalesce(warnings, 0) AS warnings, coalesce(unknowns, 0) AS unknowns FROM r LEFT JOIN m USING (logfile)""")
def perf_counters(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return report.perf_counters(lines, classify.classify(lines, [SEARCH]), "logfile")


@register(f"""WITH {MATCHES}, r AS (SELECT logfile, count(*) AS lines FROM lines GROUP BY ALL), m AS (SELECT logfile, {COUNTS} FROM matches GROUP BY ALL)
SELECT logfile, format('''{{0}}_lines''={{1}} ''{{0}}_warnings''={{2}} ''{{0}}_criticals''={{3}} ''{{0}}_unknowns''={{4}}', logfile, lines, coalesce(warnings, 0), coalesce(criticals, 0), coalesce(unknowns, 0)) AS perf FROM r LEFT JOIN m USING (logfile)""")
def perf_text(spark, sf_dir):
    return report.perf_text(perf_counters(spark, sf_dir), "logfile")


@register(f"WITH {MATCHES} SELECT logfile, {COUNTS} FROM matches GROUP BY ROLLUP (logfile)")
def level_rollup(spark, sf_dir):
    return report.level_rollup(classify.classify(_lines(spark, sf_dir), [SEARCH]), "logfile")


RANK = "CASE level WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END"


@register(f"""WITH {MATCHES}, n AS (SELECT *, row_number() OVER (PARTITION BY logfile ORDER BY {RANK} DESC, file_seq DESC, line_no DESC, pat_idx DESC) AS nth FROM matches)
SELECT logfile, level, CAST(CASE level WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 WHEN 'UNKNOWN' THEN 3 ELSE 0 END AS INTEGER) AS code, line AS message FROM n WHERE nth = 1""")
def search_result(spark, sf_dir):
    return report.search_result(classify.classify(_lines(spark, sf_dir), [SEARCH]), key=("logfile",))


@register(f"""WITH {MATCHES}, n AS (SELECT *, row_number() OVER (PARTITION BY logfile, level ORDER BY file_seq DESC, line_no DESC, pat_idx DESC) AS nth, count(*) OVER (PARTITION BY logfile, level) AS n FROM matches)
SELECT logfile, level, line || CASE WHEN n <> 1 THEN ' ...' ELSE '' END AS message, n FROM n WHERE nth = 1""")
def last_message(spark, sf_dir):
    return report.last_message(classify.classify(_lines(spark, sf_dir), [SEARCH]), key=("logfile",))


PREVIEW = f"{EVENTS}, newest AS (SELECT message, line_no FROM ev WHERE level = 'CRITICAL' ORDER BY line_no DESC LIMIT 5)"


@register(f"WITH {PREVIEW} SELECT string_agg(message, ', ' ORDER BY line_no DESC) AS preview FROM newest")
def preview_topk(spark, sf_dir):
    return report.preview(_alerts(spark, sf_dir), 5, ("file_seq", "line_no"))


@register(f"""WITH {PREVIEW}, c AS (SELECT {COUNTS} FROM ev)
SELECT 'CRITICAL' AS level, 2 AS code, 'CRITICAL - (' || criticals || ' errors, ' || warnings || ' warnings) - ' || (SELECT string_agg(message, ', ' ORDER BY line_no DESC) FROM newest) || ' ...' AS text, criticals, warnings, unknowns FROM c""")
def service_result(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    return report.service_result(alerts, report.preview(alerts, 5, ("file_seq", "line_no")))


@register(f"""WITH {EVENTS}, body AS (SELECT 'u' || (CAST(host AS BIGINT) % 5) AS tag, level, CASE level WHEN 'CRITICAL' THEN 1 ELSE 2 END AS p, line_no, message AS text FROM ev WHERE level IS NOT NULL),
r AS (SELECT tag, 'CRITICAL' AS level, 0 AS p, -1 AS line_no, 'tag ' || tag || ' CRITICAL' AS text FROM body GROUP BY tag UNION ALL SELECT * FROM body),
o AS (SELECT *, sum(length(text)) OVER (PARTITION BY tag ORDER BY p, line_no ROWS UNBOUNDED PRECEDING) AS run FROM r),
t AS (SELECT *, sum(length(text)) OVER (ORDER BY tag, p, line_no ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (ORDER BY tag, p, line_no) AS seq FROM o WHERE run < 4096)
SELECT CAST(seq AS INTEGER) AS seq, tag, level, text FROM t WHERE total < 4096""")
def long_report(spark, sf_dir):
    alerts = _alerts(spark, sf_dir).withColumn("tag", F.concat(F.lit("u"), (F.col("host").cast("long") % 5).cast("string")))
    return report.long_report(alerts, 4096, ("file_seq", "line_no"))


@register("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp'), '<', '&lt'), '>', '&gt'), '\"', '&quot')) AS encoded, md5(replace(replace(html, '<', '&lt;'), '>', '&gt;')) AS escaped, url_decode(replace(url, '/', '%2F')) AS url FROM pages")
def html_encoding(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(html_encode(F.col("html"))).alias("encoded"), F.md5(html_escape(F.col("html"))).alias("escaped"), url_decode(F.replace("url", F.lit("/"), F.lit("%2F"))).alias("url"))


@register(f"""WITH {MATCHES} SELECT level || ' Errors in ' || logfile || ' (tag docs)' AS header, level, file_seq, line_no, line AS message FROM matches""")
def protocol(spark, sf_dir):
    found = classify.classify(_lines(spark, sf_dir), [SEARCH])
    return sinks.protocol(found, _ts(SPLIT)).select("header", "level", "file_seq", "line_no", "message")


@register("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS run_date FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-06-01' - INTERVAL 7 DAY")
def retention(spark, sf_dir):
    from datetime import date

    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("run_date"))
    return sinks.keep_protocol(rows, date(1998, 6, 1)).select("o_orderkey", F.date_format("run_date", "yyyy-MM-dd").alias("run_date"))


# ---------------------------------------------------------------- events


@register(f"WITH {EVENTS} SELECT host, count(*) AS n, round(sum(value), 2) AS total FROM ev WHERE ts >= '2024-01-10' AND ts < '{SPLIT}' GROUP BY host")
def event_window(spark, sf_dir):
    rows = events.event_window(_events(spark, sf_dir), _ts("2024-01-10"), _ts(SPLIT))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register(f"WITH {EVENTS} SELECT event_id FROM ev WHERE ts >= TIMESTAMP '{SPLIT}' - INTERVAL 36 HOUR AND ts < '{SPLIT}'")
def event_lookback(spark, sf_dir):
    """The events of a run that looks back for some time."""
    return events.event_window(_events(spark, sf_dir), events.since(None, _ts(SPLIT), "36h"), _ts(SPLIT)).select("event_id")


@register(f"WITH {EVENTS} SELECT event_id, event_type FROM ev WHERE ts >= '2024-01-10' AND ts < '{SPLIT}' AND event_type IN ('error', 'click')")
def journal_units(spark, sf_dir):
    """Journal records of a window and of some units."""
    return events.units(_events(spark, sf_dir), _ts("2024-01-10"), _ts(SPLIT), ["error", "click"], unit="event_type").select("event_id", "event_type")


@register(f"WITH {EVENTS} SELECT event_id FROM ev WHERE date_trunc('minute', ts) >= TIMESTAMP '2024-01-10 00:00:00' AND date_trunc('minute', ts) < TIMESTAMP '2024-01-12 12:34:00' AND event_type = 'error'")
def error_report(spark, sf_dir):
    return records.error_report(_events(spark, sf_dir), _ts("2024-01-10 00:00:41"), _ts("2024-01-12 12:34:56"), event_type="error").select("event_id")


@register(f"WITH {EVENTS} SELECT event_id FROM ev WHERE ts >= '2024-01-10 00:00:00' AND ts < '2024-01-12 12:34:00'")
def event_window_minute(spark, sf_dir):
    return events.whole_minutes(_events(spark, sf_dir), _ts("2024-01-10 00:00:41"), _ts("2024-01-12 12:34:56")).select("event_id")


def _records(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "event_type", F.col("host").alias("source"), F.element_at(F.split("message", "[^0-9]+"), 2).alias("category"), "message", F.col("ts").alias("generated"), "ts")


RECORDS = "rec AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS source, regexp_extract(props, '[0-9]+') AS category, props AS message, ts FROM events)"


@register(f"WITH {RECORDS} SELECT event_id FROM rec WHERE lower(source) IN ('1', '2', '3') AND lower(event_type) IN ('error', 'view')")
def event_include(spark, sf_dir):
    return _records(spark, sf_dir).filter(events.include(source=["1", "2", "3"], event_type=["ERROR", "View"])).select("event_id")


@register(f"WITH {RECORDS} SELECT event_id FROM rec WHERE NOT (lower(source) IN ('1', '2') OR category IN ('7', '8') OR (event_id & 65535) IN (10, 11, 12) OR lower(event_type) = 'click')")
def event_exclude(spark, sf_dir):
    gone = events.exclude(source=["1", "2"], category=["7", "8"], event_id=[10, 11, 12], event_type=["Click"])
    return _records(spark, sf_dir).filter(~gone).select("event_id")


@register(f"""WITH {RECORDS} SELECT source AS host, epoch_us(ts) AS line_no, lpad(CAST(event_id & 65535 AS VARCHAR), CAST(greatest(4, length(CAST(event_id & 65535 AS VARCHAR))) AS INTEGER), '0') || ' ' || event_type || ': ' || message AS line
FROM rec WHERE ts >= '2024-01-10' AND ts < '{SPLIT}' AND lower(event_type) IN ('error', 'view') AND NOT category IN ('7', '8')""")
def event_lines(spark, sf_dir):
    """The events of a run, filtered and rendered as lines."""
    rows = _records(spark, sf_dir).withColumns({"tag": F.lit("events"), "host": F.col("source"), "logfile": F.lit("events")})
    out = events.event_lines(rows, _ts("2024-01-10"), _ts(SPLIT), events.include(event_type=["ERROR", "View"]), events.exclude(category=["7", "8"]), "%i %t: %m")
    return out.select("host", "line_no", "line")


@register("SELECT CAST(user_id AS VARCHAR) AS host, CASE WHEN event_type = 'error' THEN 'CRITICAL' END AS level, count(*) AS n FROM events GROUP BY ALL")
def event_severity(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("host", events.level_from_type(F.col("event_type")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {RECORDS} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || event_type || ' ' || category || ' ' || source || ' ' || lpad(CAST(event_id & 65535 AS VARCHAR), CAST(greatest(4, length(CAST(event_id & 65535 AS VARCHAR))) AS INTEGER), '0') || ' ' || substr(message, 1, 5) || '; undef' AS line FROM rec""")
def event_render(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("user", F.lit(""))
    return rows.select("event_id", events.render_event("%g %t %c %s %i %5m; %u").alias("line"))


@register("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'h' || user_id AS host, event_type AS process, CAST(event_id % 30000 AS INTEGER) AS pid, props AS message FROM events")
def syslog_parse(spark, sf_dir):
    """Events written as syslog lines, and parsed again."""
    line = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" h"), "host", F.lit(" "), "event_type", F.lit("["), (F.col("event_id") % 30000).cast("string"), F.lit("]: "), "message")
    rows = records.parse_syslog(_events(spark, sf_dir).select("event_id", line.alias("line")), 2024)
    return rows.select("event_id", _text("ts").alias("ts"), "host", "process", "pid", "message")


@register("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS generated, CAST(event_id % 7 AS INTEGER) AS event_type, event_type AS category, event_id, 'u' || user_id AS source, props || ', ' || CAST(event_id AS VARCHAR) AS message FROM events")
def event_csv(spark, sf_dir):
    """Events written as a comma dump, both date forms, and parsed again."""
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd.MM.yy,HH:mm:ss")).otherwise(F.date_format("ts", "M/d/yyyy,h:mm:ss a"))
    line = F.concat_ws(",", stamp, (F.col("event_id") % 7).cast("string"), "event_type", "event_id", F.concat(F.lit("u"), "host"), F.lit("N/A"), F.lit("HOST"), F.concat("message", F.lit(", "), "event_id"))
    rows = records.parse_event_csv(_events(spark, sf_dir).select(line.alias("line")))
    return rows.select(_text("generated").alias("generated"), "event_type", "category", "event_id", "source", "message")


@register("SELECT event_id AS id, user_id || ' ' || event_type AS message, CASE event_type WHEN 'error' THEN 'err' ELSE 'info' END AS event_type FROM events")
def kernel_lines(spark, sf_dir):
    """Events written as kernel ring lines, with continuation lines that are dropped."""
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "error", "err").otherwise("info")
    line = F.concat(F.lit("kern  :"), kind, F.lit("  : ["), F.lpad(F.format_string("%d.%06d", "event_id", F.lit(5)), 12, " "), F.lit("] "), "host", F.lit(" "), "event_type")
    rows = records.parse_kernel_lines(e.select(F.explode(F.array(line, F.lit("  continued"))).alias("line")), _ts("2024-01-01"))
    return rows.select((F.unix_timestamp("ts") - F.unix_timestamp(_ts("2024-01-01"))).alias("id"), "message", "event_type")


@register(f"""WITH rec AS (SELECT user_id AS record, '<' || props || '>' AS message, event_id, ts, event_type FROM events)
SELECT 'h' || record AS source, event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'warning' ELSE 'information' END AS event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS generated, record || ', ' || event_type AS message FROM rec WHERE event_type <> 'click'""")
def event_xml(spark, sf_dir):
    """Events written as rendered XML, clicks without a level, and parsed again."""
    e = _events(spark, sf_dir)
    level = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "error", "<Level>2</Level>").when(F.col("event_type") == "view", "<Level>3</Level>").otherwise("<Level>4</Level>")
    text = F.concat(F.lit("<Event><System><Provider Name='h"), "host", F.lit("'/><EventID Qualifiers='0'>"), F.col("event_id").cast("string"), F.lit("</EventID>"), level, F.lit("<TimeCreated SystemTime='"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z'/></System>\n<EventData><Data>"), "host", F.lit("</Data><Data>"), "event_type", F.lit("</Data></EventData>"))
    rows = records.parse_event_xml(e.select(text.alias("value")), "value")
    return rows.select("source", "event_id", "event_type", _text("generated").alias("generated"), "message")


@register(f"WITH {EVENTS} SELECT event_id, strftime(date_trunc('second', ts + INTERVAL 500 MILLISECOND), '%Y-%m-%d %H:%M:%S') AS ts FROM ev WHERE ts > '2024-01-10' AND ts < TIMESTAMP '{SPLIT}' - INTERVAL 1 SECOND")
def alert_table(spark, sf_dir):
    return records.read_alert_table(_events(spark, sf_dir), _ts("2024-01-10"), _ts(SPLIT)).select("event_id", _text("ts").alias("ts"))


@register(f"""WITH {EVENTS}, s AS (SELECT host, max(ts) AS last_ts FROM ev WHERE event_type = 'signup' GROUP BY host)
SELECT e.event_id FROM ev e LEFT JOIN s USING (host) WHERE s.last_ts IS NULL OR e.ts >= s.last_ts""")
def drop_late(spark, sf_dir):
    e = _events(spark, sf_dir)
    return events.drop_late(e, e.filter("event_type = 'signup'").groupBy("host").agg(F.max("ts").alias("last_ts")), "host").select("event_id")


@register(f"""WITH {EVENTS} SELECT level, strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM ev WHERE level IS NOT NULL GROUP BY ALL""")
def alert_rate(spark, sf_dir):
    return report.alert_rate(_alerts(spark, sf_dir), "10 minutes", key=("level",), when="ts").select("level", _text("window_start").alias("window_start"), "n")


@register(f"""WITH {EVENTS} SELECT level, strftime(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL (5 * s) MINUTE, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM ev, (VALUES (0), (1)) v(s) WHERE level IS NOT NULL GROUP BY ALL""")
def alert_rate_sliding(spark, sf_dir):
    return report.alert_rate(_alerts(spark, sf_dir), "10 minutes", "5 minutes", key=("level",), when="ts").select("level", _text("window_start").alias("window_start"), "n")


@register(f"""WITH {EVENTS}, keys AS (SELECT DISTINCT host FROM ev), grid AS (SELECT host, unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '{END}', INTERVAL 1 DAY)) AS w FROM keys),
beats AS (SELECT DISTINCT host, date_trunc('day', ts) AS w FROM ev WHERE event_type = 'view')
SELECT g.host, strftime(g.w, '%Y-%m-%d %H:%M:%S') AS window_start FROM grid g ANTI JOIN beats b ON g.host = b.host AND g.w = b.w""")
def heartbeat(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = stream.heartbeat(e, F.col("event_type") == "view", _ts("2024-01-01"), END, "1 day", "host")
    return out.select("host", _text("window_start").alias("window_start"))


@register(f"""WITH RECURSIVE {EVENTS}, num AS (SELECT host, event_id, line_no / 1e6 AS t, row_number() OVER (PARTITION BY host ORDER BY line_no) AS k FROM ev WHERE level IS NOT NULL),
run AS (
  SELECT host, event_id, k, CAST(0 AS BIGINT) AS wait, [t] AS history FROM num WHERE k = 1
  UNION ALL
  SELECT host, event_id, k, wait, CASE WHEN len(history) < 5 THEN list_append(history, t) WHEN wait = 0 THEN list_append(history[2:], t) ELSE history END
  FROM (SELECT n.*, r.history, CASE WHEN len(r.history) < 5 THEN 0 ELSE greatest(0, CAST(trunc(r.history[1] + 43200.0::DOUBLE - n.t) AS BIGINT)) END AS wait FROM run r JOIN num n ON n.host = r.host AND n.k = r.k + 1))
SELECT host, event_id, CAST(wait AS BIGINT) AS wait FROM run""")
def flood_check(spark, sf_dir):
    """Events over 5 in 12 hours of a host; each depends on all before it."""
    rows = callbacks.flood(_alerts(spark, sf_dir).select("host", "event_id", "ts"), 5, 43200, key=HOST, when="ts")
    return rows.select("host", "event_id", "wait")


def _shorten(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"level": ["OK" if x == "WARNING" else x for x in frame["level"]], "message": frame["message"].str.slice(0, 6)})


@register(f"""WITH {EVENTS} SELECT host, level, message, origin, count(*) AS n FROM (
  SELECT host, level, message, 'match' AS origin FROM ev WHERE level IS NOT NULL UNION ALL
  SELECT host, CASE level WHEN 'WARNING' THEN 'OK' ELSE level END, substr(message, 1, 6), 'callback' FROM ev WHERE level IS NOT NULL) GROUP BY ALL""")
def smart_callback(spark, sf_dir):
    rows = callbacks.on_match(_alerts(spark, sf_dir).select("host", "tag", "level", "message"), _shorten, "smart", ("host", "tag", "level", "message"))
    return rows.groupBy("host", "level", "message", "origin").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sources and state


@register(f"WITH {EVENTS} SELECT event_id FROM ev WHERE ts >= '{SPLIT}' AND event_id % 3 <> 0")
def new_by_id(spark, sf_dir):
    """Ids of the previous run, and every third one since, have been seen."""
    e = _events(spark, sf_dir)
    seen = e.filter((F.col("ts") < _ts(SPLIT)) | (F.col("event_id") % 3 == 0))
    return records.new_by_id(e, seen, "event_id", HOST).select("event_id")


@register("""WITH s AS (SELECT conv_id, CASE WHEN conv_id % 4 = 3 THEN 100000 ELSE conv_id % 4 END AS next_line FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id),
e AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn FROM conversations c JOIN e USING (conv_id) LEFT JOIN s USING (conv_id) WHERE c.turn >= CASE WHEN s.next_line <= e.last + 1 THEN s.next_line ELSE 0 END""")
def since_line(spark, sf_dir):
    lines = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"))
    state = lines.filter("conv_id % 5 <> 0").select("conv_id").distinct().withColumn("next_line", F.when(F.col("conv_id") % 4 == 3, 100000).otherwise(F.col("conv_id") % 4))
    return records.since_line(lines, state, ("conv_id",)).select("conv_id", F.col("line_no").alias("turn"))


def _hosts(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.lit("events").alias("tag"), F.col("c_custkey").cast("string").alias("host"), F.lit("events").alias("logfile"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS host, 'UNKNOWN' AS level, 'could not find logfile events' AS message FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def missing_sources(spark, sf_dir):
    return incremental.missing_sources(_hosts(spark, sf_dir), _events(spark, sf_dir)).select("host", "level", "message")


@register(f"WITH {EVENTS}, s AS (SELECT host, max(ts) AS t FROM ev GROUP BY host) SELECT host, 'logfile events is too old (> 86400 s)' AS message FROM s WHERE floor(epoch(t)) <= epoch(TIMESTAMP '{END}') - 86400")
def stale_sources(spark, sf_dir):
    state = _events(spark, sf_dir).groupBy("tag", "host", "logfile").agg(F.max("ts").alias("logtime"))
    return incremental.stale_sources(state, _ts(END), 86400).select("host", "message")


def _files(spark, sf_dir) -> DataFrame:
    """Each order as a file of its customer's log: the newest is the current one."""
    o = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    newest = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    rows = o.join(newest, "o_custkey")
    return rows.select(F.lit("t").alias("tag"), F.lit("h").alias("host"), F.col("o_custkey").cast("string").alias("logfile"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), F.floor("o_totalprice").cast("long").alias("length"), F.col("o_orderpriority").alias("fingerprint"), (F.col("o_orderkey") == F.col("last")).alias("current"))


def _state(spark, sf_dir) -> DataFrame:
    c = _table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0")
    time = F.timestamp_seconds(F.unix_timestamp(_ts("1996-01-01")) + F.col("c_custkey") * 3600)
    return c.select(F.lit("t").alias("tag"), F.lit("h").alias("host"), F.col("c_custkey").cast("string").alias("logfile"), (F.col("c_custkey") * 100).alias("logoffset"), time.alias("logtime"), F.when(F.col("c_custkey") % 2 == 0, "5-LOW").otherwise("1-URGENT").alias("fingerprint"), F.lit(3).cast("long").alias("runcount"), F.array(F.lit("old")).alias("sticky"))


FILES = """files AS (SELECT CAST(o_custkey AS VARCHAR) AS logfile, o_orderkey AS path, o_orderdate AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS length, o_orderpriority AS fingerprint,
  o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS current FROM orders),
state AS (SELECT CAST(c_custkey AS VARCHAR) AS logfile, c_custkey * 100 AS logoffset, TIMESTAMP '1996-01-01' + INTERVAL (c_custkey) HOUR AS logtime, CASE WHEN c_custkey % 2 = 0 THEN '5-LOW' ELSE '1-URGENT' END AS fingerprint, 3 AS runcount FROM customer WHERE c_custkey % 3 <> 0)"""


@register(f"""WITH {FILES} SELECT logfile, situation, CAST(CASE WHEN situation IN ('grown', 'same') THEN logoffset WHEN situation IN ('changed', 'empty', 'shrunk') THEN 0 ELSE -1 END AS BIGINT) AS start_at FROM (
  SELECT coalesce(f.logfile, s.logfile) AS logfile, s.logoffset, CASE WHEN f.logfile IS NULL THEN 'missing' WHEN s.logfile IS NULL THEN 'new' WHEN f.fingerprint <> s.fingerprint THEN 'changed'
  WHEN length = 0 THEN 'empty' WHEN length < logoffset THEN 'shrunk' WHEN length = logoffset THEN 'same' ELSE 'grown' END AS situation
  FROM (SELECT * FROM files WHERE current) f FULL JOIN state s ON f.logfile = s.logfile)""")
def situation(spark, sf_dir):
    return incremental.classify_source(_files(spark, sf_dir).filter("current"), _state(spark, sf_dir)).select("logfile", "situation", F.coalesce("start_at", F.lit(-1)).alias("start_at"))


@register(f"""WITH {FILES}, seen AS (SELECT f.* REPLACE (f.current AND o.o_orderstatus = 'O' AS current) FROM files f JOIN orders o ON o.o_orderkey = f.path), one AS (
  SELECT f.logfile, max(f.length) FILTER (WHERE f.current) AS length, max(f.fingerprint) FILTER (WHERE f.current) AS now, max(CASE WHEN f.fingerprint = s.fingerprint THEN 1 ELSE 0 END) AS found, max(s.logoffset) AS logoffset, max(s.fingerprint) AS before
  FROM seen f LEFT JOIN state s ON f.logfile = s.logfile GROUP BY f.logfile)
SELECT logfile, CASE WHEN length IS NULL THEN 'only_archives' WHEN logoffset IS NULL THEN 'new' WHEN now = before AND length > logoffset THEN 'grown' WHEN now = before AND length = logoffset THEN 'same' WHEN found = 1 THEN 'rotated' ELSE 'replaced' END AS situation FROM one
UNION ALL SELECT logfile, 'missing' FROM state WHERE logfile NOT IN (SELECT logfile FROM seen)""")
def situation_rotating(spark, sf_dir):
    """What has become of logs that rotate; where the newest order is not open, the log itself is gone."""
    open_ = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_orderstatus") == "O").alias("open"))
    files = _files(spark, sf_dir).join(open_, "path").withColumn("current", F.col("current") & F.col("open"))
    return incremental.situation_rotating(files, _state(spark, sf_dir)).select("logfile", "situation")


@register(f"""WITH {FILES} SELECT f.logfile, f.path, CAST(row_number() OVER (PARTITION BY f.logfile ORDER BY f.current, f.mtime, f.path) - 1 AS INTEGER) AS file_seq
FROM files f LEFT JOIN state s USING (logfile) WHERE f.current OR s.logtime IS NULL OR f.mtime >= s.logtime""")
def relevant_files(spark, sf_dir):
    return incremental.relevant_files(_files(spark, sf_dir), _state(spark, sf_dir)).select("logfile", "path", "file_seq")


@register(f"""WITH {FILES}, g AS (SELECT logfile, path, fingerprint, length // 100000 AS length, mtime FROM files)
SELECT logfile, path FROM (SELECT *, row_number() OVER (PARTITION BY logfile, fingerprint, length ORDER BY mtime DESC, path DESC) AS n FROM g) WHERE n = 1""")
def dedupe_files(spark, sf_dir):
    rows = _files(spark, sf_dir).withColumn("length", F.floor(F.col("length") / 100000).cast("long"))
    return incremental.dedupe_files(rows).select("logfile", "path")


@register(f"""WITH {FILES}, a AS (SELECT f.*, row_number() OVER (PARTITION BY f.logfile ORDER BY f.current, f.mtime, f.path) - 1 AS file_seq FROM files f),
l AS (SELECT logfile, path, file_seq, length, i, i * 1000 AS start_offset FROM (SELECT *, unnest(range(0, (length + 999) // 1000)) AS i FROM a)),
b AS (SELECT logfile, max(least((i + 1) * 1000, length)) AS size FROM l WHERE file_seq = 0 GROUP BY logfile)
SELECT l.logfile, l.path, count(*) AS lines FROM l LEFT JOIN state s USING (logfile) LEFT JOIN b USING (logfile)
WHERE l.file_seq > 0 OR l.start_offset >= CASE WHEN s.logoffset <= b.size THEN s.logoffset ELSE 0 END GROUP BY ALL""")
def apply_offset(spark, sf_dir):
    """Files of lines of 1,000 bytes, the last one shorter."""
    files = incremental.relevant_files(_files(spark, sf_dir), _state(spark, sf_dir).limit(0))
    lines = files.withColumn("i", F.explode(F.sequence(F.lit(1), F.ceil(F.col("length") / 1000).cast("int"), F.lit(1)))).withColumn("i", F.col("i") - 1)
    lines = lines.withColumns({"start_offset": F.col("i").cast("long") * 1000, "end_offset": F.least((F.col("i").cast("long") + 1) * 1000, "length")})
    return incremental.apply_offset(lines, _state(spark, sf_dir)).groupBy("logfile", "path").agg(F.count(F.lit(1)).alias("lines"))


@register(f"WITH {FILES} SELECT f.logfile, coalesce(s.logoffset, f.length) AS start_at FROM files f LEFT JOIN state s USING (logfile) WHERE f.current")
def first_run_offset(spark, sf_dir):
    return incremental.first_start(_files(spark, sf_dir).filter("current"), _state(spark, sf_dir)).select("logfile", "start_at")


@register(f"""WITH {FILES}, seen AS (SELECT *, path % 2 = 0 AS cur FROM files WHERE current)
SELECT coalesce(s.logfile, r.logfile) AS logfile, CAST(CASE WHEN r.logfile IS NULL THEN s.logoffset WHEN NOT r.cur THEN 0 ELSE r.length END AS BIGINT) AS logoffset,
  strftime(CASE WHEN r.logfile IS NULL THEN s.logtime WHEN NOT r.cur THEN TIMESTAMP '{SPLIT}' ELSE r.mtime END, '%Y-%m-%d %H:%M:%S') AS logtime,
  CASE WHEN r.logfile IS NULL THEN s.fingerprint ELSE r.fingerprint END AS fingerprint, CAST(coalesce(s.runcount, 0) + 1 AS BIGINT) AS runcount FROM state s FULL JOIN seen r ON s.logfile = r.logfile""")
def advance_state(spark, sf_dir):
    read = incremental.relevant_files(_files(spark, sf_dir), _state(spark, sf_dir).limit(0)).withColumns({"current": F.col("path") % 2 == 0, "end_offset": F.col("length")})
    out = incremental.advance_state(_state(spark, sf_dir), read, _ts(SPLIT))
    return out.select("logfile", "logoffset", _text("logtime").alias("logtime"), "fingerprint", "runcount")


@register(f"WITH {FILES} SELECT logfile, CASE WHEN CAST(logfile AS BIGINT) % 7 = 1 THEN 0 ELSE logoffset END AS logoffset, CAST(CASE WHEN CAST(logfile AS BIGINT) % 7 = 2 THEN 0 ELSE 1 END AS INTEGER) AS stuck FROM state")
def rewind_state(spark, sf_dir):
    state = _state(spark, sf_dir).withColumn("tag", F.concat(F.lit("t"), (F.col("logfile").cast("long") % 7).cast("string")))
    out = incremental.unstick(incremental.rewind(state, ["t1"]), ["t2"])
    return out.select("logfile", "logoffset", F.size("sticky").alias("stuck"))


FORMATS = formats.parse_formats("""
FORMAT Base
%s* license%s*
origin LABEL
severity MINOR
END

FORMAT Licensed FOLLOWS Base
%s* under the %s License, Version %s.%s*
-name $2
-version $3
severity CRITICAL
msg PRINTF("%s in version %s", name, version)
END

FORMAT *DISCARD*
%s*&&&%s*
END
""")


@register(f"""WITH {LINES} SELECT logfile, file_seq, line_no, CASE WHEN regexp_matches(line, '(.*?)\\s+under\\s+the\\s+([^\\s]+)\\s+License,\\s+Version\\s+([^\\s]+).(.*)') THEN 'Licensed' ELSE 'Base' END AS format_name,
  CAST(CASE WHEN regexp_matches(line, '(.*?)\\s+under\\s+the\\s+([^\\s]+)\\s+License,\\s+Version\\s+([^\\s]+).(.*)') THEN 2 ELSE 1 END AS INTEGER) AS exit_code,
  CASE WHEN regexp_matches(line, '(.*?)\\s+under\\s+the\\s+([^\\s]+)\\s+License,\\s+Version\\s+([^\\s]+).(.*)')
  THEN regexp_extract(line, '(.*?)\\s+under\\s+the\\s+([^\\s]+)\\s+License,\\s+Version\\s+([^\\s]+).(.*)', 2) || ' in version ' || regexp_extract(line, '(.*?)\\s+under\\s+the\\s+([^\\s]+)\\s+License,\\s+Version\\s+([^\\s]+).(.*)', 3)
  ELSE line END AS subject FROM lines
WHERE NOT regexp_matches(line, '&&&') AND regexp_matches(line, '(.*?)\\s+license|under\\s+the\\s+[^\\s]+\\s+License,\\s+Version\\s+[^\\s]+.')
  AND (regexp_matches(line, '(.*?)\\s+license') OR regexp_matches(line, '(.*?)\\s+under\\s+the\\s+([^\\s]+)\\s+License,\\s+Version\\s+([^\\s]+).(.*)'))""")
def format_match(spark, sf_dir):
    out = formats.match_formats(_lines(spark, sf_dir), FORMATS, defaults={"LABEL": "label"})
    return out.select("logfile", "file_seq", "line_no", "hit.format_name", "hit.exit_code", "hit.subject")


PAIR = formats.parse_formats("""
FORMAT Pair
%s* the %s*%n%s* and %s*
severity WARNING
msg $4
END
""")


@register("""WITH t AS (SELECT conv_id, turn, text AS line, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_extract(line, '(.*?)\\s+and\\s+(.*)', 2) = '' THEN line ELSE regexp_extract(line, '(.*?)\\s+and\\s+(.*)', 2) END AS subject
FROM t WHERE regexp_matches(before, '(.*?)\\s+the\\s+(.*)') AND regexp_matches(line, '(.*?)\\s+and\\s+(.*)')""")
def format_multiline(spark, sf_dir):
    lines = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    out = formats.match_formats(lines, PAIR, order=("turn",), key=("conv_id",))
    return out.select("conv_id", "turn", "hit.subject")


RUN = [
    Search(tag="docs", critical=["[0-9]{4}", "@", "!no such text"], warning=["%%%"], exceptions={"critical": ["[0-9]{16}"]}, skip=["###"], ok=["Apache License"], threshold={"warning": 3}),
]


@register(f"""WITH {LINES}, ok AS (SELECT logfile, max((file_seq, line_no)) AS at FROM lines WHERE NOT regexp_matches(line, '###') AND regexp_matches(line, 'Apache License') GROUP BY logfile),
m AS (SELECT l.*, r.level, r.pat_idx FROM lines l JOIN (VALUES ('CRITICAL', 0, '[0-9]{{4}}'), ('CRITICAL', 1, '@'), ('WARNING', 0, '%%%')) r(level, pat_idx, re) ON regexp_matches(l.line, r.re)
  LEFT JOIN ok USING (logfile) WHERE NOT regexp_matches(l.line, '###') AND NOT (r.level = 'CRITICAL' AND regexp_matches(l.line, '[0-9]{{16}}')) AND (ok.at IS NULL OR (l.file_seq, l.line_no) > ok.at)),
k AS (SELECT *, row_number() OVER (PARTITION BY logfile, level ORDER BY file_seq, line_no, pat_idx) AS k FROM m),
a AS (SELECT logfile, level, pat_idx FROM k WHERE level = 'CRITICAL' OR k % 3 = 0 UNION ALL SELECT DISTINCT logfile, 'CRITICAL', 2 FROM lines)
SELECT logfile, level, pat_idx, count(*) AS n FROM a GROUP BY ALL""")
def scan_run(spark, sf_dir):
    """A whole run: prefilter, exceptions, patterns, all-clear, threshold and must-appear patterns."""
    sources = _table(spark, sf_dir, "documents").filter("text is not null").select(F.lit("docs").alias("tag"), F.lit("all").alias("host"), F.col("source").alias("logfile"))
    matches, _ = scan.scan_lines(_lines(spark, sf_dir), RUN, keys=sources)
    return matches.groupBy("logfile", "level", "pat_idx").agg(F.count(F.lit(1)).alias("n"))


#: Formats of one and of two lines as one list: the last that matches wins, and one discards. Lines that are skipped are not looked back at.
MIXED = Search(
    tag="docs",
    skip=["%%%"],
    formats="""
FORMAT Alone
%s* the %s*
severity WARNING
END
FORMAT Pair
%s* the %s*%n%s* and %s*
severity CRITICAL
msg $4
END
FORMAT *DISCARD*
%s*@%s*
END
""",
)


@register(f"""WITH {LINES}, seen AS (SELECT *, lag(line) OVER (PARTITION BY logfile ORDER BY file_seq, line_no) AS before FROM lines WHERE NOT regexp_matches(line, '%%%')),
hits AS (SELECT *, CASE WHEN regexp_matches(line, '@') THEN NULL WHEN regexp_matches(before, '(.*?)\\s+the\\s+(.*)') AND regexp_matches(line, '(.*?)\\s+and\\s+(.*)') THEN 'CRITICAL'
  WHEN regexp_matches(line, '(.*?)\\s+the\\s+(.*)') THEN 'WARNING' END AS level FROM seen)
SELECT logfile, file_seq, line_no, level, CASE WHEN level = 'CRITICAL' AND regexp_extract(line, '(.*?)\\s+and\\s+(.*)', 2) <> '' THEN regexp_extract(line, '(.*?)\\s+and\\s+(.*)', 2) ELSE line END AS message
FROM hits WHERE level IS NOT NULL""")
def formats_mixed(spark, sf_dir):
    matches, _ = scan.scan_lines(_lines(spark, sf_dir), [MIXED])
    return matches.select("logfile", "file_seq", "line_no", "level", "message")


ROTATED = [Search(tag="docs", logfile="part", rotation="part-.*", newest=True, read_all_first=True, critical=["[0-9]{4}", "@"], warning=["%%%"], exceptions={"critical": ["[0-9]{16}"]}, need=["e"])]


@register("""WITH lines AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS run, coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS host, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), m AS (
  SELECT l.*, r.level FROM lines l JOIN (VALUES ('CRITICAL', '[0-9]{4}'), ('CRITICAL', '@'), ('WARNING', '%%%')) r(level, re) ON regexp_matches(l.line, r.re)
  WHERE contains(l.line, 'e') AND NOT (r.level = 'CRITICAL' AND regexp_matches(l.line, '[0-9]{16}'))
) SELECT CAST(run AS INTEGER) AS run, host, level, count(*) AS n FROM m GROUP BY ALL""")
def run_over_files(spark, sf_dir):
    """Two runs over log files in a folder for each source: the second finds what has come since the first, and that alone."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    docs, out = _table(spark, sf_dir, "documents").filter("text is not null"), None
    for run, rest in ((1, 0), (2, 1)):
        docs.filter(F.pmod("doc_id", F.lit(2)) == rest).select("source", "text").write.mode("append").partitionBy("source").text(f"{folder}/logs")
        found = scan.run(spark, ROTATED, [f"{folder}/logs"], f"{folder}/state", datetime(2024, 1, run), layout=f"{folder}/logs/source={{host}}/").matches
        found = found.groupBy("host", "level").agg(F.count(F.lit(1)).alias("n")).select(F.lit(run).alias("run"), "host", "level", "n")
        out = found if out is None else out.unionByName(found)
    return out


RECORDS = [Search(tag="shop", feed="events", critical=["^error"], warning=["^purchase"], threshold={"warning": 3}, read_all_first=True)]
RUNS = ("2024-01-10 00:00:00", SPLIT, END)


@register(f"""WITH {EVENTS}, r AS (SELECT *, CASE WHEN ts < TIMESTAMP '{RUNS[0]}' THEN 1 WHEN ts < TIMESTAMP '{RUNS[1]}' THEN 2 WHEN ts < TIMESTAMP '{RUNS[2]}' THEN 3 END AS run,
  row_number() OVER (PARTITION BY host, level ORDER BY ts, event_id) AS k FROM ev WHERE level IS NOT NULL)
SELECT run, coalesce(host, 'localhost') AS host, level, count(*) AS n FROM r WHERE run IS NOT NULL AND (level = 'CRITICAL' OR k % 3 = 0) GROUP BY ALL""")
def run_over_records(spark, sf_dir):
    """Three runs over events as records: each takes those since the last, and counts every third purchase of a host on from run to run."""
    rows = _table(spark, sf_dir, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "host": F.col("user_id").cast("string")})
    feed = feeds.Feed(rows, "time", "ts", F.concat_ws(" ", "event_type", F.col("value").cast("string")), "host")
    folder, out = f"{shared_dir(spark)}/{uuid.uuid4().hex}", None
    for n, at in enumerate(RUNS, 1):
        when = spark.range(1).select(_ts(at)).first()[0]
        found = scan.run(spark, RECORDS, [], f"{folder}/state", when, feeds={"events": feed}).matches
        found = found.groupBy("host", "level").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("run"), "host", "level", "n")
        out = found if out is None else out.unionByName(found)
    return out
