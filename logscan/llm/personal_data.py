"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base spans are the leftmost non-overlapping matches of a fixed pattern per kind, checked by
digit sums and ranges. What stands beside them makes lexical patterns: the word or the two
words on the left, the word or the two words on the right, and the words on both sides. In a
graph of patterns and instances (identifier-like mentions in the same contexts) scores go
back and forth:

- the confidence of a pattern for a kind is the sum of the scores of the instances it stands
  with over their number, if enough distinct seeds of the kind stand there too; seeds have 1,
  and the number is raised by that of the seeds asked for, so that a few chance meetings make
  no sure pattern;
- the score of an instance is the noisy-or of the surest pattern on its left and the surest
  one on its right, or the confidence of the surest on both sides, if that is larger.

After a few rounds the instances above a score, in a shape that the kind allows, are new
spans in those contexts. Everything is joins and map-side sums on (pattern, instance)
counts; a frequent context word is a single row after the first sum.

DataFrame functions only. The texts are scanned once for matches and mentions; what is
shuffled are those, not texts. Patterns are written without nested backtracking, so a long
run of digits or letters takes linear time and no deep stack.

A null text counts as empty. Rows are told apart by doc_id and text; rows that repeat both get the
same result each, and rows without doc_id get results with a null doc_id. An empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscan.llm.common import is_small, written

# The kinds in order, and their patterns. Possessive quantifiers and the looks
# behind change no match; they only keep the search linear.
LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
TOKEN = rf"(?<!{WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{WORD}*+"
# A run of number-like tokens joined by single spaces, up to punctuation (a plus sign begins a new one), or any token.
DONE = rf"(?=[,;:!?'\"]*+(?!{WORD}))"
RUN = rf"(?<!{WORD})[()\[\].+-]*+[0-9][0-9()\[\].-]*+{DONE}(?:\x20[0-9()\[\].-]++{DONE})*+[,;:!?'\"]*+"
MENTIONS = {"mention": f"(?:{RUN}|{TOKEN})", "token": TOKEN}
# Up to two words at the end and at the beginning of what stands between matches, in time linear in its length.
LAST = rf"(?<!{WORD})((?:{WORD}++{SPACE}++)?{WORD}++){SPACE}*+\z"
FIRST = rf"\A{SPACE}*+({WORD}++(?:{SPACE}++{WORD}++)?+)"
ORDER = {kind: i for i, kind in enumerate([*KINDS, *MENTIONS])}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds."""
    back = F.reverse(digits)
    doubled = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.substr(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: Column, x: Column) -> Column:
    n = F.length(_digits(x))
    low = F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    return (
        F.when(kind == ORDER["ip"], low)
        .when(kind == ORDER["card"], n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(x))))
        .when(kind == ORDER["phone"], n.between(8, 15))
        .otherwise(True)
    )


def _trimmed(x: Column) -> Column:
    """x without punctuation at its end; a closing bracket stays if one is opened."""
    opened = F.contains(x, F.lit("(")) | F.contains(x, F.lit("["))
    return F.when(opened, F.rtrim(x, F.lit(".,;:!?'\" -"))).otherwise(F.rtrim(x, F.lit(".,;:!?'\" -)]}>")))


def _found(text: Column, kind: str, rx: str, needs: Column) -> Column:
    """The matches of rx with their number, the length of the text before each, its last words and its first ones."""
    parts, matches = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    before = F.transform(F.arrays_zip(parts.alias("p"), matches.alias("m")), lambda z: F.struct(z["m"].alias("value"), F.length(z["p"]).alias("gap"), F.regexp_extract(z["p"], LAST, 1).alias("last"), F.regexp_extract(z["p"], FIRST, 1).alias("first")))
    return F.when(needs, F.transform(before, lambda z, i: F.struct(F.lit(ORDER[kind]).alias("kind"), i.alias("i"), z["value"].alias("value"), z["gap"].alias("gap"), z["last"].alias("last"), z["first"].alias("first"))))


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, tag, kind, start, end (code points), value, left and right (up to two words beside it): base spans of valid form, and mentions.

    Mentions are tokens with a digit or an @, and number-like tokens joined by single spaces as
    one. A token that has the form of a kind by itself is a mention as well as the run it is in.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64("text").alias("tag"), "text", F.contains("text", F.lit("@")).alias("at"), F.col("text").rlike("[0-9]").alias("digit")).filter("at or digit")
    at, digit = F.col("at"), F.col("digit")
    needs = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains("text", F.lit("+")), "mention": at | digit, "token": F.col("text").rlike(r"[0-9()\[\].-]\x20[0-9()\[\].-]")}
    none = F.array().cast("array<struct<kind:int,i:int,value:string,gap:int,last:string,first:string>>")
    all_ = [F.coalesce(_found(F.col("text"), k, rx, needs[k]), none) for k, rx in {**KINDS, **MENTIONS}.items()]
    # the outer form, as the inner one would first test the array's size and so make it twice
    one = rows.select("doc_id", "tag", F.explode_outer(F.concat(*all_)).alias("x")).filter("x is not null").select("doc_id", "tag", "x.*")
    one = one.repartition("doc_id", "tag", "kind").dropDuplicates(["doc_id", "tag", "kind", "i"])
    order = Window.partitionBy("doc_id", "tag", "kind").orderBy("i")
    length = F.coalesce(F.length("value"), F.lit(0))
    placed = one.withColumn("end", F.sum(F.col("gap") + length).over(order).cast("int")).withColumn("right", F.lead("first").over(order))
    placed = placed.filter("value is not null").select("doc_id", "tag", "kind", (F.col("end") - length).alias("start"), "end", "value", F.lower("last").alias("left"), F.lower("right").alias("right"))
    mention, token = F.col("kind") >= ORDER["mention"], F.col("kind") == ORDER["token"]
    placed = placed.withColumn("value", F.when(mention, _trimmed(F.col("value"))).otherwise(F.col("value")))
    placed = placed.withColumn("end", F.when(mention, F.col("start") + F.length("value")).otherwise(F.col("end")))
    alone = reduce(or_, (_shape(F.lit(ORDER[k]), F.col("value")) for k in ("ip", "card", "phone")))
    placed = placed.filter(_valid(F.col("kind"), F.col("value")) & (~token | alone))
    return placed.withColumn("kind", F.when(token, ORDER["mention"]).otherwise(F.col("kind"))).distinct()


def _apart(found: DataFrame) -> DataFrame:
    """Mentions that overlap no base span."""
    mention = F.col("kind") == ORDER["mention"]
    place = Window.partitionBy("doc_id", "tag")
    # both frames begin at the first row, so that a document's mentions cost linear time
    before = F.max(F.when(~mention, F.col("end"))).over(place.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(~mention, F.col("start"))).over(place.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    kept = found.withColumn("before", before).withColumn("after", after).filter(mention)
    return kept.filter((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))).drop("before", "after")


def _edges(rows: DataFrame) -> DataFrame:
    """(pattern, instance, kind): once each."""
    words = {side: F.filter(F.split(F.coalesce(side, F.lit("")), f"{SPACE}+"), lambda w: w != "") for side in ("left", "right")}
    left, right = words["left"], words["right"]
    near = {"left": F.get(left, F.size(left) - 1), "right": F.get(right, F.lit(0))}
    forms = [F.concat(F.lit(f"{side} "), near[side]) for side in near]
    forms += [F.when(F.size(words[side]) > 1, F.concat(F.lit(f"{side} "), F.array_join(words[side], " "))) for side in near]
    forms.append(F.concat(F.lit("both "), near["left"], F.lit(" "), near["right"]))
    return rows.select(F.explode(F.array_compact(F.array(*forms))).alias("pattern"), F.lower("value").alias("instance"), "kind").distinct()


def _shape(kind: Column, x: Column) -> Column:
    """Whether a value can be of the kind at all."""
    digits = F.length(_digits(x))
    return (
        F.when(kind == ORDER["email"], F.contains(x, F.lit("@")))
        .when(kind == ORDER["ip"], (digits >= 4) & x.rlike(r"^[\[(]?[0-9A-Fa-f]*([.:][0-9A-Fa-f]*){3,7}[\])]?[.,;]?$"))
        .when(kind == ORDER["card"], digits.between(12, 19) & ~x.rlike("[A-Za-z]"))
        .otherwise(digits.between(7, 15) & ~x.rlike("[A-Za-z]"))
    )


def scored(edges: DataFrame, rounds: int = 3, seeds: int = 5) -> tuple[DataFrame, DataFrame]:
    """The patterns (pattern, k, confidence) and the instances (instance, k, score) of a graph of edges (pattern, instance, kind) after some rounds."""
    mention = F.col("kind") == ORDER["mention"]
    kinds = F.explode(F.array(*[F.lit(i) for k, i in ORDER.items() if k in KINDS])).alias("k")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    support = edges.filter(~mention).groupBy("pattern", F.col("kind").alias("k")).agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= seeds)
    patterns = written(support.join(size, "pattern"))
    # patterns with seeds enough are few, so edges, of which a frequent word may have a third, stay where they are; too many are
    # joined by a shuffle, whose skewed parts Spark splits. Confidences have the rows of patterns
    to_edges = F.broadcast if is_small(patterns) else lambda df: df
    open_ = written(edges.filter(mention).select("pattern", "instance").join(to_edges(patterns.select("pattern").distinct()), "pattern").select("pattern", "instance", kinds))
    scores = open_.select("instance", "k").distinct().withColumn("score", F.lit(0.0))
    side, surest = F.substring_index("pattern", " ", 1), lambda name: F.coalesce(F.max(F.when(side == name, F.col("confidence"))), F.lit(0.0))
    confidence = patterns.select("pattern", "k", (F.col("seeds") / (F.col("n") + seeds)).alias("confidence"))
    for _ in range(rounds):
        gained = open_.join(scores, ["instance", "k"]).groupBy("pattern", "k").agg(F.sum("score").alias("gained"))
        confidence = patterns.join(gained, ["pattern", "k"], "left").select("pattern", "k", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("n") + seeds)).alias("confidence"))
        best = open_.join(to_edges(confidence), ["pattern", "k"]).groupBy("instance", "k").agg(*[surest(x).alias(x) for x in ("left", "right", "both")])
        scores = written(best.select("instance", "k", F.greatest("both", 1 - (1 - F.col("left")) * (1 - F.col("right"))).alias("score")).filter(F.col("score") > 0.01))
    return confidence, scores


def bootstrap(found: DataFrame, rounds: int = 3, seeds: int = 5, sure: float = 0.8) -> DataFrame:
    """The mentions (as rows of matches, with the kind they are found to be) whose score reaches sure; a pattern needs so many distinct seeds."""
    mention = F.col("kind") == ORDER["mention"]
    apart = written(_apart(found))
    edges = written(_edges(found.filter(~mention)).union(_edges(apart)))
    scores = scored(edges, rounds, seeds)[1]
    best = Window.partitionBy("instance").orderBy(F.desc("score"), "k")
    named = scores.filter(F.col("score") >= sure).filter(_shape(F.col("k"), F.col("instance"))).withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    sure_ones = apart.withColumn("instance", F.lower("value")).join(named.select("instance", "k"), "instance").select("doc_id", "tag", F.col("k").alias("kind"), "start", "end", "value", "left", "right")
    outer = F.max("end").over(Window.partitionBy("doc_id", "tag").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    return sure_ones.withColumn("outer", outer).filter(F.coalesce("outer", F.lit(-1)) < F.col("end")).drop("outer")  # of a run and a token in it the run


def find(docs: DataFrame, rounds: int = 3, seeds: int = 5, sure: float = 0.8) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) by kind and start, for every row; kind is the place in KINDS, base marks those of the fixed patterns."""
    found = written(matches(docs))
    base = found.filter(F.col("kind") != ORDER["mention"]).select("doc_id", "tag", "kind", "start", "end", F.lit(True).alias("base"))
    more = bootstrap(found, rounds, seeds, sure).select("doc_id", "tag", "kind", "start", "end", F.lit(False).alias("base"))
    spans = base.union(more).groupBy(F.col("doc_id").alias("d"), F.col("tag").alias("t")).agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tag"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean>>")
    return joined.select("doc_id", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
