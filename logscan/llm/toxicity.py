"""Toxicity by a weighted finite-state grammar over clauses.

Words carry classes: insult stems with a weight, threats, targets, negations and words of
reported speech. Five transducers, each a table of states and weights, are composed into
one machine (`compose`):

- target: takes it that the clause holds a target or that it holds none, and marks every
  word so; only the assumption that has come true at the end of the clause is accepted;
- negation: marks the few words after a negation;
- report: marks the words after a word of reported speech, up to the end of the clause;
- insult: emits the weight of a stem in the mode (plain, negated, reported) it is marked
  with, more of it in a clause with a target;
- threat: emits a weight in a clause with a target, nothing otherwise.

The composed machine reads a clause from stop to stop; its one accepted path gives the
weights of the clause in each mode. A document's score is a logistic function of the sums,
whose coefficients are fitted as well.

Insult stems are learned from a bounded sample of the labelled rows (about `toxic_rows` and
`clean_rows`, by hash of the id, near copies counted once): beginnings of 3 to 8 letters and
whole words whose presence goes with the label beyond chance for the number of stems tried.
How many are learned, and in how many rounds, is up to that test alone. The classes of the
context start from fixed words and are extended by the same test: words before a stem whose
texts are toxic less often than those of the stem join the reports, words beside a stem whose
texts are toxic more often join the targets. Stems are found in whole texts with one automaton;
only clauses that hold one are parsed. Scoring shuffles nothing.

A null or empty text scores as one without any match. Null labels teach nothing, a null id
counts as the empty id, and repeated labels count as they come, up to the bound. Without
usable labels the fixed words alone are used, with fixed coefficients. An empty table gives
no rows. Other columns pass through; score takes the place of a column of that name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import broadcast_if_small, with_columns_from, written
from logscan.llm.tokens import U64, Words, chunks, grams

# The word classes that learning starts from.
THREATS = "kill killed hurt destroy beat burn shoot stab töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours yourself they them he she him her people du dich dir ihr sie euch tu te vous toi usted ustedes tú".split()
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says told called calls quoted wrote claimed reported sagte schrieb dit écrit dijo escribió".split()

ARMED = 3
#: Lengths of the beginnings of words that are tried as stems, besides whole words.
PREFIX = range(3, 9)
#: Seeds of the hashes that tell near copies in the sample.
SKETCHES = (1, 2, 3)
MODES = ("plain", "negated", "reported")
CLASSES = ("other", "insult", "threat", "target", "negation", "report")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
STOPS = ".!?;:\n"
_STOP = re.compile(f"[{STOPS}]")
START = (-3.0, 1.2, 0.4, 0.6)


@dataclass(frozen=True)
class Transducer:
    """States, symbols and weights: arcs maps (state, symbol) to (next state, symbol out, what the arc emits).

    A symbol is (class, whether a target is assumed, mode); what is emitted is None, or (mode,
    factor of the word's weight).
    """

    starts: tuple
    final: frozenset
    arcs: dict


def _symbols() -> list[tuple]:
    return list(product(CLASSES, (None, False, True), MODES))


def target() -> Transducer:
    """Starts with either assumption; `wanted` has yet to see the target that it assumes."""
    arcs = {}
    for kind, _, mode in _symbols():
        symbol = (kind, None, mode)
        if kind != "target":
            arcs["none", symbol] = ("none", (kind, False, mode), None)
        arcs["wanted", symbol] = ("found" if kind == "target" else "wanted", (kind, True, mode), None)
        arcs["found", symbol] = ("found", (kind, True, mode), None)
    return Transducer(("none", "wanted"), frozenset(("none", "found")), arcs)


def negation(armed: int = ARMED) -> Transducer:
    """The state counts the words that are still negated."""
    arcs = {}
    for left, (kind, aimed, mode) in product(range(armed + 1), _symbols()):
        after = armed if kind == "negation" else max(0, left - 1)
        arcs[left, (kind, aimed, mode)] = (after, (kind, aimed, "negated" if left else mode), None)
    return Transducer((0,), frozenset(range(armed + 1)), arcs)


def report() -> Transducer:
    arcs = {}
    for inside, (kind, aimed, mode) in product((False, True), _symbols()):
        arcs[inside, (kind, aimed, mode)] = (inside or kind == "report", (kind, aimed, "reported" if inside else mode), None)
    return Transducer((False,), frozenset((False, True)), arcs)


def emitter(kind: str, aimed: float, otherwise: float) -> Transducer:
    """Emits the weight of words of a class, times a factor for clauses with a target and one for others."""
    arcs = {}
    for symbol in _symbols():
        factor = aimed if symbol[1] else otherwise
        arcs[0, symbol] = (0, symbol, (symbol[2], factor) if symbol[0] == kind and factor else None)
    return Transducer((0,), frozenset((0,)), arcs)


def transducers() -> list[Transducer]:
    return [target(), negation(), report(), emitter("insult", 1.25, 1.0), emitter("threat", 1.25, 0.0)]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that gives second what first gives out; only pairs of states that can be reached are made."""
    starts = tuple(product(first.starts, second.starts))
    arcs, todo, known = {}, list(starts), set(starts)
    by_state: dict = {}
    for (state, symbol), arc in first.arcs.items():
        by_state.setdefault(state, []).append((symbol, arc))
    while todo:
        p, q = todo.pop()
        for symbol, (after, out, emits) in by_state.get(p, ()):
            if (q, out) in second.arcs:
                then, last, more = second.arcs[q, out]
                arcs[(p, q), symbol] = ((after, then), last, emits or more)  # one machine at most emits for a word
                if (after, then) not in known:
                    known.add((after, then))
                    todo.append((after, then))
    return Transducer(starts, frozenset(s for s in known if s[0] in first.final and s[1] in second.final), arcs)


def _table(machine: Transducer) -> tuple[list[int], list[bool], list[list[tuple | None]]]:
    """The machine as numbers: its starts, which states are final, and for each state and class the next state, the mode and the factor."""
    number: dict = {}
    for s in [*machine.starts, *(s for s, _ in machine.arcs)]:
        number.setdefault(s, len(number))
    table: list[list[tuple | None]] = [[None] * len(CLASSES) for _ in number]
    for (state, (kind, aimed, mode)), (after, _, emits) in machine.arcs.items():
        if aimed is None and mode == "plain":  # what words come in as
            at, factor = (MODES.index(emits[0]), emits[1]) if emits else (0, 0.0)
            table[number[state]][CLASSES.index(kind)] = (number[after], at, factor)
    return [number[s] for s in machine.starts], [s in machine.final for s in number], table


MACHINE = _table(reduce(compose, transducers()))


class Grammar:
    def __init__(self, stems: dict[str, float], coefficients: tuple[float, ...] = START, reports: Iterable[str] = (), targets: Iterable[str] = ()):
        self.stems, self.coefficients = stems, coefficients
        self.longest = max(map(len, stems), default=0)
        self.classes = dict.fromkeys(targets, "target") | dict.fromkeys(reports, "report")
        self.classes |= {w: k for k, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for s in {**dict.fromkeys(THREATS, 1.0), **self.stems}:
                self._automaton.add_word(s, len(s))
            self._automaton.make_automaton()
        return self._automaton

    def insult(self, word: str) -> float:
        """The weight of the heaviest stem that the word begins with."""
        return max((self.stems.get(word[:k], 0.0) for k in range(1, min(len(word), self.longest) + 1)), default=0.0)

    def stem(self, word: str) -> str:
        """The stem of that weight."""
        return max((word[:k] for k in range(1, min(len(word), self.longest) + 1) if word[:k] in self.stems), key=self.stems.__getitem__)

    def tokens(self, words: Iterable[str]) -> list[tuple[str, float]]:
        """The class and weight of each word."""
        out = []
        for w in words:
            kind, weight = self.classes.get(w, "other"), self.insult(w)
            out.append(("insult", weight) if weight and kind == "other" else (kind, 1.0))
        return out

    def clause(self, tokens: list[tuple[str, float]]) -> list[float]:
        """What the composed machine emits for a clause, by mode, on the path that it accepts."""
        starts, final, table = MACHINE
        kinds = [(CLASSES.index(kind), weight) for kind, weight in tokens]
        for state in starts:
            out = [0.0] * len(MODES)
            for kind, weight in kinds:
                arc = table[state][kind]
                if arc is None:
                    break
                state, mode, factor = arc
                out[mode] += factor * weight
            else:
                if final[state]:
                    return out
        return [0.0] * len(MODES)

    def clauses(self, text: str) -> Iterator[list[str]]:
        """The words of the clauses of a text that hold a stem; each of these is read once, from stop to stop, however long it is."""
        text, done = text.lower(), 0
        for end, length in self.automaton.iter(text):
            at = end - length + 1
            if end < done or at and text[at - 1].isalpha():
                continue
            begin = max(done, *(text.rfind(c, done, at) + 1 for c in STOPS))
            stop = _STOP.search(text, end + 1)
            done = stop.start() if stop else len(text)
            yield [m[0] for m in _WORD.finditer(text, begin, done)]

    def emitted(self, text: str) -> list[float]:
        """Weights by mode over the clauses of a text."""
        total = [0.0] * len(MODES)
        for words in self.clauses(text):
            total = [a + b for a, b in zip(total, self.clause(self.tokens(words)), strict=True)]
        return total

    def score(self, emitted: np.ndarray) -> np.ndarray:
        c = np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(c[0] + np.log1p(emitted) @ c[1:], -40, 40)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hashes of the three-word shingles under three seeds, by which near copies are told."""
    for batch in batches:
        found = []
        for _, _, data, bounds in chunks(batch.column("text")):
            words = Words(data, bounds, lower=True)
            for n, first in zip(words.counts, words.first, strict=False):
                h = words.hash[first : first + n]
                found.append([int((grams(h, min(3, n), seed).min() if n else U64(0)).view(np.int64)) for seed in SKETCHES])
        rows = np.array(found, dtype=np.int64).reshape(-1, len(SKETCHES))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("text"), *(pa.array(c) for c in rows.T)], names=["toxic", "text", *(f"s{i}" for i in SKETCHES)])


def _stem_counts(known: Grammar):
    """Documents of either label that hold a word with the stem, by batch; toxic ones with a known stem are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, counts = batch.column("toxic").to_pylist(), (Counter(), Counter())
            for y, text in zip(toxic, batch.column("text").to_pylist(), strict=True):
                if y and known.stems and any(known.emitted(text)):
                    continue
                words = set(_WORD.findall(text.lower()))
                counts[y].update({w[:k] for w in words for k in PREFIX if len(w) >= k} | {w for w in words if len(w) > PREFIX[-1]})
            stems = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([counts[1][s] for s in stems], pa.int64()), pa.array([counts[0][s] for s in stems], pa.int64())], names=["stem", "toxic", "clean"])

    return run


def _context_counts(known: Grammar):
    """Documents of either label by word, stem of an insult in its clause and place (before: whether it stands before an insult), by batch; the word '' stands for the insult alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = set()
                for words in known.clauses(text):
                    insults = [(i, known.stem(w)) for i, w in enumerate(words) if known.insult(w)]
                    stems = {s for _, s in insults}
                    found |= {("", False, s) for s in stems}
                    for i, w in enumerate(words if insults else ()):
                        if w not in known.classes and not known.insult(w):
                            found |= {(w, False, s) for s in stems} | {(w, True, s) for at, s in insults if i < at}
                counts[y].update(found)
            rows = list(counts[0].keys() | counts[1].keys())
            cols = [pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([c[r] for r in rows], pa.int64()) for c in (counts[1], counts[0]))], names=["word", "before", "insult", "toxic", "clean"])

    return run


def _xlog(a: Column | float, b: Column | float) -> Column:
    return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)


def _tested(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """counts (toxic, clean) of n1 toxic and n0 other texts with sure, a likelihood ratio, and weight, the log odds of the label."""
    rate = (F.col("toxic") + F.col("clean")) / (n1 + n0)
    tests = F.lit(2.0) * (_xlog(F.col("toxic"), rate * n1) + _xlog(F.col("clean"), rate * n0) + _xlog(n1 - F.col("toxic"), (1 - rate) * n1) + _xlog(n0 - F.col("clean"), (1 - rate) * n0))
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    return counts.withColumn("sure", tests).withColumn("weight", weight)


def _chance(tried: int) -> float:
    """What the likelihood ratio of one of so many reaches by chance."""
    return 2 * math.log(max(1, tried)) + 6


def _sizes(sample: DataFrame) -> tuple[int, int]:
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    return n.get(1, 0), n.get(0, 0)


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Of the words' beginnings in sample (toxic 0 or 1, text) those that go with the label, with their log odds.

    Each round takes the surest stems, and the next looks at the toxic texts without any of
    them, so that what merely stands beside a known stem is not learned. The last round is the
    one in which no stem passes.
    """
    n1, n0 = _sizes(sample)
    kept: dict[str, float] = {}
    while n1 and n0:
        counts = sample.mapInArrow(_stem_counts(Grammar(kept)), "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        tried = written(_tested(counts.filter("toxic >= 5"), n1, n0))
        chance = _chance(tried.count())
        passed = tried.filter((F.col("weight") > 2) & (F.col("sure") > chance)).orderBy(F.desc("sure"), F.desc(F.length("stem")), "stem").collect()
        new = 0
        for r in passed:  # stems of the sample, which is bounded
            s = r["stem"]
            if r["sure"] > 0.4 * passed[0]["sure"] and not any(s[:k] in kept for k in range(1, len(s))) and not any(k.startswith(s) for k in kept):
                kept[s] = float(r["weight"])
                new += 1
        if not new:
            break
    return kept


def learn_context(sample: DataFrame, stems: dict[str, float]) -> tuple[list[str], list[str]]:
    """Words of reported speech and targets besides the fixed ones: those that stand with stems more often than chance in texts of one label.

    How often is to be expected follows from the stems that a word stands with, so that a word which is merely of
    the language of the surest stems is not learned.
    """
    if not stems:
        return [], []
    rows = sample.mapInArrow(_context_counts(Grammar(stems)), "word string, before boolean, insult string, toxic long, clean long")
    counts = written(rows.groupBy("word", "before", "insult").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    rates = written(counts.filter("word = ''").select("insult", (F.col("toxic") / (F.col("toxic") + F.col("clean"))).alias("rate")))
    n, toxic, due = F.col("n"), F.col("toxic"), F.col("due")
    each = counts.filter("word <> ''").withColumn("n", F.col("toxic") + F.col("clean")).join(broadcast_if_small(rates), "insult")
    words = each.groupBy("word", "before").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.sum(n * F.col("rate")).alias("due")).filter("n >= 5")
    tried = written(words.withColumn("sure", 2 * (_xlog(toxic, due) + _xlog(n - toxic, n - due))))
    sure = tried.filter(F.col("sure") > _chance(tried.count())).collect()  # words of the sample, which is bounded
    return sorted({r["word"] for r in sure if r["before"] and r["toxic"] < r["due"]}), sorted({r["word"] for r in sure if not r["before"] and r["toxic"] > r["due"]})


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Coefficients of a logistic regression, by Newton's method with a small ridge towards START."""
    x, start = np.hstack([np.ones((len(x), 1)), x]), np.array(START)
    c = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (p - y) + 0.5 * (c - start)
        c = c - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1]), grad)
    return tuple(np.clip(c, -20, 20))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2000, clean_rows: int = 4000) -> Grammar:
    """A grammar from labels (doc_id, toxic), about so many of each value, and the texts of these documents."""
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("_doc"), F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    draw = (F.xxhash64("_doc") / F.lit(float(1 << 63)) + 1) / 2
    share = F.when(F.col("toxic") == 1, min(1.0, toxic_rows / max(1, n.get(1, 0)))).otherwise(min(1.0, clean_rows / max(1, n.get(0, 0))))
    # ids are drawn whole, so one that repeats could bring any number of rows: the bound holds for rows too
    drawn = written(labels.filter(draw < share).orderBy(draw, "_doc", "toxic").limit(2 * (toxic_rows + clean_rows)))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(broadcast_if_small(drawn), F.col("doc_id") == F.col("_doc")).select("toxic", "text")
    sample = sample.mapInArrow(_sketched, "toxic int, text string, " + ", ".join(f"s{i} long" for i in SKETCHES))
    for i in SKETCHES:
        sample = sample.dropDuplicates(["toxic", f"s{i}"])
    sample = written(sample.select("toxic", "text"))
    stems = learn_stems(sample)
    reports, targets = learn_context(sample, stems)
    grammar = Grammar(stems, START, reports, targets)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    seen = with_columns_from(sample, {"emitted": "array<double>"}, lambda b: [pa.array([shared.value.emitted(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))])
    rows = seen.select("toxic", "emitted").toArrow()
    if not rows.num_rows or not grammar.stems:
        return grammar
    y = np.array(rows.column("toxic").to_pylist(), dtype=float)
    return Grammar(stems, _fit(np.log1p(np.array(rows.column("emitted").to_pylist()).reshape(-1, len(MODES))), y), reports, targets)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "").to_pylist()
        return [pa.array(shared.value.score(np.array([shared.value.emitted(t) for t in texts]).reshape(-1, len(MODES))), pa.float64())]

    return with_columns_from(docs, {"score": "double"}, run)
