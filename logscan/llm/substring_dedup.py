"""Substring dedup by compaction of a De Bruijn graph of token k-mers.

An edge of the graph is a window of `window` consecutive words; it joins the
(window - 1)-mers that it begins and ends with. Consecutive windows that share one
anchor (the least hash among the shorter k-mers in the window, the leftmost on ties)
form a path, so equal windows lie in paths of equal anchors, at the same offset.

1. Each document becomes paths (anchor, path hash, place, number of edges), about one row
   for seven words. A task keeps one row for each path that it meets more than once, and
   one row for an anchor at which it sees several paths, so a hot passage sends one row for
   a million paths of a task and not one from each document.
2. One shuffle brings the paths of an anchor together. An anchor with a single path is
   nonbranching: all but the first source of the path repeat it as a whole. At a branching
   anchor equal paths compact likewise, and what is left is compared edge by edge.
3. The documents of the branching paths are joined by their source coordinates, the edges
   there are hashed from the text and the first source of each edge is found.
4. Every repeated span knows the coordinates of the span that it repeats. The words at
   those are read from their documents, and a digest of 128 bits (BLAKE2b) of them goes
   with the span. The spans of a document are joined to its text; those whose own words
   have the same digest are merged and cut out, and the others stay.

Keys are pairs of 64-bit hashes (anchor and path, or two hashes of an edge); they only
propose spans, and step 4 verifies them.

A document is a doc_id with a text: rows that repeat both are one document, which repeats
nothing of itself at the same place, and each of them gets the same result. Rows that
repeat a doc_id with another text are documents of their own, in the order of a hash of
the text. A row without doc_id has no place in the order; it is neither compared nor
changed, and returned whole. A null text has no words. A text shorter than the window
stays. An empty table gives no rows. Only doc_id and text are read; other columns,
whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscan.llm.common import broadcast_if_small, is_small, written
from logscan.llm.tokens import U64, Words, buffers, chunks, grams, inverse, mix, powers

_Q = 0xA0761D6478BD642F | 1
#: Paths or edges that a task looks through for repeats before it sends them on.
GATHER = 1_000_000
#: Texts whose words are held at a time.
ROWS = 256
#: Kinds of rows that the first pass sends: a path to compare, the news that an anchor branches, a branching path, a repeated span.
PATH, NEWS, BRANCH, SPAN = 0, 1, 2, 3


def _leftmost_least(v: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each w consecutive values the least, and the place of its leftmost occurrence."""
    at, span = np.arange(len(v)), 1
    while span < w:
        step = min(span, w - span)
        less = v[step:] < v[:-step]
        v, at = np.where(less, v[step:], v[:-step]), np.where(less, at[step:], at[:-step])
        span += step
    return v, at


def _paths(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, path hash, text, first word in the text, edges: of each path."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return (*(np.empty(0, U64),) * 2, *(np.empty(0, np.int64),) * 3)
    least, at = _leftmost_least(grams(words.hash, anchor), window - anchor + 1)
    whole = words.doc[:n] == words.doc[window - 1 :]
    new = whole.copy()
    new[1:] &= (at[1:n] != at[: n - 1]) | ~whole[:-1]
    start = np.flatnonzero(new)
    ends = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True)) + 1
    edges = ends - start
    sums = np.zeros(len(words.hash) + 1, dtype=U64)
    np.cumsum(words.hash * powers(_Q, len(words.hash)), out=sums[1:])
    path = (sums[ends + window - 1] - sums[start]) * powers(inverse(_Q), len(words.hash) + 1)[start]
    doc = words.doc[start]
    return least[start], mix(path + edges.astype(U64)), doc, start - words.first[doc], edges


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the keys, and which rows of it begin a group."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def _repeats(order: np.ndarray, new: np.ndarray, place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in the order of their places: the first of each group, those that come later in it than its first place, and what each of these repeats."""
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    later = np.flatnonzero(np.logical_or.reduce([c[order] != c[head] for c in place]))
    later = later[np.argsort(order[later], kind="stable")]
    return order[new], order[later], head[later]


def _joined(place: tuple[np.ndarray, ...], edges: np.ndarray, source: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray, tuple[np.ndarray, ...]]:
    """Spans in the order of their places, those that follow on each other here and in what they repeat made one."""
    if not len(edges):
        return place, edges, source
    new = np.ones(len(edges), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != (c[:-1] if i < 2 else c[:-1] + edges[:-1]) for p in (place, source) for i, c in enumerate(p)])
    at = np.flatnonzero(new)
    return tuple(c[at] for c in place), np.add.reduceat(edges, at), tuple(c[at] for c in source)


_TYPES = [("kind", "tinyint", np.int8), ("a", "long", np.int64), ("b", "long", np.int64), ("doc_id", "long", np.int64), ("tag", "int", np.int32), ("start", "int", np.int32), ("edges", "int", np.int32)]
_SOURCE = [("from_doc", "long", np.int64), ("from_tag", "int", np.int32), ("from_start", "int", np.int32)]
_ROW_SQL = ", ".join(f"{n} {t}" for n, t, _ in _TYPES + _SOURCE)
_PLACE = ["doc_id", "tag", "start"]
_FROM = [n for n, _, _ in _SOURCE]


def _rows(kind: int, a: np.ndarray, b: np.ndarray, place: tuple[np.ndarray, ...], edges: np.ndarray, source: tuple[np.ndarray, ...] | None = None) -> pa.RecordBatch:
    cols = [np.full(len(edges), kind, np.int8), a.view(np.int64), b.view(np.int64), *place, edges]
    out = [pa.array(c.astype(t)) for c, (_, _, t) in zip(cols, _TYPES, strict=True)]
    out += [pa.array(c.astype(t)) for c, (_, _, t) in zip(source, _SOURCE, strict=True)] if source else [pa.nulls(len(edges), pa.from_numpy_dtype(t)) for _, _, t in _SOURCE]
    return pa.RecordBatch.from_arrays(out, names=[n for n, _, _ in _TYPES + _SOURCE])


def _apart(kind: int, place: tuple[np.ndarray, ...], edges: np.ndarray, source: tuple[np.ndarray, ...] | None = None) -> pa.RecordBatch:
    """Rows that only pass through the shuffle, spread over it."""
    own = mix(place[0].astype(U64) * U64(_Q) + place[2].astype(U64))
    return _rows(kind, own, own, place, edges, source)


def _in_order(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The columns (a, b, doc, tag, start, edges) of the parts in the order of their places."""
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((cols[4], cols[3], cols[2]))
    return cols if (order[1:] > order[:-1]).all() else [c[order] for c in cols]


def _gathered(batches: Iterator[pa.RecordBatch], find, send) -> Iterator[pa.RecordBatch]:
    """What send makes of the parts that find takes from batches, GATHER rows or more at a time."""
    parts, n = [], 0
    for batch in batches:
        for part in find(batch):
            parts.append(part)
            n += len(part[0])
            if n >= GATHER:
                yield from send(*_in_order(parts))
                parts, n = [], 0
    if parts:
        yield from send(*_in_order(parts))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)


def _find_paths(window: int, anchor: int):
    def find(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        ids, tags = _ids(batch)
        for row, end, data, bounds in chunks(batch.column("text")):
            a, b, doc, start, edges = _paths(Words(data, bounds), window, anchor)
            yield a, b, ids[row:end][doc], tags[row:end][doc], start, edges

    def send(a: np.ndarray, b: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = (doc, tag, start)
        at = lambda i: tuple(c[i] for c in place)
        kept, later, source = _repeats(*_groups(a, b), place)
        yield _apart(SPAN, *_joined(at(later), edges[later], at(source)))
        # kept is in the order of anchors: see which have several paths
        same = np.zeros(len(kept), dtype=bool)
        same[1:] = a[kept][1:] == a[kept][:-1]
        several = same.copy()
        several[:-1] |= same[1:]
        for kind, i in ((PATH, kept[~several]), (NEWS, kept[several & ~same])):
            yield _rows(kind, a[i], b[i], at(i), edges[i])
        i = kept[several]
        yield _apart(BRANCH, at(i), edges[i])

    return lambda batches: _gathered(batches, find, send)


def _find_edges(window: int):
    """Of joined rows (doc_id, tag, text, at: places of branching paths) the edges there: the first source that the task has of each, and the spans already known to repeat."""

    def find(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        ids, tags = _ids(batch)
        for row, end, data, bounds in chunks(batch.column("text")):
            words = Words(data, bounds)
            if len(words.hash) < window:
                continue
            places = batch.column("at").slice(row, end - row)
            packed = places.flatten()
            doc = np.repeat(np.arange(end - row), np.asarray(places.value_lengths()))
            start, n = (packed.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "edges"))
            doc, start = np.repeat(doc, n), np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            one = np.unique(doc * (1 << 40) + start)
            doc, start = one >> 40, one & ((1 << 40) - 1)
            fits = start + window <= words.counts[doc]
            doc, start = doc[fits], start[fits]
            at = start + words.first[doc]
            yield grams(words.hash, window, 1)[at], grams(words.hash, window, 2)[at], ids[row:end][doc], tags[row:end][doc], start, np.ones(len(start), np.int64)

    def send(a: np.ndarray, b: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = (doc, tag, start)
        at = lambda i: tuple(c[i] for c in place)
        kept, later, source = _repeats(*_groups(a, b), place)
        yield _apart(SPAN, *_joined(at(later), edges[later], at(source)))
        yield _rows(PATH, a[kept], b[kept], at(kept), edges[kept])

    return lambda batches: _gathered(batches, find, send)


def _digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


def _read_sources(window: int):
    """Of joined rows (doc_id, tag, text, at: places of spans that are repeated) a digest of the words at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                data, bounds = buffers(part.column("text"))
                raw, bounds = memoryview(data), bounds.tolist()
                digests = []
                for i, places in enumerate(part.column("at").to_pylist()):
                    words = bytes(raw[bounds[i] : bounds[i + 1]]).split()
                    digests += [_digest(words[p["start"] : p["start"] + p["edges"] + window - 1]) for p in places]
                lists = part.column("at")
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                flat = lists.flatten()
                cols = [part.column("doc_id").take(pa.array(row)), part.column("tag").take(pa.array(row)), flat.field("start"), flat.field("edges"), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tag", "start", "edges", "digest"])

    return run


def _cut_out(window: int):
    """Of joined rows (doc_id, text, at: spans with the digests of what they repeat) the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                data, bounds = buffers(part.column("text"))
                raw, bounds = memoryview(data), bounds.tolist()
                texts, total, gone = [], [], []
                for i, spans in enumerate(part.column("at").to_pylist()):
                    words = bytes(raw[bounds[i] : bounds[i + 1]]).split()
                    total.append(len(words))
                    kept, free = [], 0
                    for start, end, digest in sorted((s["start"], s["start"] + s["edges"] + window - 1, s["digest"]) for s in spans or ()):
                        if end > free and _digest(words[start:end]) == digest:
                            kept += words[free : max(start, free)]
                            free = end
                    words = kept + words[free:]
                    gone.append(total[-1] - len(words))
                    texts.append(b" ".join(words))
                text = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), text], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _at(spans: DataFrame, *columns: str) -> DataFrame:
    """The spans of each document as an array at, under the names at_doc and at_tag."""
    return spans.groupBy(F.col("doc_id").alias("at_doc"), F.col("tag").alias("at_tag")).agg(F.collect_list(F.struct(*columns)).alias("at"))


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The documents (doc_id, tag, text) that places (doc_id, tag, start, edges; written) are in, with those as an array at."""
    here = (F.col("doc_id") == F.col("at_doc")) & (F.col("tag") == F.col("at_tag"))
    keys = written(places.select(F.col("doc_id").alias("at_doc"), F.col("tag").alias("at_tag")).distinct())
    if is_small(keys):  # then only these texts are shuffled
        docs = docs.join(F.broadcast(keys), here, "left_semi")
    return docs.join(_at(places, "start", "edges"), here).select("doc_id", "tag", "text", "at")


def dedup_substrings(docs: DataFrame, window: int = 20, anchor: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: without the words of windows that also start earlier.

    Earlier is a smaller doc_id, or an earlier word of the same document; windows are judged on
    the input. anchor is the length in words of the k-mers that anchor the paths.
    """
    anchor = anchor or max(1, window * 2 // 5)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), F.col("text").cast("string").alias("text"))
    named = columns.filter("doc_id is not null")
    found = named.mapInArrow(_find_paths(window, anchor), _ROW_SQL).repartition("a")
    at_anchor, at_path = Window.partitionBy("a"), Window.partitionBy("a", "b").orderBy(*_PLACE)
    kind, here, source = F.col("kind"), F.struct(*_PLACE), F.struct(*_FROM)
    first = F.first(here).over(at_path)
    met = (
        found.withColumn("n", F.count(F.lit(1)).over(at_anchor))
        .filter((F.col("n") > 1) | (kind >= BRANCH))
        .withColumn("branches", (F.max("kind").over(at_anchor) >= NEWS) | (F.min("b").over(at_anchor) != F.max("b").over(at_anchor)))
        .withColumn("first", first)
    )
    later = F.col("first") != here
    state = F.when(kind >= BRANCH, kind).when(kind == NEWS, F.lit(None)).when(later, F.lit(SPAN)).when(F.col("branches"), F.lit(BRANCH))
    source = [F.when(kind == SPAN, F.col(f)).otherwise(F.col(f"first.{p}")).alias(f) for f, p in zip(_FROM, _PLACE, strict=True)]
    met = written(met.select(state.cast("tinyint").alias("state"), *_PLACE, "edges", *source).filter("state is not null"))

    edges = _with_places(named, met.filter(F.col("state") == BRANCH).select(*_PLACE, "edges")).mapInArrow(_find_edges(window), _ROW_SQL)
    edges = edges.repartition("a").withColumn("first", first).filter((kind == SPAN) | (F.col("first") != here))
    spans = met.filter(F.col("state") == SPAN).select(*_PLACE, "edges", *_FROM)
    spans = written(spans.union(edges.select(*_PLACE, "edges", *source)))

    repeated = written(spans.select(*[F.col(f).alias(p) for f, p in zip(_FROM, _PLACE, strict=True)], "edges").distinct())
    read = _with_places(named, repeated).mapInArrow(_read_sources(window), "doc_id long, tag int, start int, edges int, digest binary")
    read = read.distinct().select(*[F.col(p).alias(f) for f, p in zip(_FROM, _PLACE, strict=True)], "edges", "digest")
    spans = _at(spans.join(broadcast_if_small(written(read)), [*_FROM, "edges"]), "start", "edges", "digest")
    joined = named.join(spans, (F.col("doc_id") == F.col("at_doc")) & (F.col("tag") == F.col("at_tag")), "left").select("doc_id", "text", "at")
    unnamed = columns.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast(joined.schema["at"].dataType).alias("at"))
    return joined.union(unnamed).mapInArrow(_cut_out(window), "doc_id long, n_words long, n_removed long, kept_text string")
