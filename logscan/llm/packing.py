"""Packing documents into sequences of bounded length, by best-fit decreasing.

Texts become token ids with a given vocabulary, each followed by an end token. A document
longer than a sequence is cut into whole sequences from its end, so that its first piece may
be shorter; all others are one piece. Pieces are placed longest first, each into the
fullest sequence that still has room; where none has, a new one is opened.

Sequences with the same room are alike, and lengths are integers up to the capacity. So the
plan needs only how many pieces there are of each length, one number a length: a segment
tree over the rooms of open sequences finds the tightest one that fits in logarithmic time,
and all pieces that would go there are placed at once. The plan is that of the
document-by-document form to the last sequence, but takes a few thousand steps whatever the
number of documents. It says which ranks among the pieces of a length go to which sequences,
and is bounded by the capacity, so it is broadcast.

Pieces are counted by length where they are encoded, so a rank is the number of pieces of
that length in earlier tasks (a sum over small counts) and the count in the task. No text
and no piece is sorted, gathered or shuffled, whatever length a third of the documents have.

A null text counts as empty and is the end token alone. Rows are independent: repeated and
null doc_ids are documents of their own. Other columns are not read. An empty table gives
no rows; without an end token, neither does a document without tokens. Which of two pieces of a length goes
to which place is not fixed, so sequence numbers may differ between runs.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscan.llm.bpe import PIECES, Vocabulary, _load, _Shared, byte_letters
from logscan.llm.common import broadcast_if_small, written

#: Texts encoded at a time, and the longest run of white space that the fast encoder is given.
TEXTS, RUN = 200, 1000
BATCHES = "length int, rank_from long, rank_to long, each int, sequence_from long, at int"


class Encoder:
    """Token ids of texts. Where the ids of a vocabulary ascend with its merges, as they mostly do, the ranks of its tokens say all and a compiled encoder reads them; else the trees of bpe."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        back = {c: b for b, c in byte_letters().items()}
        plain = all(a < b for a, b in zip(made, made[1:])) and all(c in back for word in vocab for c in word)  # noqa: B905, RUF007
        self.trees = Vocabulary(content)
        self.fast = None
        if plain:
            ranks = {bytes(map(back.__getitem__, word)): i for word, i in vocab.items()}
            pattern = PIECES.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
            self.fast = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
        self.spaces = regex.compile(rf"\s{{{RUN}}}")

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or (len(text) >= RUN and self.spaces.search(text)):
            return np.frombuffer(self.trees.encode_batch([text])[0], dtype=np.int32).astype(np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")

    def forget(self) -> None:
        self.trees.forget()


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens begin, and n: all but the first are of the whole capacity. No tokens, no piece."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n + 1, capacity)] if n else [0]


def _pieces(shared: _Shared, capacity: int, end: int | None, with_ids: bool, schema: pa.Schema):
    """Of batches (doc_id, text) the pieces of the documents, numbered by length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _load(Encoder, shared), TaskContext.get().partitionId()
        counts = [0] * (capacity + 1)
        tail = np.array([] if end is None else [end], dtype=np.uint32)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, TEXTS):
                    batch = whole.slice(at, TEXTS)
                    rows, starts, lengths, sums, ranks, places, ids = [], [], [], [], [], [], []
                    for row, text in enumerate(pc.fill_null(batch.column(1), "").to_pylist()):
                        tokens = np.concatenate([encoder.encode(text), tail])
                        bounds = cuts(len(tokens), capacity)
                        for n, (a, b) in enumerate(zip(bounds, bounds[1:])):  # noqa: B905, RUF007
                            rows.append(row)
                            places.append(n)
                            starts.append(a)
                            lengths.append(b - a)
                            part = tokens[a:b].astype("<u4")
                            sums.append(zlib.crc32(part))
                            ranks.append(counts[b - a])
                            counts[b - a] += 1
                            if with_ids:
                                ids.append(part)
                    columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(places, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array(ranks, pa.int64())]
                    if with_ids:
                        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat)))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
        finally:
            encoder.forget()

    return run


class Rooms:
    """Open sequences by room: a segment tree over the rooms finds the least that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)  # sequences below each node
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        """Sequences first, first + 1, ... of this room."""
        if count:
            self.groups[room].append((first, count))
            self._count(room, count)

    def take(self, room: int) -> tuple[int, int]:
        first, count = self.groups[room].pop()
        self._count(room, -count)
        return first, count

    def _count(self, room: int, change: int) -> None:
        i = room + self.size
        while i:
            self.open[i] += change
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of at least length that a sequence has."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:  # what is right of the way up is larger
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass(frozen=True)
class Batch:
    """Pieces of a length with ranks rank_from to rank_to - 1: each of the sequences from sequence_from on takes so many of them, the first at place at."""

    length: int
    rank_from: int
    rank_to: int
    each: int
    sequence_from: int
    at: int


def plan(counts: dict[int, int], capacity: int) -> list[Batch]:
    """Best-fit decreasing of so many pieces of each length."""
    rooms, out, opened = Rooms(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                # enough new ones for all that is left, or for what does not fill the last
                room, count = capacity, -(-left // (capacity // length))
                first, opened = opened, opened + count
            else:
                first, count = rooms.take(room)
            each = room // length
            full = min(count, left // each)
            for n, take, begin in ((full, each, first), (1, left - full * each, first + full)):
                if n and take and n * take <= left and begin < first + count:
                    out.append(Batch(length, rank, rank + n * take, take, begin, capacity - room))
                    rooms.add(room - take * length, begin, n)
                    rank, left, count, first = rank + n * take, left - n * take, count - n, first + n
            rooms.add(room, first, count)
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int | None = 2, with_ids: bool = False, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids, with_ids): the pieces of the documents and their places in sequences of at most capacity tokens."""
    shared = _Shared(docs, vocabulary)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, task int, nth long" + (", ids array<int>" if with_ids else "")
    schema = pa.schema([("doc_id", _arrow(given)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
    pieces = written(given.mapInArrow(_pieces(shared, capacity, end, with_ids, schema), columns))
    # pieces of a length in the tasks before a task: a row for each length and task
    counted = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counted.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    batches = docs.sparkSession.createDataFrame([(b.length, b.rank_from, b.rank_to, b.each, b.sequence_from, b.at) for b in plan(counts, capacity)], BATCHES)
    ranked = pieces.join(broadcast_if_small(bases.select("length", "task", "base")), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(F.broadcast(batches), "length").filter("rank >= rank_from and rank < rank_to")  # bounded by the capacity
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        F.col("doc_id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence_from") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)
