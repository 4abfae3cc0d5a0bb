"""Byte-level BPE encoding and decoding with a given vocabulary.

A piece of text (as the pre-tokenizer cuts it) starts as its bytes. A segment tree holds
the rank of each adjacent pair of symbols; its root is the leftmost pair of the lowest
rank. That pair merges, the two pairs beside it get new ranks by point updates in
logarithmic time, and so on until the root shows no mergeable pair. Short pieces that a
task meets for the first time go through this together, one row of an array of trees each;
long ones have a tree of their own. A task remembers short pieces, up to a bound, so that
a frequent one is merged once, and forgets them at its end.

The vocabulary file (JSON with added_tokens, vocab and merges) is read on the driver and
its fixed content broadcast. Texts stream through the tasks; nothing is shuffled.

A null text counts as empty: no ids, and the decoded text ''. Rows are independent: repeats
and null ids of documents pass through, and so do all other columns of the input. An empty
table gives no rows. ids and decoded take the place of columns of these names.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import with_columns_from

# The pre-tokenizer's pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Pieces that a task remembers, twice over; pieces over LONG bytes are not. TOGETHER: trees of one array.
REMEMBER, LONG, TOGETHER = 100_000, 64, 8192
#: Texts that are encoded at a time.
TEXTS = 200
NONE = 1 << 62


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SegmentTree:
    """Least value over a row of places, with point updates."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        self.nodes = [NONE] * self.size + values + [NONE] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.nodes[i] = min(self.nodes[2 * i], self.nodes[2 * i + 1])

    def root(self) -> int:
        return self.nodes[1]

    def update(self, place: int, value: int) -> None:
        nodes, i = self.nodes, place + self.size
        nodes[i] = value
        while i > 1:
            i >>= 1
            least = min(nodes[2 * i], nodes[2 * i + 1])
            if nodes[i] == least:
                break
            nodes[i] = least


class Vocabulary:
    def __init__(self, content: str):
        spec = json.loads(content)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("|".join(regex.escape(w) for w in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        pairs = np.array(list(self.merges), dtype=np.int64).reshape(-1, 2)
        order = np.argsort(keys := pairs[:, 0] << 32 | pairs[:, 1])
        self.pair_keys = np.append(keys[order], NONE)
        self.pair_ranks = np.append(np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order], 0)
        self.made = np.zeros(len(spec["model"]["merges"]) + 1, dtype=np.int64)
        for rank, new in self.merges.values():
            self.made[rank] = new

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """Rank of each pair, then its place, in one number; NONE if it does not merge or has no right symbol."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at] * size + place, NONE)

    def merged_together(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The ids, as 32-bit integers, of pieces of at most size bytes, a power of two."""
        m = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        places = np.arange(size)
        inside = places < lengths[:, None]
        ids = np.full((m, size + 1), -1, dtype=np.int64)  # the last column stands for no symbol
        ids[:, :size][inside] = np.array(self.of_byte)[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.append(np.minimum(places + 1, size), size), (m, 1))
        after[np.arange(m), lengths - 1] = size
        before = np.tile(np.arange(-1, size), (m, 1))
        tree = np.full((m, 2 * size), NONE, dtype=np.int64)
        tree[:, size:][inside] = self._leaves(ids[:, :size], ids[:, 1:], places, size)[inside]
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            rank, i = np.divmod(tree[rows, 1], size)
            j = after[rows, i]
            k = after[rows, j]
            new = self.made[rank]
            ids[rows, i], ids[rows, j] = new, -1
            after[rows, i], before[rows, k] = k, i
            h = before[rows, i]
            none = np.full(len(rows), NONE)
            for leaf, value in (
                (i, self._leaves(new, ids[rows, k], i, size)),
                (j, none),
                (np.where(h >= 0, h, j), np.where(h >= 0, self._leaves(ids[rows, h], new, h, size), none)),
            ):
                p = leaf + size
                tree[rows, p] = value
                for _ in range(size.bit_length() - 1):
                    p >>= 1
                    tree[rows, p] = np.minimum(tree[rows, 2 * p], tree[rows, 2 * p + 1])
            rows = rows[tree[rows, 1] < NONE]
        kept = ids[:, :size] >= 0
        flat, ends = ids[:, :size][kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: set[str]) -> None:
        """Remembers the pieces of a batch of texts."""
        if len(self.known) >= REMEMBER:
            self.known, self.older = {}, self.known
        sizes: dict[int, list[str]] = {}
        for p in pieces.difference(self.known):
            if (found := self.older.get(p)) is not None:
                self.known[p] = found
            elif (n := len(p.encode())) <= LONG:
                sizes.setdefault(1 << max(0, n - 1).bit_length(), []).append(p)
        for size, same in sizes.items():
            for at in range(0, len(same), TOGETHER):
                part = same[at : at + TOGETHER]
                self.known.update(zip(part, self.merged_together([p.encode() for p in part], size), strict=True))

    def merged(self, piece: bytes) -> list[int]:
        ids, merges = [self.of_byte[b] for b in piece], self.merges
        n = len(ids)
        if n < 2:
            return ids

        def value(i: int, j: int) -> int:
            found = merges.get((ids[i], ids[j]))
            return NONE if found is None else found[0] * n + i

        tree = SegmentTree([value(i, i + 1) for i in range(n - 1)])
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while (least := tree.root()) < NONE:
            i = least % n
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            after[i] = k = after[j]
            ids[j] = -1
            if k >= 0:
                before[k] = i
                tree.update(j, NONE)
            elif j < n - 1:
                tree.update(j, NONE)
            tree.update(i, value(i, k) if k >= 0 else NONE)
            if (h := before[i]) >= 0:
                tree.update(h, value(h, i))
        return [x for x in ids if x >= 0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        runs = [self._runs(t) for t in texts]
        self.learn({p for text in runs for run in text if isinstance(run, list) for p in run})
        known = self.known.get
        out = []
        for text in runs:
            parts = []
            for run in text:
                parts += [run] if isinstance(run, bytes) else [known(p) or self._long(p) for p in run]
            out.append(b"".join(parts))
        return out

    def _runs(self, text: str) -> list[list[str] | bytes]:
        """The pieces of the text, and the ids of added tokens between them."""
        out, at = [], 0
        for m in self.split_added.finditer(text) if self.split_added else ():
            out += [self.pieces.findall(text[at : m.start()]), np.int32(self.added[m.group()]).tobytes()]
            at = m.end()
        return [*out, self.pieces.findall(text[at:] if at else text)]

    def _long(self, piece: str) -> bytes:
        return np.array(self.merged(piece.encode()), dtype=np.int32).tobytes()

    def forget(self) -> None:
        self.known, self.older = {}, {}


class Decoder:
    def __init__(self, content: str):
        spec = json.loads(content)
        back = {c: b for b, c in byte_letters().items()}
        words = {i: bytes(back[c] for c in word) for word, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_of = [words.get(i, b"") for i in range(max(words) + 1)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[tuple[type, str], Vocabulary | Decoder] = {}


def _load(kind: type, shared):
    """What a worker has made of a vocabulary; it keeps one of each kind."""
    if (kind, shared.id) not in _loaded:
        for other in [k for k in _loaded if k[0] is kind]:
            del _loaded[other]
        _loaded[kind, shared.id] = kind(shared.value)
    return _loaded[kind, shared.id]


class _Shared:
    """The content of a vocabulary file, broadcast once."""

    def __init__(self, docs: DataFrame, path: str):
        self.id = path
        self.content = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @property
    def value(self) -> str:
        return self.content.value


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with ids, an array of the token ids of the text; added tokens of the vocabulary are found in the text, none is added."""
    shared = _Shared(docs, vocabulary)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        vocab = _load(Vocabulary, shared)
        parts = vocab.encode_batch(pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").to_pylist())
        offsets = np.cumsum([0, *map(len, parts)]) // 4
        ids = np.frombuffer(b"".join(parts), dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]

    return with_columns_from(docs.withColumn(text, F.col(text).cast("string")), {"ids": "array<int>"}, run, TEXTS, done=lambda: _load(Vocabulary, shared).forget())


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of its ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    shared = _Shared(docs, vocabulary)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        vocab, column = _load(Decoder, shared), batch.column(batch.schema.get_field_index(ids))
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(column.value_lengths(), 0))
        return [pa.array([vocab.decode(part.tolist()) for part in np.split(flat, ends[:-1])] if len(ends) else [], pa.string())]

    return with_columns_from(docs, {out: "string"}, run, TEXTS)
