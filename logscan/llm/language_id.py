"""Language identification in two steps: the family, then the language within it.

A text becomes hashed counts of byte n-grams of one to three letters, square-rooted and
brought to length one. One-versus-one linear support vector machines tell the families
apart; within a family, one-versus-one machines tell its languages apart. Each step takes
the class with the most pairwise votes, then the larger sum of margins, then the first name.

The machines are fitted on the driver to a bounded sample of the labelled rows: about
`per_language` texts of each language, taken by hash of their id. Prediction streams over
the whole texts and shuffles nothing.

A null text, or one without a letter, is `und` with score 0. Null labels teach nothing; a
null id counts as the empty id. Repeated rows get equal results. Without any label all
texts are `und`. An empty table gives no rows. Other columns pass through; lang_pred and
score take the place of columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import with_columns_from
from logscan.llm.tokens import chunks

#: Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "hi", "mr", "ne", "ur"],
}
UNKNOWN = "und"
DIMS = 2048
ROWS = 256


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _letters() -> np.ndarray:
    """Bytes of ASCII letters in lower case and those of other scripts; all else is a blank."""
    out = np.full(256, 32, dtype=np.uint32)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


_LETTERS = _letters()


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of length one for each text."""
    n, docs = len(data), len(bounds) - 1
    out = np.zeros(docs * DIMS, dtype=np.float64)
    if n:
        b = _LETTERS[data]
        doc = np.repeat(np.arange(docs, dtype=np.int32), np.diff(bounds))
        h = np.zeros(n, dtype=np.uint32)
        for k in range(3):
            if n <= k:
                break
            h = h[: n - k] * np.uint32(0x01000193) + b[k:] + np.uint32(k + 1)
            place = ((h * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int32) + doc[: n - k] * DIMS
            out += np.bincount(place[doc[: n - k] == doc[k:]], minlength=len(out))
    x = np.sqrt(out.reshape(docs, DIMS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last for the constant 1, of a linear support vector machine (squared hinge loss, accelerated gradient); y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = old = np.zeros(x.shape[1], np.float32)
    step = 1 / (4 + ridge)
    for t in range(1, rounds + 1):
        ahead = w + (t - 1) / (t + 2) * (w - old)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        old, w = w, ahead - step * (ridge * ahead - 2 * x.T @ (share * y * slack))
    return w


class Choice:
    """One-versus-one machines between some classes."""

    def __init__(self, names: list[str], x: np.ndarray, of: np.ndarray):
        self.names = sorted(names)
        self.pairs = list(combinations(range(len(self.names)), 2))
        fitted = []
        for i, j in self.pairs:
            at = (of == self.names[i]) | (of == self.names[j])
            fitted.append(_fit(x[at], np.where(of[at] == self.names[i], 1, -1).astype(np.float32)))
        self.weights = np.array(fitted, dtype=np.float32).reshape(len(self.pairs), DIMS + 1).T

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row, and how surely it wins its weakest pair (0 to 1)."""
        k = len(self.names)
        if k == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = (x @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
        votes, sums, weakest = np.zeros((len(x), k)), np.zeros((len(x), k)), np.full((len(x), k), np.inf)
        for m, (i, j) in zip(margins.T, self.pairs, strict=True):
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            sums[:, i] += m
            sums[:, j] -= m
            weakest[:, i] = np.minimum(weakest[:, i], m)
            weakest[:, j] = np.minimum(weakest[:, j], -m)
        best = np.argmax(votes + np.tanh(sums) * 0.49, axis=1)
        return best, 1 / (1 + np.exp(-3 * np.clip(weakest[np.arange(len(x)), best], -50, 50)))


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        of = np.array([family_of(x) for x in langs], dtype=object)
        self.families = Choice(sorted(set(of)), x, of) if len(of) else None
        self.within = {f: Choice(sorted(set(langs[of == f])), x[of == f], langs[of == f]) for f in sorted(set(of))}

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x))
        if self.families and len(x):
            family, sure = self.families(x)
            for f, name in enumerate(self.families.names):
                at = np.flatnonzero(family == f)
                best, own = self.within[name](x[at])
                lang[at] = np.array(self.within[name].names, dtype=object)[best]
                score[at] = sure[at] * own
        return lang, score


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, bounds in chunks(batch.column("text"), ROWS):
            x = features(data, bounds).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(row, end - row), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


def train(labelled: DataFrame, per_language: int = 1000) -> Model:
    """A model from the text and lang of rows, doc_id only to draw the sample: about per_language texts of each language."""
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "text", F.col("lang").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    draw = (F.xxhash64("doc_id") / F.lit(float(1 << 63)) + 1) / 2
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("label") == lang, min(1.0, per_language / n)).otherwise(share)
    drawn = rows.filter((draw < share) & F.col("text").rlike(r"\p{L}")).select("label", "text").mapInArrow(_feature_rows, "label string, x binary").toArrow()
    x = np.frombuffer(b"".join(drawn.column("x").to_pylist()), dtype=np.float16).reshape(-1, DIMS).astype(np.float32)
    return Model(x, np.array(drawn.column("label").to_pylist(), dtype=object))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, scores = [], []
        for _, _, data, bounds in chunks(batch.column(batch.schema.get_field_index("text"))):
            lang, score = shared.value(features(data, bounds))
            langs.append(lang)
            scores.append(score)
        return [pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(scores), pa.float64())]

    out = with_columns_from(docs, {"lang_pred": "string", "score": "double"}, run, ROWS)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({"lang_pred": F.when(letter, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(letter & (F.col("lang_pred") != UNKNOWN), F.col("score")).otherwise(0.0)})


def remainder(by: int):
    """crc32 of doc_id as text, modulo by."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % by
