"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted one feature at a time, in cycles, on the residual of all others, so that each feature ends with
a lookup table over its bins; the strongest pairs then get tables of their own. A score is a sum of table entries.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import input_columns
from tidemark.llm.folds import TRAIN_ROWS, held_out, once, training_rows

FEATURES = (
    "log_chars", "word_length", "upper", "digits", "stops", "commas", "loud", "marks", "bars", "brackets", "newlines",
    "beyond_ascii", "distinct_words", "repeated_next", "distinct_lines", "line_length", "entropy", "short_words",
)
_GROUPS = {
    "upper": range(65, 91), "digits": range(48, 58), "stops": b".", "commas": b",;:", "loud": b"!?", "marks": b"*#%&$@^~+=",
    "bars": b"|\\/<>_-", "brackets": b"()[]{}\"'", "newlines": b"\n", "beyond_ascii": range(128, 256),
}
_MASK = np.zeros((len(_GROUPS), 256))
for _i, _g in enumerate(_GROUPS.values()):
    _MASK[_i, list(_g)] = 1


def features(text: str) -> list[float]:
    """Of one whole text; all finite, for the empty text too. No label, id, language or source goes in."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    h = np.zeros(256)
    for at in range(0, len(raw), 1 << 20):
        h += np.bincount(raw[at : at + (1 << 20)], minlength=256)
    shares = (_MASK @ h / n).tolist()
    p = h[h > 0] / n
    words, lines = text.split(), text.split("\n")
    k = max(1, len(words))
    same = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    different = set(words)
    return [
        float(np.log1p(len(raw))), (len(raw) - h[32] - h[10]) / k, *shares, len(different) / k, same / k,
        len(set(lines)) / len(lines), float(np.log1p(len(raw) / len(lines))), float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        sum(1 for w in different if len(w) < 4) / max(1, len(different)),
    ]


@dataclass
class Additive:
    """edges[f]: inner bin bounds; tables[f]: a value per bin; pairs: (f, g, coarse bounds of f, of g, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for f, g, ef, eg, t in self.pairs:
            z += t[np.searchsorted(ef, x[:, f], side="right"), np.searchsorted(eg, x[:, g], side="right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _bounds(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf value per bin of a tree over ordered bins that gains most in squared gradient at each cut."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge)
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return out
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A cut in one feature and, on either side, one in the other; the better of both orders."""
    best, value = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, a.shape[0]):
            out, gain = np.empty_like(a), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                ga, ha = a[part].sum(0), b[part].sum(0)
                leaf = _tree(ga, ha, 1, ridge)
                gain += float((leaf * ga).sum())
                out[part] = leaf
            if gain > best:
                best, value = gain, out.T if flip else out
    return value


def train(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 250, rate: float = 0.15, pairs: int = 5, coarse: int = 6, ridge: float = 2.0) -> Additive:
    """Cyclic boosting with the logistic loss. With no rows or one class only the intercept remains."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    model = Additive(float(np.log(share / (1 - share))), [np.empty(0)] * m, [np.zeros(1)] * m, [])
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [_bounds(x[:, f], bins) for f in range(m)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    cell = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    z = np.full(n, model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(m):
            g, h = residual()
            k = len(model.tables[f])
            step = rate * _tree(np.bincount(cell[f], g, k), np.bincount(cell[f], h, k), 2, ridge)
            model.tables[f] += step
            z += step[cell[f]]
    g, h = residual()
    rough = [_bounds(x[:, f], coarse) for f in range(m)]
    box = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(rough)]
    grid = lambda a, b, v: np.bincount(box[a] * (len(rough[b]) + 1) + box[b], v, (len(rough[a]) + 1) * (len(rough[b]) + 1)).reshape(len(rough[a]) + 1, -1)
    gains = sorted(((float((grid(a, b, g) ** 2 / (grid(a, b, h) + ridge)).sum()), a, b) for a, b in itertools.combinations(range(m), 2)), reverse=True)
    model.pairs = [(a, b, rough[a], rough[b], np.zeros((len(rough[a]) + 1, len(rough[b]) + 1))) for _, a, b in gains[:pairs]]
    for _ in range(rounds // 5):
        for a, b, _, _, t in model.pairs:
            g, h = residual()
            step = rate * _pair_tree(grid(a, b, g), grid(a, b, h), ridge)
            t += step
            z += step[box[a], box[b]]
    return model


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts], float).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Additive:
    """From at most rows labelled documents, one for each id; their features alone, 18 numbers a row, go to the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = once(training_rows(docs, labels, "quality", rows).mapInArrow(measure, "doc_id long, label int, x array<double>")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return train(x, (got["label"].to_numpy() > 0).astype(float))


def scored(rows: DataFrame, model: Additive, threshold: float) -> DataFrame:
    """All columns of rows (among them text) with score and predicted added."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate([model.score(_matrix(b.column("text").slice(i, 500))) for i in range(0, len(b), 500)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return rows.mapInArrow(add, schema)


def score_texts(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1: kept) of every row. A null text is empty; repeated rows score alike; without
    labelled rows all score the same. One pass without a shuffle."""
    rows = scored(input_columns(docs).withColumn("held_out", held_out(F.col("doc_id"))), model, threshold)
    return rows.select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """Rows of docs, all columns as they were, whose text scores at least threshold. Only the judged text goes to Python
    and back with the row; a null text is judged as empty."""
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(whole.alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kept = scored(rows, model, threshold).where(F.col("predicted") == 1)
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
