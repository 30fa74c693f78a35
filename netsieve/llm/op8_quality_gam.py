"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers (shares of character and word classes,
repetition, line shape).  Training goes round the features again and again
and lets each in turn fit a shallow tree (at most ``LEAVES`` leaves) on the
current residual; a feature's trees add up to one lookup table over its bins.
The pairs whose small two-way trees help most then get tables of their own.
A score is the sum of one table entry per feature and pair, looked up for a
whole batch of texts at once.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``);
its size does not depend on the corpus.

Defined cases: NULL and empty texts have all-zero features and get that
score; without labelled rows of both classes every score is the share of
label 1 (0.5 without any); other columns are ignored, an empty table gives an
empty result, repeated rows score alike.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from netsieve.llm import textarrays as T
from netsieve.llm.labelled import SAMPLE_ROWS, held_out, labelled_sample
from netsieve.llm.storage import map_arrow

BINS, PAIR_BINS = 32, 8
LEAVES, ROUNDS, PAIR_ROUNDS, PAIRS = 4, 120, 40, 8
RATE, RIDGE = 0.1, 5.0
THRESHOLD = 0.7

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_DIGIT = (_B >= 48) & (_B <= 57)
_HIGH = _B >= 128
_LINE = _B == 10
_STOP = np.isin(_B, list(b".,;:?"))
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _STOP | T.WHITE)
_CLASSES = {"upper": _UPPER, "digit": _DIGIT, "high": _HIGH, "stop": _STOP, "symbol": _SYMBOL}
FEATURES = ("log_words", "word_length", *(f"{c}_share" for c in _CLASSES), "symbol_words", "distinct_words",
            "top_word", "same_as_before", "distinct_pairs", "lines_per_word", "distinct_lines", "short_words",
            "long_words")


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct hashes and the largest count of one."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first)).astype(np.uint64)
    key = np.sort((doc << np.uint64(52)) | (h >> np.uint64(12)))
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    owner = (key[start] >> np.uint64(52)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, np.diff(np.append(start, len(key))))
    return np.bincount(owner, minlength=n), top


def features(t: T.Texts) -> np.ndarray:
    """(texts, FEATURES) numbers; a text without words is a row of zeros."""
    def per_text(mask):
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[t.offsets[1:]] - c[t.offsets[:-1]]).astype(float)

    def per_text_words(mask):
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[w.first[1:]] - c[w.first[:-1]]).astype(float)
    w = T.words(t)
    h = T.word_hashes(t, w)
    n, size = np.diff(w.first).astype(float), np.maximum(np.diff(t.offsets), 1).astype(float)
    words = np.maximum(n, 1)
    length = w.ends - w.starts
    last = t.buf[np.maximum(w.ends - 1, 0)] if len(w.ends) else np.empty(0, np.uint8)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    inner = w.first[:-1][w.first[:-1] < len(h)]
    same[inner] = False
    pair = h.copy()
    pair[1:] = T.mix64(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
    distinct, top = _distinct(h, w.first)
    pairs, _ = _distinct(pair, w.first)
    lines = T.words(t, _LINE)
    line_h = T.word_hashes(t, lines)
    n_lines = np.diff(lines.first).astype(float)
    line_kinds, _ = _distinct(line_h, lines.first)
    columns = [np.log1p(n), per_text_words(length) / words, *(per_text(m[t.buf]) / size for m in _CLASSES.values()),
               per_text_words(_SYMBOL[last]) / words, distinct / words, top / words, per_text_words(same) / words,
               pairs / words, n_lines / words, line_kinds / np.maximum(n_lines, 1),
               per_text_words(length <= 2) / words, per_text_words(length >= 14) / words]
    return np.where(n[:, None] > 0, np.column_stack(columns), 0.0)


def _feature_rows(batches):
    for batch in batches:
        for lo, t in T.slices(batch.column(0)):
            x = features(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.float64).tolist(), pa.list_(pa.float64())), batch.column(1).slice(lo, len(x))],
                names=["x", "y"])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> tuple[np.ndarray, float]:
    """Best-first tree over ordered bins: the value of each bin's leaf and the gain."""
    def score(a, b):
        return a * a / (b + RIDGE)

    def best(lo, hi):
        if hi - lo < 2:
            return 0.0, lo
        cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        tg, th = g[lo:hi].sum(), h[lo:hi].sum()
        gain = score(cg, ch) + score(tg - cg, th - ch) - score(tg, th)
        i = int(np.argmax(gain))
        return float(gain[i]), lo + i + 1
    parts, total = [(0, len(g), *best(0, len(g)))], 0.0
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        lo, hi, gain, at = parts[k]
        if gain <= 1e-9:
            break
        total += gain
        parts[k:k + 1] = [(lo, at, *best(lo, at)), (at, hi, *best(at, hi))]
    out = np.empty(len(g))
    for lo, hi, _, _ in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out, total


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Two-level tree over a grid: a cut of one feature, then one of the other on each side."""
    best = (np.zeros_like(g), 0.0)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(a)):
            value, gain = np.empty_like(a), 0.0
            for side in (slice(0, at), slice(at, None)):
                row, more = _tree(a[side].sum(0), b[side].sum(0), 2)
                value[side] = row
                gain += more
                gain += a[side].sum() ** 2 / (b[side].sum() + RIDGE)
            gain -= a.sum() ** 2 / (b.sum() + RIDGE)
            if gain > best[1]:
                best = (value.T if turn else value, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Tables of the model from features and 0/1 labels."""
    p = y.mean() if len(y) else 0.5
    model = {"base": float(np.log((p + 1e-3) / (1 - p + 1e-3))), "edges": [], "tables": [], "pairs": [], "constant": None}
    if len(y) == 0 or p in (0.0, 1.0):
        return model | {"constant": float(p)}
    cuts = np.arange(1, BINS) / BINS
    model["edges"] = [np.unique(np.quantile(c, cuts)) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model["edges"], x.T)]
    z = np.full(len(y), model["base"])
    tables = [np.zeros(len(e) + 1) for e in model["edges"]]

    def residual():
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = residual()
            n = len(tables[j])
            step, _ = _tree(np.bincount(b, g, n), np.bincount(b, h, n), LEAVES)
            step *= RATE
            tables[j] += step
            z += step[b]
    coarse = [np.unique(np.quantile(c, np.arange(1, PAIR_BINS) / PAIR_BINS)) for c in x.T]
    small = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T)]

    def grid(i, j):
        g, h = residual()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = small[i] * shape[1] + small[j]
        return cell, np.bincount(cell, g, np.prod(shape)).reshape(shape), np.bincount(cell, h, np.prod(shape)).reshape(shape)
    gains = sorted(((_pair_tree(*grid(i, j)[1:])[1], i, j) for i, j in combinations(range(len(bins)), 2)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    pair_tables = {p: 0.0 for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            cell, g, h = grid(i, j)
            step = RATE * _pair_tree(g, h)[0]
            pair_tables[i, j] = pair_tables[i, j] + step
            z += step.ravel()[cell]
    return model | {"tables": tables, "coarse": coarse, "pairs": [(i, j, v) for (i, j), v in pair_tables.items()]}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if model["constant"] is not None:
        return np.full(len(x), model["constant"])
    z = np.full(len(x), model["base"])
    for e, table, c in zip(model["edges"], model["tables"], x.T):
        z += table[np.searchsorted(e, c, "right")]
    for i, j, table in model["pairs"]:
        z += table[np.searchsorted(model["coarse"][i], x[:, i], "right"),
                   np.searchsorted(model["coarse"][j], x[:, j], "right")]
    return 1 / (1 + np.exp(-z))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, fold: int = 2,
          rows: int = SAMPLE_ROWS) -> dict:
    """Fit on the bounded sample; the driver holds its feature matrix, ``rows`` x FEATURES numbers."""
    sample = labelled_sample(docs, labels, label, modulus, fold, rows)
    got = map_arrow(sample, _feature_rows, "x array<double>, y int").collect()
    got.sort(key=lambda r: (r.y, r.x))  # the order rows arrive in must not matter
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], float))


def _score_rows(model: dict, n_columns: int, score: str):
    def run(batches):
        for batch in batches:
            for lo, t in T.slices(batch.column(n_columns - 1)):
                x = features(t)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, len(x)) for c in range(n_columns)), pa.array(predict(model, x))],
                    names=[*batch.schema.names, score])
    return run


def scored(docs: DataFrame, model: dict, carry: list[str], score: str = "score") -> DataFrame:
    """Columns ``carry`` of every row plus its score; the last carried column is the text."""
    src = docs.select(*carry)
    schema = StructType([*src.schema.fields, StructField(score, DoubleType())])
    return map_arrow(src, _score_rows(model, len(carry), score), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, rows=rows)
    out = scored(docs, model, ["doc_id", "text"])
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
