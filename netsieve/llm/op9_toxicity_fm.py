"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its runs of letters and the byte 4-grams inside them
(insults also occur as parts of compounds), each hashed to one of ``BUCKETS``
buckets.  Every bucket has a weight and factors; the machine

    z = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)

sums over all buckets present in a text and, through the factors, over each
pair of buckets that occur together.  x_i is the same for all texts: it grows
from 0 to 1 with the chi-square of the bucket against the label in the fitted
rows, and is at least ``FLOOR`` for factors (a term that tells nothing alone may
still tell in a pair).  So no term is left out, and thousands of rare terms do
not fit the noise.

Defined cases: NULL and empty texts have no terms and get the score of w0;
without labelled rows of both classes every score is the share of label 1
(0 without any); other columns are ignored, an empty table gives an empty
result, repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm import textarrays as T
from netsieve.llm.labelled import SAMPLE_ROWS, held_out, labelled_sample
from netsieve.llm.storage import map_arrow, materialise

BUCKETS, FACTORS, GRAM = 1 << 18, 8, 4
#: The rows fitted on hold at most this many (text, bucket) pairs in all.
SAMPLE_PAIRS = 30_000_000
EPOCHS, BATCH, RATE, PAIR_RATE, SEED = 8, 256, 2.0, 0.3, 17
#: L2 on single weights, and the stronger one on factors: a pair counts only where single terms do not explain the label.
RIDGE, PAIR_RIDGE = 1e-6, 1e-3
#: Chi-square at which a bucket's x is 2 ** -1.5, and the least x of a factor.
EVIDENCE, FLOOR = 60.0, 0.01
THRESHOLD = 0.7


def terms(t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every term occurrence of a slice."""
    w = T.words(t, T.NOT_LETTER)
    size = w.ends - w.starts
    more = np.maximum(size - GRAM + 1, 0)
    more[size <= GRAM] = 0  # the word itself
    at = np.repeat(w.starts - (np.cumsum(more) - more), more) + np.arange(more.sum())
    starts, ends = np.concatenate([w.starts, at]), np.concatenate([w.ends, at + GRAM])
    h = T.span_hashes(t.buf, starts, ends, T.FOLDED_CODE)
    doc = np.searchsorted(t.offsets, starts, "right") - 1
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), doc


def _present(term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, by text."""
    key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | term.astype(np.uint64))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int64)


def _example_rows(batches):
    for batch in batches:
        for lo, t in T.slices(batch.column(0)):
            term, doc = _present(*terms(t))
            n = len(t.offsets) - 1
            cut = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut), pa.array(term.astype(np.int32))),
                                              batch.column(1).slice(lo, n)], names=["x", "y"])


def _forward(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense form of the sum, for 0/1 rows over all buckets."""
    s = x @ model["v"]
    pairs = 0.5 * ((s * s).sum(1) - x @ (model["v"] ** 2).sum(1))
    return np.float32(model["w0"]) + x @ model["w"] + pairs, s


def evidence(term: np.ndarray, y: np.ndarray, rows: int, positive: float, size: int) -> np.ndarray:
    """x of each bucket, from the 2 x 2 table (bucket present, label 1); ``y`` is the label of each (row, bucket) pair."""
    n, a = np.bincount(term, minlength=size).astype(float), np.bincount(term, y, size)
    expected = n * (positive / rows)
    chi = (a - expected) ** 2 / np.maximum(expected * (1 - positive / rows) * (1 - n / (rows + 1.0)), 1e-9)
    chi *= n / (n + 4.0)  # the quotient is unreliable for a few rows
    return (chi / (chi + EVIDENCE)) ** 1.5


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows beginning at ``starts``; an empty run gives 0."""
    end = np.append(starts[1:], len(values))
    out = np.zeros((len(starts), *values.shape[1:]), values.dtype)
    some = starts < end
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


def fit(rows: list, y: np.ndarray, size: int) -> dict:
    """AdaGrad on the logistic loss over rows given as lists of bucket numbers; a step touches only its rows' buckets."""
    r = np.random.default_rng(SEED)
    y = np.asarray(y, float)
    rows = [np.asarray(x, np.int32) for x in rows]
    counts = np.array([len(x) for x in rows])
    x = evidence(np.concatenate(rows), np.repeat(y, counts), len(y), y.sum(), size).astype(np.float32)
    xv = np.maximum(x, np.float32(FLOOR))
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w0, w, v = np.log(p / (1 - p)), np.zeros(size, np.float32), r.normal(0, 0.01, (size, FACTORS)).astype(np.float32) * x[:, None]
    n0, nw, nv = 1e-4, np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-8, np.float32)
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            take = order[lo:lo + BATCH]
            first = np.cumsum(counts[take]) - counts[take]
            term = np.concatenate([rows[k] for k in take])
            row = np.repeat(np.arange(len(take)), counts[take])
            by_term = np.argsort(term, kind="stable")
            ordered = term[by_term]
            begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)])
            used, row_of = ordered[begins], row[by_term]
            xu, wu, vu = x[used], w[used], v[used]
            at = np.empty(len(term), np.int64)
            at[by_term] = np.repeat(np.arange(len(used)), np.diff(np.append(begins, len(term))))
            s = _sums(vu[at], first)
            z = w0 + _sums((wu * xu - 0.5 * (vu * vu).sum(1))[at], first) + 0.5 * (s * s).sum(1)
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)).astype(np.float32)
            g = _sums(e[row_of], begins)
            grad = g * xu + RIDGE * wu
            pair = _sums((e[:, None] * s)[row_of], begins) - g[:, None] * vu + PAIR_RIDGE * vu
            nw[used] += grad * grad
            w[used] -= RATE * grad / np.sqrt(nw[used])
            nv[used] += pair * pair
            v[used] -= PAIR_RATE * xv[used, None] * pair / np.sqrt(nv[used])
            n0 += e.sum() ** 2
            w0 -= RATE * e.sum() / np.sqrt(n0)
    return {"w0": np.float32(w0), "w": w * x, "v": v}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, fold: int = 1,
          rows: int = SAMPLE_ROWS, pairs: int = SAMPLE_PAIRS) -> dict:
    """Fit on a sample of at most ``rows`` rows and ``pairs`` (text, bucket) pairs, which the driver holds.

    Rows beyond ``pairs`` are left out in the order of a hash of their buckets.
    """
    sample = labelled_sample(docs, labels, label, modulus, fold, rows)
    sample = materialise(map_arrow(sample, _example_rows, "x array<int>, y int")
                         .withColumn("k", F.xxhash64("x", "y")), "toxicity-sample")
    sizes = sample.groupBy("k").agg(F.sum(F.size("x")).alias("n")).collect()  # at most ``rows`` of them
    sizes.sort(key=lambda r: r.k)
    total = np.cumsum([r.n for r in sizes])
    if len(total) and total[-1] > pairs:
        sample = sample.where(F.col("k") < sizes[int(np.searchsorted(total, pairs, "right"))].k)
    got = sample.toArrow().sort_by([("k", "ascending")])  # the order rows arrive in must not matter
    y = np.asarray(got["y"], float)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    x = got["x"].combine_chunks()
    at, flat = np.asarray(x.offsets), np.asarray(x.values)
    return {"constant": None, **fit([flat[a:b] for a, b in zip(at[:-1], at[1:])], y, BUCKETS)}


def predict(model: dict, t: T.Texts) -> np.ndarray:
    n = len(t.offsets) - 1
    if model["constant"] is not None:
        return np.full(n, model["constant"])
    at, doc = _present(*terms(t))
    linear = np.bincount(doc, model["w"][at] - 0.5 * (model["v"][at] ** 2).sum(1), n)
    squares = sum(np.bincount(doc, model["v"][at, f], n) ** 2 for f in range(FACTORS))
    return 1 / (1 + np.exp(-np.clip(model["w0"] + linear + 0.5 * squares, -30, 30)))


def _score_rows(model: dict):
    def run(batches):
        for batch in batches:
            for lo, t in T.slices(batch.column(1)):
                s = predict(model, t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(s)), pa.array(s)], names=["doc_id", "score"])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, rows=rows)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (map_arrow(src, _score_rows(model), "doc_id long, score double")
            .select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
