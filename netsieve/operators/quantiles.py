"""Exact quantiles with bounded memory (used by median fill and describe).

Spark's exact ``percentile``/``median`` aggregates keep every distinct value
of a group in one aggregation buffer, which does not survive a 100 TB column.
Here each wanted order statistic (the k-th smallest value of a column) is
found by passes of plain aggregates over the columns themselves:

1. a ``percentile_approx`` sketch brackets rank k with two values lo <= hi
   taken from the current window;
2. counts of the values below lo, equal to lo, between, and equal to hi say
   whether lo or hi *is* the answer; else the open interval the rank falls
   into becomes the next window;
3. a window of at most ``max_band_rows`` rows is reduced to distinct values
   with counts, and a running sum over those finds the rank.

Every round excludes at least the value lo, and normally all but about
4/accuracy of the rows, so the loop always ends; a repeated value (zero-heavy
or constant columns) is answered by the counts, never ranked.  Columns are
aggregated in groups, so no pass is wider than the group and each scan reads
only the group's columns.  Only answers reach the driver.  Quantiles
interpolate linearly between the two nearest ranks, as pandas
``median``/``describe`` and SQL ``quantile_cont``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MAX_BAND_ROWS = 200_000
COLUMNS_PER_PASS = 12


def _value(df: DataFrame, c: str):
    """The column as double, NaN as NULL."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def _inside(v, window):
    lo, hi = window
    cond = v.isNotNull()
    if lo is not None:
        cond = cond & (v > F.lit(lo))
    if hi is not None:
        cond = cond & (v < F.lit(hi))
    return cond


def _finish(df: DataFrame, state: dict, targets: list) -> dict:
    """Rank the small windows: distinct values with counts, then a running sum per target."""
    rows = F.array(*[F.when(_inside(_value(df, t[0]), state[t][0]),
                            F.struct(F.lit(i).alias("t"), _value(df, t[0]).alias("v")))
                     for i, t in enumerate(targets)])
    counted = (df.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("s"))
               .groupBy("s.t", "s.v").agg(F.count(F.lit(1)).alias("n")))
    want = F.element_at(F.array(*[F.lit(state[t][1]) for t in targets]), F.col("t") + 1)
    upto = F.sum("n").over(Window.partitionBy("t").orderBy("v"))
    hit = (counted.withColumn("u", upto).where((F.col("u") > want) & (F.col("u") - F.col("n") <= want))
           .select("t", "v").collect())
    return {targets[r["t"]]: r["v"] for r in hit}


def order_statistics(df: DataFrame, targets, counts: dict[str, int], accuracy: int = ACCURACY,
                     max_band_rows: int = MAX_BAND_ROWS, brackets: dict | None = None) -> dict:
    """Exact k-th smallest value (0-based) of each (column, k) in ``targets``.

    ``counts`` holds the non-missing values per column; ``brackets`` optionally
    gives a first (lo, hi) per target, saving one sketch pass.
    """
    # target -> [open window (lo, hi), rank inside it, rows inside it]
    state = {t: [(None, None), t[1], counts[t[0]]] for t in set(targets)}
    given, found = dict(brackets or {}), {}
    while state:
        small = sorted(t for t in state if state[t][2] <= max_band_rows and t not in given)
        if small:
            found |= _finish(df, state, small)
            for t in small:
                del state[t]
            continue
        keys = sorted(state)
        bands = {t: given.pop(t) for t in keys if t in given}
        todo = [t for t in keys if t not in bands]
        if todo:
            aggs = []
            for i, t in enumerate(todo):
                window, r, n = state[t]
                p, d = r / max(n - 1, 1), 4.0 / accuracy
                v = _value(df, t[0])
                aggs.append(F.percentile_approx(F.when(_inside(v, window), v), F.array(
                    F.lit(max(0.0, p - d)), F.lit(min(1.0, p + d))), accuracy).alias(f"s{i}"))
            row = df.agg(*aggs).first()
            bands |= {t: tuple(row[f"s{i}"]) for i, t in enumerate(todo)}
        # Neighbouring ranks of a column share their window and band: count each once.
        kinds = sorted({(t[0], state[t][0], bands[t]) for t in keys}, key=repr)
        aggs = []
        for i, (c, window, (lo, hi)) in enumerate(kinds):
            v = _value(df, c)
            inside = _inside(v, window)
            aggs += [F.count_if(inside & (v < lo)).alias(f"b{i}"), F.count_if(v == lo).alias(f"l{i}"),
                     F.count_if((v > lo) & (v < hi)).alias(f"m{i}"), F.count_if(v == hi).alias(f"h{i}")]
        row = df.agg(*aggs).first()
        for t in keys:
            window, r, n = state[t]
            lo, hi = bands[t]
            i = kinds.index((t[0], window, (lo, hi)))
            below, at_lo, mid = row[f"b{i}"], row[f"l{i}"], row[f"m{i}"]
            at_hi = row[f"h{i}"] if hi != lo else 0
            if r < below:
                state[t] = [(window[0], lo), r, below]
            elif r < below + at_lo:
                found[t] = lo
            elif r < below + at_lo + mid:
                state[t] = [(lo, hi), r - below - at_lo, mid]
            elif r < below + at_lo + mid + at_hi:
                found[t] = hi
            else:
                state[t] = [(hi, window[1]), r - below - at_lo - mid - at_hi, n - below - at_lo - mid - at_hi]
            if t in found:
                del state[t]
    return found


def quantiles(df: DataFrame, cols, probs, accuracy: int = ACCURACY,
              max_band_rows: int = MAX_BAND_ROWS):
    """Exact linear-interpolation quantiles: ({col: {p: value}}, {col: count})."""
    cols, out, counts = list(cols), {}, {}
    for at in range(0, len(cols), COLUMNS_PER_PASS):
        part = cols[at:at + COLUMNS_PER_PASS]
        q, n = _quantiles(df.select(*[F.col(f"`{c}`") for c in part]), part, probs, accuracy, max_band_rows)
        out |= q
        counts |= n
    return out, counts


def _quantiles(df, cols, probs, accuracy, max_band_rows):
    d = 4.0 / accuracy
    ps = sorted({x for q in probs for x in (max(0.0, q - d), min(1.0, q + d))})
    aggs = []
    for i, c in enumerate(cols):
        v = _value(df, c)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.percentile_approx(v, F.array(*[F.lit(p) for p in ps]), accuracy).alias(f"q{i}")]
    row = df.agg(*aggs).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    targets, plan, brackets = set(), {}, {}
    for i, c in enumerate(cols):
        n = counts[c]
        if n == 0:
            continue
        sketch = dict(zip(ps, row[f"q{i}"]))
        for q in probs:
            pos = q * (n - 1)
            k0 = math.floor(pos)
            k1 = min(k0 + 1, n - 1)
            plan[(c, q)] = (k0, k1, pos - k0)
            for k in (k0, k1):
                targets.add((c, k))
                brackets.setdefault((c, k), (sketch[max(0.0, q - d)], sketch[min(1.0, q + d)]))
    stats = order_statistics(df, targets, counts, accuracy, max_band_rows, brackets) if targets else {}
    out = {}
    for c in cols:
        out[c] = {}
        for q in probs:
            if (c, q) not in plan:
                out[c][q] = None
                continue
            k0, k1, frac = plan[(c, q)]
            a, b = stats[(c, k0)], stats[(c, k1)]
            out[c][q] = a if a == b else a + (b - a) * frac
    return out, counts


def medians(df: DataFrame, cols, **kw) -> dict[str, float | None]:
    """Exact median per column (None for an all-missing column)."""
    q, _ = quantiles(df, cols, [0.5], **kw)
    return {c: q[c][0.5] for c in cols}
