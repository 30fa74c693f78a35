"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz pruning.

1. The vectors are range-partitioned by descending length and packed into
   blocks of ``BLOCK`` vectors; the queries into blocks of ``QUERY_BLOCK``.
   There are as many parts as blocks need, whatever the session's partitions.
2. The Gram matrix (d x d, a grouped sum) gives the SVD rotation: in rotated
   coordinates the first few carry most of every product.
3. The longest block alone gives each query a first k-th best score.  A query
   block then visits only the blocks whose longest vector can still reach it
   (|q| |v| >= score): a prefix of the length order.  A task gets one vector
   block with a bounded group of query blocks, so each block is sent once a group.
4. Inside a block, chunks in descending length stop at the same bound; for the
   others the partial product over the leading coordinates plus the product
   of the residual lengths bounds the full product, and only pairs at or
   above the current k-th best are multiplied out, in integers.  Where most
   pairs of a chunk are left, this is one product of matrices: 64-bit floats
   hold its integers exactly below 2^53; longer ones go pair by pair.

Every pruned pair is provably below the k-th best, so results are exact, with
ties to the smaller id.  The driver holds d x d sums and one number a block.

Defined cases: vectors that are NULL or hold a NULL, NaN or infinite
component, and NULL ids, take no part; shorter vectors count as padded with
zeros; a scaled component or a score beyond 64 bits is an error (it has no
integer to return); rows that repeat an id
are candidates each, and never of a query with that id; fewer candidates than
k give fewer ranks; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsieve.llm.storage import map_arrow, materialise, tasks

BLOCK, QUERY_BLOCK, CHUNK = 8192, 512, 256
LEADING = (8, 24)
#: Bytes of one block at most, and of the query blocks that meet a vector block in one task.
BLOCK_BYTES, GROUP_BYTES = 1 << 24, 1 << 25
#: Share of a chunk's pairs from which on they are multiplied as matrices.
DENSE = 0.05
#: Tasks of one job at most.
MOST_TASKS = 10_000
SCALE = 256


def quantised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): floor(256 x) per component; unusable rows dropped as documented."""
    ok = (F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))))
    scaled = F.transform(vec_col, lambda x: F.when(
        F.abs(x.cast("double") * SCALE) < float(1 << 63), F.floor(x.cast("double") * SCALE).cast("long")).otherwise(
        F.raise_error(F.lit("a vector component times 256 is beyond 64 bits")).cast("long")))
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    n = len(column)
    out = np.zeros((n, d), np.int64)
    offs = np.asarray(column.offsets)
    flat = np.asarray(column.values)
    size = np.diff(offs)
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], size)] = flat[offs[0]:offs[-1]]
    return out


def _gram_rows(d: int):
    def run(batches):
        g = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column(0), d).astype(np.float64)
            g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(g.ravel())], names=["i", "g"])
    return run


def _block_rows(d: int, size: int, kind: str):
    def run(batches):
        part, seq, ids, mats, held = TaskContext.get().partitionId(), 0, [], [], 0

        def pack():
            nonlocal seq
            i, m = np.concatenate(ids), np.concatenate(mats)
            top = float((m.astype(np.float64) ** 2).sum(1).max())
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([top]),
                 pa.array([i.tobytes()], pa.binary()), pa.array([m.astype(kind).tobytes()], pa.binary())],
                names=["part", "seq", "top", "ids", "m"])
            seq += 1
            return row
        for batch in batches:
            for lo in range(0, len(batch), size):
                b = batch.slice(lo, size)
                ids.append(np.asarray(b.column(0)))
                mats.append(_matrix(b.column(1), d))
                held += len(b)
                while held >= size:
                    i, m = np.concatenate(ids), np.concatenate(mats)
                    ids, mats = [i[:size]], [m[:size]]
                    yield pack()
                    ids, mats, held = [i[size:]], [m[size:]], held - size
        if held:
            yield pack()
    return run


_BLOCK_SCHEMA = "part long, seq long, top double, ids binary, m binary"


def _best(qi, vid, score, k):
    """Rows of (query, vector, score) that are among their query's k best."""
    order = np.lexsort((vid, -score, qi))
    qi, vid, score = qi[order], vid[order], score[order]
    first = np.searchsorted(qi, qi)
    keep = np.arange(len(qi)) - first < k
    return qi[keep], vid[keep], score[keep]


def _scores(a, b, reach) -> np.ndarray:
    """Integer inner products of rows, exact; ``reach`` bounds their size."""
    out = np.einsum("ij,ij->i", a, b)
    for i in np.flatnonzero(reach >= float(1 << 62)).tolist():
        exact = sum(x * y for x, y in zip(a[i].tolist(), b[i].tolist()))
        if not -(1 << 63) <= exact < 1 << 63:
            raise OverflowError("an inner product is beyond 64 bits")
        out[i] = exact
    return out


def _rotated(v: np.ndarray, rotation: np.ndarray):
    """(rotated rows, lengths, lengths of what follows the leading coordinates) of a block."""
    r = v @ rotation
    return r, np.sqrt((r ** 2).sum(1)), [np.sqrt((r[:, p:] ** 2).sum(1)) for p in LEADING]


def _scan(q, qid, v, vid, thr, rotation, k, sides=None):
    """Exact k best of one block for each query, given a lower bound of its k-th best score."""
    (rq, nq, tails_q), (rv, nv, tails_v) = sides or (_rotated(q, rotation), _rotated(v, rotation))
    reach = nq.max(initial=0) * nv.max(initial=0)
    slack, floats = 1e-9 * (1 + reach), None
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    thr = thr.copy()
    for lo in range(0, len(v), CHUNK):
        c = slice(lo, lo + CHUNK)
        live = np.flatnonzero(nq * nv[c].max() + slack >= thr)
        if not len(live):
            break
        least = thr[live, None] - slack
        (p, p2), (t, t2) = LEADING, tails_q
        left = rq[live, :p] @ rv[c, :p].T + np.outer(t[live], tails_v[0][c]) >= least
        dense = np.count_nonzero(left) > DENSE * left.size
        if dense:
            left &= rq[live, :p2] @ rv[c, :p2].T + np.outer(t2[live], tails_v[1][c]) >= least
            dense = np.count_nonzero(left) > DENSE * left.size and reach < float(1 << 52)
        if dense:
            floats = floats or (q.astype(np.float64), v.astype(np.float64))
            full = floats[0][live] @ floats[1][c].T
            left &= full >= thr[live, None]
        qi, vi = np.nonzero(left)
        score = full[qi, vi].astype(np.int64) if dense else None
        qi, vi = live[qi], vi + lo
        if dense:
            keep = qid[qi] != vid[vi]
            qi, vi, score = qi[keep], vi[keep], score[keep]
        else:
            bound = np.einsum("ij,ij->i", rq[qi, :p2], rv[vi, :p2]) + t2[qi] * tails_v[1][vi] + slack
            keep = (bound >= thr[qi]) & (qid[qi] != vid[vi])
            qi, vi = qi[keep], vi[keep]
            score = _scores(q[qi].astype(np.int64), v[vi].astype(np.int64), nq[qi] * nv[vi])
            keep = score >= thr[qi]
            qi, vi, score = qi[keep], vi[keep], score[keep]
        if not len(qi):
            continue
        best = _best(*(np.concatenate(x) for x in zip(best, (qi, vid[vi], score))), k)
        full_k = np.bincount(best[0], minlength=len(q)) == k
        last = np.searchsorted(best[0], np.arange(len(q)), "right") - 1
        thr[full_k] = np.maximum(thr[full_k], best[2][last[full_k]])
    return best


def _pair_rows(rotation: np.ndarray, k: int, kind: str):
    """The k best of one vector block for each query of the blocks that meet it here."""
    d = len(rotation)

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found, side = [_PAIRS.empty_table()], None
        for x in queries.to_pylist() if vectors.num_rows else []:
            if side is None:
                vid = np.frombuffer(vectors.column("vids")[0].as_py(), np.int64)
                v = np.frombuffer(vectors.column("vm")[0].as_py(), kind).reshape(-1, d)
                side = _rotated(v, rotation)
            qid, q = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["m"], kind).reshape(-1, d)
            thr = np.frombuffer(x["thr"], np.float64) if x["thr"] is not None else np.full(len(q), -np.inf)
            qi, vi, score = _scan(q, qid, v, vid, thr, rotation, k, (_rotated(q, rotation), side))
            found.append(pa.table([np.full(len(qi), x["qb"], np.int64), qi, qid[qi], vi, score], schema=_PAIRS))
        return pa.concat_tables(found)
    return run


_PAIRS = pa.schema([(c, pa.int64()) for c in ("qb", "qi", "query_id", "vec_id", "score")])
_PAIR_SCHEMA = "qb long, qi long, query_id long, vec_id long, score long"


def _threshold_rows(d: int, kind: str, lengths: np.ndarray):
    """Add to each query block its k-th best so far (as bytes) and how many of the blocks, longest first, can matter."""
    def run(batches):
        for batch in batches:
            thr, reach = [], []
            for x in batch.to_pylist():
                m = np.frombuffer(x["m"], kind).reshape(-1, d).astype(np.float64)
                t = np.full(len(m), -np.inf)
                for e in x["seen"] or []:
                    t[e["qi"]] = e["s"]
                norm = np.sqrt((m ** 2).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(t <= 0, 0.0, t / norm)
                thr.append(t.tobytes())
                need = float(np.min(least, initial=np.inf)) * (1 - 1e-9)
                reach.append(int(np.searchsorted(-lengths, -need, "right")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("qb", "ids", "m")), pa.array(thr, pa.binary()), pa.array(reach, pa.int64())],
                names=["qb", "ids", "m", "thr", "reach"])
    return run


def _meet(queries: DataFrame, blocks: DataFrame, groups: int, rotation: np.ndarray, k: int, kind: str) -> DataFrame:
    """(query block, query, ids, score): ``queries`` (vb, part, qb, ids, m, thr) against the vector blocks they name."""
    key = ("vb", "part")
    # Few rows of many bytes and long work: the count of tasks is given, as their bytes say little.
    pairs = queries.select(*[F.col(c).alias(c) for c in key]).distinct()
    wanted = blocks.join(pairs, "vb").repartition(groups, *key)
    return (queries.repartition(groups, *key).groupBy(*key).cogroup(wanted.groupBy(*key))
            .applyInArrow(_pair_rows(rotation, k, kind), _PAIR_SCHEMA))


def _numbered(blocks: DataFrame, number: str):
    """(``blocks`` with their place in the order of parts as ``number``, the lengths of their longest rows in that order)."""
    order = sorted(blocks.select("part", "seq", "top").collect(), key=lambda r: (r.part, r.seq))
    at = blocks.sparkSession.createDataFrame([(r.part, r.seq, i) for i, r in enumerate(order)], f"part long, seq long, {number} long")
    return blocks.join(F.broadcast(at), ["part", "seq"]).drop("part", "seq", "top"), np.sqrt([r.top for r in order])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for (id, v) integer vectors, see ``quantised``."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    largest = F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))
    most = (F.max(F.size("v")), F.max(largest), F.count(F.lit(1)))
    d, top, n = vectors.select(*most).first()
    wide, high, asked = queries.select(*most).first()
    if not d or not asked:
        return spark.createDataFrame([], empty)
    d, kind = max(d, wide), "<i4" if max(top or 0, high or 0) < 1 << 31 else "<i8"
    row = d * np.dtype(kind).itemsize + 8
    size, query_size = (max(1, min(most, BLOCK_BYTES // row)) for most in (BLOCK, QUERY_BLOCK))
    # A part is a few blocks, so few of them are not full.
    parts, query_parts = (max(1, min(tasks(spark), rows // (2 * each))) for rows, each in ((n, size), (asked, query_size)))
    gram = np.zeros(d * d)
    for i, g in map_arrow(vectors.select("v"), _gram_rows(d), "i long, g double").groupBy("i").agg(F.sum("g")).collect():
        gram[i] = g
    rotation = np.linalg.eigh(gram.reshape(d, d))[1][:, ::-1].copy()

    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    by_length = (vectors.withColumn("n", length).repartitionByRange(parts, F.desc("n"), "id")
                 .sortWithinPartitions(F.desc("n"), "id").select("id", "v"))
    blocks = materialise(map_arrow(by_length, _block_rows(d, size, kind), _BLOCK_SCHEMA), "vector-blocks")
    packed = materialise(map_arrow(queries.repartition(query_parts, "id").sortWithinPartitions("id"),
                                   _block_rows(d, query_size, kind), _BLOCK_SCHEMA), "query-blocks")
    # One number a block; of vectors in length order.
    blocks, lengths = _numbered(blocks, "vb")
    blocks = blocks.select("vb", F.col("ids").alias("vids"), F.col("m").alias("vm"))
    packed, of_queries = _numbered(packed, "qb")

    # The longest block alone first, a query block a task.
    first = packed.select(F.lit(0).cast("long").alias("vb"), F.col("qb").alias("part"), "qb", "ids", "m",
                          F.lit(None).cast("binary").alias("thr"))
    seeds = _meet(first, blocks, len(of_queries), rotation, k, kind)
    kth = (seeds.groupBy("qb", "qi").agg(F.min("score").cast("double").alias("s"), F.count(F.lit(1)).alias("c"))
           .where(F.col("c") == k).groupBy("qb").agg(F.collect_list(F.struct("qi", "s")).alias("seen")))
    bounded = materialise(map_arrow(packed.join(kth, "qb", "left").select("qb", "ids", "m", "seen"),
                                    _threshold_rows(d, kind, lengths), "qb long, ids binary, m binary, thr binary, reach long"),
                          "query-bounds")
    each = max(1, GROUP_BYTES // (query_size * row))
    grid = bounded.where("reach > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("reach") - 1)).alias("vb"),
                                             F.floor(F.col("qb") / each).alias("part"), "qb", "ids", "m", "thr")
    found = _meet(grid, blocks, min(len(lengths) * -(-len(of_queries) // each), MOST_TASKS), rotation, k, kind)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
