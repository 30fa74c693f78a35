"""Gap sessions of flows per entity, cut into bounded chunks: on a stream with state and timers, and on a table.

An entity's flows in (time, order) order belong to one session while each
follows the one before by at most ``gap``; a session is emitted in chunks of at
most ``max_rows`` flows.

On the stream entities are dealt to a fixed number of buckets by a hash.  A
bucket's state is one value: for each of its entities the open session and the
flows that are not emitted yet, so a micro-batch reads and writes state once a
bucket, not once an entity.  A chunk leaves as soon as it is full; a timer at
the earliest last flow plus the gap closes that session and emits the rest, so
an entity has at most one chunk and the flows inside the watermark delay in
state.  Flows behind the watermark are dropped.  The batch form gives the same
rows for the flows that were not late.

Defined cases: flows without a time are dropped; NULL keys and labels are
keys and attacks like others (a NULL label is no attack); flows equal in time
and order may swap places.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netsieve.functions.expressions import is_attack

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "entities binary, due long"
#: Buckets of entities unless said otherwise; a stream keeps its number.
BUCKETS = 1024


def _flows(df: DataFrame, key_cols, ts_col: str, order_col: str, feature_cols, label_col: str, benign: str) -> DataFrame:
    """Keys, time in microseconds, order, features, attack flag."""
    return df.where(F.col(ts_col).isNotNull()).select(
        *key_cols, F.col(ts_col), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("t"), F.col(order_col).cast("long").alias("o"),
        F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("x"),
        F.coalesce(is_attack(label_col, benign), F.lit(0)).cast("int").alias("y"))


def session_chunks(df: DataFrame, key_cols, ts_col: str, order_col: str, feature_cols, label_col: str, gap_s: int,
                   max_rows: int = 1000, benign: str = "BENIGN") -> DataFrame:
    """Batch form: (keys, session_start, chunk, n_rows, seq, is_attack).

    Sessions and positions are running sums over an entity's flows, which
    spill; rows are gathered only per chunk.
    """
    f = _flows(df, key_cols, ts_col, order_col, feature_cols, label_col, benign).drop(ts_col)
    w = Window.partitionBy(*key_cols).orderBy("t", "o")
    f = f.withColumn("_new", F.when(F.col("t") - F.lag("t").over(w) <= gap_s * 1_000_000, 0).otherwise(1))
    f = f.withColumn("_at", F.row_number().over(w)).withColumn("_session", F.sum("_new").over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.max(F.when(F.col("_new") == 1, F.struct("_at", "t"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    f = f.withColumn("_first", first).withColumn("chunk", F.floor((F.col("_at") - F.col("_first._at")) / max_rows).cast("long"))
    return (f.groupBy(*key_cols, F.col("_first.t").alias("_start"), "_session", "chunk")
            .agg(F.sort_array(F.collect_list(F.struct("t", "o", "x"))).alias("rows"), F.max("y").alias("is_attack"),
                 F.count(F.lit(1)).alias("n_rows"))
            .select(*key_cols, F.timestamp_micros("_start").alias("session_start"), "chunk", "n_rows",
                    F.transform("rows", lambda r: r["x"]).alias("seq"), "is_attack"))


class _Sessions(StatefulProcessor):
    """State of a bucket: {entity: (open session as (start, last, chunk) or None, its flows not emitted)}."""

    def __init__(self, key_names: list[str], gap_us: int, max_rows: int):
        self.key_names, self.gap, self.max_rows = key_names, gap_us, max_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entities, due = self._read()
        for part in rows:
            for *k, t, o, x, y in zip(*(part[n] for n in self.key_names), part.t, part.o, part.x, part.y):
                k = tuple(v if isinstance(v, str) else None for v in k)
                entities.setdefault(k, (None, []))[1].append((int(t), int(o) if pd.notna(o) else None, x.tolist(), int(y)))
        yield from self._settle(entities, due, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(*self._read(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _read(self) -> tuple[dict, int]:
        found = self.bucket.get() if self.bucket.exists() else None
        return ({}, 0) if found is None else (pickle.loads(bytes(found[0])), found[1])

    def _settle(self, entities: dict, due: int, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Emit what the watermark has made final; no flow at or before it can still come."""
        out, left, next_due = [], {}, None
        for k, (state, waiting) in entities.items():
            state, waiting = self._entity(k, state, waiting, watermark_ms * 1000, out)
            if state is not None or waiting:
                left[k] = state, waiting
                latest = max([r[0] for r in waiting[-1:]] + ([state[1]] if state else []))
                next_due = latest if next_due is None else min(next_due, latest)
        if left:
            next_due = (next_due + self.gap) // 1000 + 1
            if next_due != due:
                self.handle.registerTimer(next_due)
            self.bucket.update((pickle.dumps(left, 5), next_due))
        elif entities:
            self.bucket.clear()
        if out:
            keys = zip(*(k for k, *_ in out))
            yield pd.DataFrame({
                **dict(zip(self.key_names, keys)),
                "session_start": [pd.Timestamp(s, unit="us", tz="UTC").tz_localize(None) for _, s, _, _ in out],
                "chunk": [c for _, _, c, _ in out], "n_rows": [len(h) for *_, h in out],
                "seq": [[r[2] for r in h] for *_, h in out], "is_attack": [max(r[3] for r in h) for *_, h in out]})

    def _entity(self, k: tuple, state: tuple | None, waiting: list, passed: int, out: list) -> tuple[tuple | None, list]:
        """Chunks of one entity go to ``out``; its open session and the flows that stay, in order."""
        rows = sorted(waiting, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        held, rest = [], []

        def emit():
            nonlocal held, state
            out.append((k, state[0], state[2], held))
            state, held = (state[0], state[1], state[2] + 1), []

        for i, r in enumerate(rows):
            # Flows held back from an earlier call come first again: their session is the open one.
            if r[0] > passed:
                rest = rows[i:]
                break
            if state is not None and r[0] - state[1] > self.gap:
                if held:
                    emit()
                state = None
            state = (r[0], r[0], 0) if state is None else (state[0], max(state[1], r[0]), state[2])
            held.append(r)
            if len(held) == self.max_rows:
                emit()
        if state is not None and passed >= state[1] + self.gap:
            if held:
                emit()
            state, held = None, []
        return state, held + rest


def stream_session_chunks(stream: DataFrame, key_cols, ts_col: str, order_col: str, feature_cols, label_col: str, gap_s: int,
                          delay: str, max_rows: int = 1000, benign: str = "BENIGN", buckets: int = BUCKETS) -> DataFrame:
    """Stream form of ``session_chunks``; ``delay`` is how far behind the latest flow a late one may come.

    A bucket is worked on at once: ``buckets`` should grow with the entities of a stream and must stay the same over its
    restarts.  The session must use the RocksDB state store (``ROCKSDB``).
    """
    f = _flows(stream.withWatermark(ts_col, delay), key_cols, ts_col, order_col, feature_cols, label_col, benign)
    kinds = {c: f.schema[c].dataType for c in key_cols}
    f = f.withColumn("_bucket", F.pmod(F.xxhash64(*key_cols), F.lit(buckets))).withColumns(
        {c: F.col(c).cast("string") for c in key_cols})
    keys = [T.StructField(c, T.StringType()) for c in key_cols]
    schema = T.StructType([*keys, T.StructField("session_start", T.TimestampType()), T.StructField("chunk", T.LongType()),
                           T.StructField("n_rows", T.LongType()),
                           T.StructField("seq", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("is_attack", T.IntegerType())])
    found = f.groupBy("_bucket").transformWithStateInPandas(
        _Sessions(list(key_cols), gap_s * 1_000_000, max_rows), schema, "Append", "EventTime")
    return found.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
