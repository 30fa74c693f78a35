"""Gap sessions: the stream equals the batch form, late flows are dropped, a restart goes on."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from netsieve.session import scratch_path
from netsieve.streaming import sessions as W

SCHEMA = "src string, dst string, ts timestamp, row_id long, a double, label string"
START = dt.datetime(2024, 1, 1)
ARGS = (["src", "dst"], "ts", "row_id", ["a"], "label")


def flow(src, seconds, i, label="BENIGN"):
    return (src, "d", START + dt.timedelta(seconds=seconds), i, float(i), label)


def plain(rows, gap, most):
    """Chunks by a loop over each key's sorted flows."""
    out = []
    for src in {r[0] for r in rows}:
        last, start, held, chunk = None, None, [], 0

        def close():
            if held:
                out.append((src, start, chunk, [r[4] for r in held], int(any(r[5] != "BENIGN" for r in held))))
        for r in sorted((r for r in rows if r[0] == src), key=lambda r: (r[2], r[3])):
            if last is None or (r[2] - last).total_seconds() > gap:
                close()
                start, held, chunk = r[2], [], 0
            last = r[2]
            held.append(r)
            if len(held) == most:
                close()
                held, chunk = [], chunk + 1
        close()
    return sorted(out, key=str)


def taken(df):
    return sorted(((r.src, r.session_start, r.chunk, [x[0] for x in r.seq], r.is_attack) for r in df.collect()), key=str)


@pytest.fixture()
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", W.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, base, batches, first=0):
    for i, rows in enumerate(batches, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/src")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/src")
        found = W.stream_session_chunks(stream, *ARGS, gap_s=30, delay="20 seconds", max_rows=4)
        q = (found.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()


def test_batch_sessions_equal_a_loop(spark):
    r = random.Random(3)
    rows = [flow(r.choice("xyz"), r.randint(0, 3000), i, r.choice(["BENIGN", "Bot"])) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert taken(W.session_chunks(df, *ARGS, gap_s=30, max_rows=4)) == plain(rows, 30, 4)
    assert W.session_chunks(df.limit(0), *ARGS, gap_s=30).count() == 0


def test_stream_equals_batch_with_late_flows_and_restarts(spark, rocksdb):
    r, base, i = random.Random(4), scratch_path(spark, "sessions"), 0
    batches = []
    for b in range(4):                 # out of order by up to 15 s inside the delay; every batch is a restart of the query
        rows = []
        for _ in range(40):
            rows.append(flow(r.choice("xyz"), 100 * b + r.randint(0, 100) + (15 if r.random() < 0.5 else 0), i,
                             r.choice(["BENIGN", "Bot"])))
            i += 1
        batches.append(rows)
    late = [flow("x", 5, 9001), flow("new", 6, 9002)]
    run(spark, base, [*batches[:3], batches[3] + late, [flow("end of stream", 100_000, 9003)]])
    on_time = [x for b in batches for x in b]
    got = taken(spark.read.parquet(f"{base}/out"))
    assert all(row[3] for row in got) and not any(9001.0 in row[3] or 9002.0 in row[3] for row in got)
    # A batch's flows that the watermark of the batches before had already passed are late, too.
    seen, kept = [], []
    for b in batches:
        mark = max((x[2] for x in seen), default=START - dt.timedelta(days=1)) - dt.timedelta(seconds=20)
        kept += [x for x in b if x[2] > mark]
        seen += b
    assert len(kept) > 0.8 * len(on_time)
    assert got == plain(kept, 30, 4)
    batch = W.session_chunks(spark.createDataFrame(kept, SCHEMA), *ARGS, gap_s=30, max_rows=4)
    assert got == taken(batch)
