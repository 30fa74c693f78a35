"""Streaming scorer (bad messages, restart, replay) and CSV folder ingest."""

import gzip
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve.session import scratch_path
from netsieve.sources import csv_files
from netsieve.sources.csv_files import file_status, load_report, load_status, missing_files, read_flow_csvs
from netsieve.streaming import messages as MSG
from netsieve.streaming import scoring as SC

from conftest import SF_SMALL


def _batch(spark, rows):
    return spark.createDataFrame(rows, MSG.TRANSPORT)


def _msg(feats, meta=True):
    import json
    body = {"features": feats}
    if meta:
        body["metadata"] = {"src_ip": "1.1.1.1", "dst_ip": "2.2.2.2", "protocol": "TCP",
                            "length": 100, "timestamp": "10:00:00"}
    return json.dumps(body)


def test_validate_reasons(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    good = [0.0] * MSG.N_FEATURES
    df = _batch(spark, [(1, t, "{bad"), (2, t, _msg(good[:-1])), (3, t, _msg(good)),
                        (4, t, _msg(good, meta=False))])
    got = {r["row_id"]: r["reject_reason"] for r in MSG.validate(MSG.parse(df)).collect()}
    assert got == {1: "json", 2: "length", 3: None, 4: None}


def test_sink_replay_is_idempotent_and_state_folds(spark):
    import datetime as dt
    out = scratch_path(spark, "sink-test")
    sink = SC.ScoringSink(out, SC.rule_model())
    hi = [0.0] * MSG.N_FEATURES
    hi[SC.RULE_IAT_INDEX - 1] = 500.0
    t = dt.datetime(2024, 1, 1)
    b0 = _batch(spark, [(i, t + dt.timedelta(seconds=i), _msg(hi if i % 2 else [0.0] * 9))
                        for i in range(30)])
    b1 = _batch(spark, [(100 + i, t + dt.timedelta(hours=1, seconds=i), _msg([0.0] * 9, i != 0))
                        for i in range(40)] + [(999, t, "{bad")])
    sink(b0, 0)
    sink(b1, 1)
    c1 = SC.latest_state(spark, out, "counters").first().asDict()
    log1 = [r["row_id"] for r in SC.latest_state(spark, out, "last50").collect()]
    sink(b1, 1)  # replayed batch
    c2 = SC.latest_state(spark, out, "counters").first().asDict()
    log2 = [r["row_id"] for r in SC.latest_state(spark, out, "last50").collect()]
    assert c1 == c2 == {"total": 70, "malicious": 15, "benign": 55, "suspicious": 0}
    assert sorted(log1) == sorted(log2) and len(log1) == 50
    assert 100 not in log1  # no metadata: scored but not listed
    rej = SC.all_batches(spark, out, "rejects").collect()
    assert [(r["row_id"], r["reason"]) for r in rej] == [(999, "json")]


def test_stream_restart_continues_counters(spark):
    base = scratch_path(spark, "stream-test")
    msgs = MSG.message_table(spark, SF_SMALL).repartitionByRange(4, "row_id")
    src = f"{base}/src"
    msgs.where("row_id < 600").write.parquet(src)
    q = SC.run(MSG.read_stream(spark, src), f"{base}/out", f"{base}/ckpt")
    prog = SC.progress_log(spark, q).collect()
    assert len(prog) >= 4 and sum(r["input_rows"] for r in prog) == 600
    first = SC.latest_state(spark, f"{base}/out", "counters").first()["total"]
    msgs.where("row_id >= 600").write.mode("append").parquet(src)
    SC.run(MSG.read_stream(spark, src), f"{base}/out", f"{base}/ckpt")
    second = SC.latest_state(spark, f"{base}/out", "counters").first()["total"]
    valid = msgs.where(~F.col("value").startswith("{bad")).count()
    rejects = SC.all_batches(spark, f"{base}/out", "rejects").count()
    assert first < second
    assert second + rejects == msgs.count()
    assert second <= valid


def test_csv_ingest_special_values_and_corrupt_file(spark):
    d = tempfile.mkdtemp(prefix="netsieve-csv-")
    with open(os.path.join(d, "Monday-a.csv"), "w") as f:
        f.write(" Flow Duration, Rate ,Label\n1,Infinity,BENIGN\n2,NaN,DDoS\n3,,BENIGN\n")
    with open(os.path.join(d, "Tuesday-b.csv"), "w") as f:
        f.write(" Flow Duration, Rate ,Label\n4,1.5,Bot\nnot-a-number,2.0,Bot\n")
    with open(os.path.join(d, "Wednesday-c.csv.gz"), "wb") as f:
        f.write(b"this is not gzip data")
    schema = T.StructType([T.StructField(" Flow Duration", T.LongType()),
                           T.StructField(" Rate ", T.DoubleType()),
                           T.StructField("Label", T.StringType())])
    df = read_flow_csvs(spark, d, schema).cache()
    rows = {r["row_id"]: r for r in df.collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]
    assert rows[0]["Rate"] == float("inf") and rows[1]["Rate"] != rows[1]["Rate"]
    assert rows[2]["Rate"] is None
    assert rows[0]["day"] == "Monday" and rows[3]["source_file"] == "Tuesday-b.csv"
    rep = {r["source_file"]: (r["n_rows"], r["n_malformed"]) for r in load_report(df).collect()}
    assert rep["Tuesday-b.csv"] == (2, 1) and rep[None] == (5, 1)
    assert missing_files(spark, d, df) == ["Wednesday-c.csv.gz"]
    # sanity: gzip module agrees the file is unreadable
    try:
        gzip.open(os.path.join(d, "Wednesday-c.csv.gz")).read()
        raise AssertionError("expected a corrupt file")
    except OSError:
        pass


def test_event_time_sequences_stream_matches_batch(spark):
    from netsieve.operators.sequence import event_time_sequences
    from netsieve.sources.flows import FEATURES, flows
    base = scratch_path(spark, "w7-stream")
    f = flows(spark, SF_SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    n = f.count()
    for i in range(4):  # one file per write, in time order (the source orders by mtime)
        f.where((F.col("row_id") >= i * n // 4) & (F.col("row_id") < (i + 1) * n // 4)) \
            .coalesce(1).write.mode("append").parquet(f"{base}/src")
    stream = (spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{base}/src").withWatermark("ts", "1 hour"))
    seqs = event_time_sequences(stream, ["src_ip"], "ts", FEATURES, "label", "1 day", "row_id")
    q = (seqs.select("src_ip", "window_start", "n_rows", "is_attack").writeStream
         .outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["src_ip"], r["window_start"]): (r["n_rows"], r["is_attack"])
           for r in spark.read.parquet(f"{base}/out").collect()}
    batch = {(r["src_ip"], r["window_start"]): (r["n_rows"], r["is_attack"])
             for r in event_time_sequences(f, ["src_ip"], "ts", FEATURES, "label", "1 day",
                                           "row_id").collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_state_store_counters_equal_folded_counters(spark):
    from netsieve.plans.seq_metric_queries import message_files, stream_run
    path = message_files(spark, SF_SMALL)
    base = scratch_path(spark, "counters-complete")
    agg = SC.counters_stream(SC.scored_stream(MSG.read_stream(spark, path)))
    q = (agg.writeStream.outputMode("complete")
         .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/c"))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    state_store = spark.read.parquet(f"{base}/c").first().asDict()
    folded = SC.latest_state(spark, stream_run(spark, SF_SMALL), "counters").first().asDict()
    for k in ("total", "malicious", "benign", "suspicious"):
        assert state_store[k] == folded[k]
    assert state_store["threat_level"] in ("CRITICAL", "NOMINAL")


def test_latest_state_before_any_batch_is_empty(spark):
    out = scratch_path(spark, "no-batches")
    assert SC.latest_state(spark, out, "counters").count() == 0
    assert SC.latest_state(spark, out, "last50").columns[0] == "row_id"


def test_null_nan_and_infinite_elements_are_dead_letters(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    good = [0.0] * MSG.N_FEATURES
    holed = _msg(good).replace("[0.0", "[null", 1)
    df = _batch(spark, [(1, t, holed), (2, t, _msg(good)), (3, t, _msg(good).replace("[0.0", "[1e999", 1))])
    got = {r["row_id"]: r["reject_reason"] for r in MSG.validate(MSG.parse(df)).collect()}
    assert got == {1: "value", 2: None, 3: "value"}


def test_trained_model_survives_bad_values_and_a_restart(spark):
    from netsieve.operators import models as ML
    cols = [f"f{i}" for i in range(MSG.N_FEATURES)]
    rows = [(float(i % 7), *[float(i % 3)] * (len(cols) - 1), "Bot" if i % 2 else "BENIGN") for i in range(40)]
    train = spark.createDataFrame(rows, cols + ["label"])
    model, _ = ML.fit(ML.random_forest(cols, num_trees=2, max_depth=3), train, cols)
    base = scratch_path(spark, "stream-model")
    msgs = MSG.message_table(spark, SF_SMALL).repartitionByRange(6, "row_id")
    msgs.where("row_id < 500").write.parquet(f"{base}/src")
    SC.run(MSG.read_stream(spark, f"{base}/src"), f"{base}/out", f"{base}/ckpt", model)
    msgs.where("row_id >= 500").write.mode("append").parquet(f"{base}/src")
    SC.run(MSG.read_stream(spark, f"{base}/src"), f"{base}/out", f"{base}/ckpt", model)
    bad = SC.all_batches(spark, f"{base}/out", "rejects")
    assert {r["reason"] for r in bad.select("reason").distinct().collect()} == {"json", "length", "value"}
    total = SC.latest_state(spark, f"{base}/out", "counters").first()["total"]
    assert total + bad.count() == msgs.count()
    assert len(SC._batches(spark, f"{base}/out/state")) <= SC.KEEP_STATES


def test_csv_columns_match_by_name_and_cut_files_are_dropped(spark):
    d = tempfile.mkdtemp(prefix="netsieve-csv-")
    with open(os.path.join(d, "Monday-a.csv"), "w") as f:
        f.write("A,B,Label\n1,10,x\n2,20,y\n")
    with open(os.path.join(d, "Tuesday-b.csv"), "w") as f:
        f.write("Label, B ,A\nz,30,3\n")
    with open(os.path.join(d, "Wednesday-c.csv"), "w") as f:
        f.write("B\n40\n")
    whole = gzip.compress(("A,B,Label\n" + "".join(f"{i},{i * 7919 % 1009},w\n" for i in range(20000))).encode())
    with open(os.path.join(d, "Thursday-d.csv.gz"), "wb") as f:
        f.write(whole[:len(whole) // 2])
    schema = T.StructType([T.StructField("A", T.LongType()), T.StructField("B", T.LongType()),
                           T.StructField("Label", T.StringType())])
    df = read_flow_csvs(spark, d, schema).cache()
    assert sorted((r["row_id"], r["A"], r["B"], r["Label"]) for r in df.collect()) == [
        (0, 1, 10, "x"), (1, 2, 20, "y"), (2, 3, 30, "z"), (3, None, 40, None)]
    assert missing_files(spark, d, df) == ["Thursday-d.csv.gz"]
    with open(os.path.join(d, "Friday-e.csv"), "w") as f:
        f.write("A,What\n1,2\n")
    try:
        read_flow_csvs(spark, d, schema)
        raise AssertionError("an unknown column must be an error")
    except ValueError as e:
        assert "What" in str(e)


def test_file_status_streams_every_kind_of_file(spark, monkeypatch):
    monkeypatch.setattr(csv_files, "PIECE", 64)
    d = tempfile.mkdtemp(prefix="netsieve-csv-")
    body = "A, B \n" + "".join(f"{i},{i * 7919 % 1009}\n" for i in range(500))
    packed = gzip.compress(body.encode())
    files = {"a.csv": b"A, B \n1,2\n", "b.csv": b"", "c.csv": b"\xff\xfe\n", "d.csv": b"x" * 200, "e%20+f.csv": b"\xef\xbb\xbfA,B\r\n",
             "g.csv.gz": packed, "h.csv.gz": packed + gzip.compress(b"9,9\n" * 50), "i.csv.gz": packed[:-9], "j.csv.gz": b"junk",
             "k.csv.gz": gzip.compress(b"A,B\n" + b"1,1\n" * 16), "l.csv.gz": b"", "m.csv.gz": gzip.compress(b"A,B\n" + b"0" * 10 ** 6)}
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    for name, data in files.items():
        header, size, problem = csv_files._inspect("file:" + os.path.join(d, name))
        assert size == len(data), name
        wanted = {"b": "empty", "c": "header is not UTF-8", "d": "no header line", "i": "cut short", "j": "not gzip data", "l": "cut short"}
        assert problem == wanted.get(name[0]) and (header is None) == (problem is not None), name
        assert header is None or [c.strip() for c in header] == ["A", "B"], name
    assert csv_files._inspect(os.path.join(d, "none.csv"))[2] is not None
    monkeypatch.undo()
    got = {os.path.basename(r.file): r.problem for r in file_status(spark, d).collect()}
    assert set(got) == set(files) and got["i.csv.gz"] == "cut short" and got["m.csv.gz"] is None
    assert file_status(spark, tempfile.mkdtemp(prefix="netsieve-csv-")).count() == 0


def test_load_status_keeps_unreadable_sources(spark):
    d = tempfile.mkdtemp(prefix="netsieve-csv-")
    for name, text in (("Monday-a.csv", "A,B\n1,2\nx,3\n"), ("Tuesday-b.csv", "A\n4\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    with open(os.path.join(d, "Friday-c.csv.gz"), "wb") as f:
        f.write(gzip.compress(b"A,B\n5,6\n")[:-4])
    schema = T.StructType([T.StructField("A", T.LongType()), T.StructField("B", T.LongType())])
    rows = load_status(spark, d, read_flow_csvs(spark, d, schema)).collect()
    assert sorted(tuple(r) for r in rows if r.n_columns) == [("Monday-a.csv", 2, 0, 2, 1), ("Tuesday-b.csv", 1, 0, 1, 0)]
    assert [tuple(r) for r in rows if not r.n_columns] == [("Friday-c.csv.gz", None, 1, 0, 0)]
