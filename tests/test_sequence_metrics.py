"""Sequences, metrics, history, row index."""

from pyspark.sql import functions as F

from netsieve.operators import metrics as M
from netsieve.operators import sequence as Q
from netsieve.operators.history import early_stopping
from netsieve.operators.rowindex import with_row_index


def _rows(spark, n, label=lambda i: "BENIGN"):
    return spark.createDataFrame([(i, float(i), label(i)) for i in range(n)],
                                 "row_id long, x double, label string")


def test_tumbling_partial_last_sequence(spark):
    out = Q.tumbling_sequences(_rows(spark, 23), "row_id", ["x"], "label", 10).collect()
    assert len(out) == 2
    assert [v[0] for v in sorted(out, key=lambda r: r["sequence_id"])[1]["seq"]] == \
        [float(i) for i in range(10, 20)]


def test_majority_tie_goes_to_smallest(spark):
    labs = ["2", "1", "2", "1"]
    df = _rows(spark, 4, lambda i: labs[i])
    out = Q.tumbling_sequences(df, "row_id", ["x"], "label", 4).first()
    assert out["label"] == "1"


def test_sliding_window_counts(spark):
    assert Q.sliding_sequences(_rows(spark, 7), "row_id", ["x"], "label", 5).count() == 3
    assert Q.sliding_sequences(_rows(spark, 4), "row_id", ["x"], "label", 5).count() == 0
    df = _rows(spark, 7, lambda i: "DDoS" if i == 6 else "BENIGN")
    got = {r["start"]: r["is_attack"] for r in
           Q.sliding_sequences(df, "row_id", ["x"], "label", 5).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_metrics_absent_classes(spark):
    df = spark.createDataFrame([("Bot", "BENIGN"), ("BENIGN", "BENIGN"), ("BENIGN", "X")],
                               "label string, prediction string")
    pc = {r["class"]: r for r in M.per_class(df).collect()}
    assert pc["Bot"]["precision"] == 0.0 and pc["Bot"]["recall"] == 0.0 and pc["Bot"]["f1"] == 0.0
    assert pc["X"]["recall"] == 0.0 and pc["X"]["support"] == 0
    mac = M.macro(df).first()
    assert abs(mac["macro_recall"] - round((0 + 0.5 + 0) / 3, 6)) < 1e-9
    cm = M.confusion(df).agg(F.sum("n")).first()[0]
    assert cm == 3


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    r = M.binary(df, "y", "p").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1)
    assert r["precision"] == 0.5 and r["accuracy"] == 0.5


def test_report_rows(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, prediction string")
    names = {r["class"] for r in M.report(df).collect()}
    assert names == {"a", "b", "accuracy", "macro avg", "weighted avg"}


def test_early_stopping_sequential_rule(spark):
    ms = [0.5, 0.6, 0.6000005, 0.6000012, 0.59, 0.58, 0.57, 0.56, 0.55, 0.9]
    hist = spark.createDataFrame([("r", i, m) for i, m in enumerate(ms)],
                                 "run string, epoch long, metric double")
    out = {r["epoch"]: r for r in early_stopping(hist, patience=5).collect()}
    # 0.6000012 improves on the *recorded* best 0.6 (not on the running max 0.6000005)
    assert out[3]["improved"] == 1 and out[2]["improved"] == 0
    assert out[8]["stopped"] == 1 and 9 not in out
    assert out[3]["is_best"] == 1


def test_row_index_dense_in_order(spark):
    df = spark.createDataFrame([(f"f{i % 3}", i) for i in range(500)], "f string, pos long")
    out = with_row_index(df, ["f", "pos"], "rid", num_partitions=5)
    got = [(r["f"], r["pos"]) for r in out.orderBy("rid").collect()]
    assert got == sorted((f"f{i % 3}", i) for i in range(500))
    assert [r["rid"] for r in out.orderBy("rid").collect()] == list(range(500))


def test_sliding_blocks_match_small_block_size(spark):
    df = _rows(spark, 53, lambda i: "DDoS" if i % 9 == 0 else "BENIGN")
    big = {r["start"]: (r["is_attack"], [v[0] for v in r["seq"]]) for r in
           Q.sliding_sequences(df, "row_id", ["x"], "label", 5).collect()}
    small = {r["start"]: (r["is_attack"], [v[0] for v in r["seq"]]) for r in
             Q.sliding_sequences(df, "row_id", ["x"], "label", 5, block_rows=7).collect()}
    assert big == small and len(big) == 49
    assert big[0][1] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_windows_on_an_index_with_gaps_do_not_depend_on_blocks(spark):
    df = _rows(spark, 40).where("row_id % 3 <> 1")
    n = df.count()
    one = [r["start"] for r in Q.sliding_sequences(df, "row_id", ["x"], "label", 5).orderBy("start").collect()]
    many = [r["start"] for r in Q.sliding_sequences(df, "row_id", ["x"], "label", 5, block_rows=8).orderBy("start").collect()]
    assert one == many and len(one) == n - 4
    assert Q.tumbling_sequences(df, "row_id", ["x"], "label", 5).count() == n // 5
