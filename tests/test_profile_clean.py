"""Profile and cleaning edge cases (NaN / inf / NULL, constants, medians)."""

import math

import numpy as np
from pyspark.sql import functions as F

from netsieve.functions.columns import feature_groups, strip_column_names
from netsieve.operators import clean as C
from netsieve.operators import profile as P
from netsieve.operators import quantiles as Q


def _vals(spark, values, name="v"):
    return spark.createDataFrame([(float(x) if x is not None else None,) for x in values],
                                 f"{name} double")


def test_missing_values_in_statistics(spark):
    df = C.normalize_missing(_vals(spark, [1, 2, float("nan"), float("inf"), None]),
                             inf_to_null=True)
    assert P.distinct_counts(df, ["v"]).first()["n_distinct"] == 2
    assert Q.medians(df, ["v"])["v"] == 1.5
    assert P.missing_counts(df, ["v"]).first()["n_missing"] == 3


def test_constant_and_all_missing_columns(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None), (float("nan"), None)],
                               "a double, b double")
    zero = {r["feature"] for r in P.zero_variance_columns(df, ["a", "b"]).collect()}
    const = {r["feature"] for r in P.constant_columns(df, ["a", "b"]).collect()}
    assert zero == {"a"}
    assert const == {"a", "b"}
    out, dropped = P.drop_zero_variance(df, ["a", "b"])
    assert dropped == ["a"] and out.columns == ["b"]


def test_inf_counts_only_columns_with_inf(spark):
    df = spark.createDataFrame([(1.0, float("-inf")), (float("inf"), 2.0), (3.0, 4.0)],
                               "a double, b double")
    got = {r["feature"]: r["n_inf"] for r in P.inf_counts(df).collect()}
    assert got == {"a": 1, "b": 1}


def test_exact_quantiles_match_numpy_on_iterative_path(spark):
    rng = np.random.default_rng(7)
    xs = rng.normal(size=4000).round(3)  # duplicates on purpose
    df = spark.createDataFrame([(float(x), float(x) * 2) for x in xs], "a double, b double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    # a tiny band budget and a coarse sketch force the narrowing loop
    got, counts = Q.quantiles(df, ["a", "b"], probs, accuracy=50, max_band_rows=40)
    assert counts == {"a": 4000, "b": 4000}
    for p in probs:
        assert math.isclose(got["a"][p], float(np.quantile(xs, p)), abs_tol=1e-9)
        assert math.isclose(got["b"][p], float(np.quantile(xs * 2, p)), abs_tol=1e-9)


def test_median_of_int_column_interpolates(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x bigint")
    assert Q.medians(df, ["x"])["x"] == 2.5


def test_fill_median_fit_on_subset(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (None, "test"), (100.0, "test")],
                               "x double, split string")
    out, meds = C.fill_median(df, ["x"], fit_on=df.where("split = 'train'"))
    assert meds["x"] == 2.0
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 3.0, 100.0]


def test_zero_fill_and_clip(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (5e6,), (-5e6,)], "x double")
    out = C.clip_columns(C.fill_zero(df, ["x"]), ["x"], -1e6, 1e6)
    assert sorted(r["x"] for r in out.collect()) == [-1e6, 0.0, 0.0, 1e6]


def test_dirty_headers_strip_and_collide(spark):
    df = spark.createDataFrame([(1, "a")], "` Flow Duration` int, ` Label ` string")
    assert strip_column_names(df).columns == ["Flow Duration", "Label"]
    bad = spark.createDataFrame([(1, 2)], "` x` int, `x ` int")
    try:
        strip_column_names(bad)
        raise AssertionError("collision not detected")
    except ValueError:
        pass


def test_duplicate_columns_and_correlation(spark):
    rows = [(i, float(i), float(i), float(i % 7), float(i) * 3 + (i % 5) * 2.0)
            for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double")
    dup = {r["feature"]: r["duplicate_of"] for r in
           P.duplicate_columns(df, ["a", "b", "c", "d"]).collect()}
    assert dup == {"b": "a"}
    pairs = {(r["feature_a"], r["feature_b"]) for r in
             P.high_corr_pairs(df, ["a", "b", "c", "d"]).collect()}
    # a == b exactly (r = 1) is excluded; d is nearly a line in a
    assert ("a", "b") not in pairs and ("a", "d") in pairs and ("d", "a") in pairs


def test_correlation_with_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(10)], "a double, k double")
    assert P.correlation_pairs(df, ["a", "k"]).first()["corr"] is None


def test_feature_groups():
    cols = ["Total Fwd Packets", "Bwd PSH Flags", "Fwd IAT Mean", "Flow Duration"]
    assert feature_groups(cols) == [("Packet", "Total Fwd Packets"), ("Flag", "Bwd PSH Flags"),
                                    ("IAT", "Fwd IAT Mean")]


def test_first_row_per_label(spark):
    df = spark.createDataFrame([(3, "b", 1), (1, "a", 2), (2, "b", 3), (0, "c", 4)],
                               "row_id long, label string, x long")
    got = [(r["label"], r["row_id"]) for r in
           P.first_row_per_label(df, "label", "row_id", ["x"], 2).collect()]
    assert got == [("c", 0), ("a", 1)]


def test_distinct_counts_approximate_path(spark):
    df = spark.range(5000).select((F.col("id") % 1000).cast("double").alias("x"))
    exact = P.distinct_counts(df, ["x"]).first()["n_distinct"]
    approx = P.distinct_counts(df, ["x"], exact=False).first()["n_distinct"]
    assert exact == 1000 and abs(approx - 1000) <= 150  # 3 x the default 5 % rsd


def test_quantiles_end_on_ties_and_constants(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(0.0 if i % 10 else float(rng.integers(1, 50)), 7, float(i % 2), int(2 ** 53 + 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "z double, c int, two double, big bigint")
    probs = [0.1, 0.25, 0.5, 0.9, 0.99]
    got, n = Q.quantiles(df, ["z", "c", "two"], probs, accuracy=50, max_band_rows=5)
    for i, c in enumerate(["z", "c", "two"]):
        xs = np.array([r[i] for r in rows], float)
        for p in probs:
            assert math.isclose(got[c][p], float(np.quantile(xs, p)), abs_tol=1e-9), (c, p)
    out, meds = C.fill_median(df)
    assert meds == {} and dict(out.dtypes)["big"] == "bigint" and out.first()["big"] == 2 ** 53 + 1


def test_duplicate_columns_compare_whole_numbers_exactly(spark):
    df = spark.createDataFrame([(1, 2 ** 53, 2 ** 53 + 1, 5), (2, 3, 3, 5)], "row_id long, a long, b long, c long")
    assert P.duplicate_columns(df, ["a", "b", "c"]).count() == 0


def test_value_ranges_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert P.value_ranges(df, ["x"]).first()["max_value"] == 3.0
