"""Splits, samples and feature transforms: exactness and invariants."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from netsieve.functions.expressions import is_attack
from netsieve.functions.hashing import hash_key
from netsieve.operators import features as X
from netsieve.operators import split as S
from netsieve.operators.ranking import hash_rank


def _skewed(spark, n=3000):
    # one class holds most rows, one class has a single row
    rows = [(i, "BENIGN" if i % 10 < 8 else ("DDoS" if i % 10 == 8 else "Bot")) for i in range(n)]
    rows.append((n, "Rare"))
    return spark.createDataFrame(rows, "row_id long, label string")


def test_hash_rank_equals_global_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("label").orderBy(hash_key("row_id"), "row_id")
    ref = {r["row_id"]: r["rk"] for r in
           df.select("row_id", (F.row_number().over(w) - 1).alias("rk")).collect()}
    got = {r["row_id"]: r["_rank"] for r in hash_rank(df, "row_id", ["label"], digits=2).collect()}
    assert got == ref


def test_stratified_split_exact_and_disjoint(spark):
    df = _skewed(spark)
    out = S.stratified_split(df, "label", "row_id", (("test", 0.2),)).cache()
    assert out.count() == df.count()
    counts = {(r["label"], r["split"]): r["n"] for r in
              out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert counts[("BENIGN", "test")] == 480   # ceil(2400 * 0.2)
    assert counts[("Rare", "test")] == 1       # one-row class goes to test (ceil)
    assert ("Rare", "train") not in counts


def test_three_way_split_sizes(spark):
    df = _skewed(spark)
    out = S.stratified_split(df, "label", "row_id", (("holdout", 0.1), ("test", 0.2)))
    c = {(r["label"], r["split"]): r["n"] for r in
         out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert c[("BENIGN", "holdout")] == 240 and c[("BENIGN", "test")] == 432


def test_kfold_balanced(spark):
    out = S.kfold(_skewed(spark), "label", "row_id", 3)
    sizes = [r["n"] for r in out.where("label = 'BENIGN'").groupBy("fold").count()
             .withColumnRenamed("count", "n").collect()]
    assert sorted(sizes) == [800, 800, 800]


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(1000).withColumn("g", F.floor(F.col("id") / 10))
    out = S.group_split(df, "g", 0.2)
    per_group = out.groupBy("g").agg(F.countDistinct("split").alias("k"))
    assert per_group.where("k > 1").count() == 0
    assert out.where("split = 'test'").select("g").distinct().count() == 20


def test_random_split_floor(spark):
    out = S.random_split(spark.range(1005).withColumnRenamed("id", "row_id"), "row_id", 0.1)
    assert out.where("split = 'val'").count() == 100


def test_downsample_and_oversample(spark):
    df = _skewed(spark)
    d = S.downsample_class(df, "label", "row_id", "BENIGN", 0.15)
    assert d.where("label = 'BENIGN'").count() == 360
    assert d.where("label <> 'BENIGN'").count() == df.where("label <> 'BENIGN'").count()
    o = S.oversample_balanced(df, "label", "row_id")
    # expected copies of the single 'Rare' row = n / (k * 1) = 3001 / 4
    assert abs(o.where("label = 'Rare'").count() - 3001 / 4) <= 1
    assert abs(o.count() - df.count()) < 0.05 * df.count()


def test_labels_missing_and_class_counts(spark):
    tr = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    te = spark.createDataFrame([("a",)], "label string")
    assert sorted(r[0] for r in S.labels_missing(tr, te, "label").collect()) == ["b", "c"]


def test_standard_and_minmax_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    s, params = X.standard_scale(df, ["x", "k"])
    assert sorted(r["x"] for r in s.collect()) == [-1.0, 1.0]
    assert {r["k"] for r in s.collect()} == {0.0}
    m, _ = X.minmax_scale(df, ["x", "k"])
    assert sorted(r["x"] for r in m.collect()) == [0.0, 1.0]
    assert {r["k"] for r in m.collect()} == {0.0}


def test_label_index_string_order(spark):
    df = spark.createDataFrame([("0",), ("1",), ("2",), ("10",)], "label string")
    out, model = X.label_index(df)
    got = {r["label"]: r["label_idx"] for r in out.collect()}
    assert got == {"0": 0, "1": 1, "2": 3, "10": 2}
    back = X.index_to_label(out, model.labels, "label_idx", "name")
    assert all(r["name"] == r["label"] for r in back.collect())


def test_one_hot_drops_first(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "x")], "day string, label string")
    out = X.one_hot(df, ["day", "label"], exclude=["label"])
    assert [c for c in out.columns if c.startswith("day_")] == ["day_b", "day_c"]
    assert "label" in out.columns
    fixed = X.one_hot(df, ["day"], categories={"day": ["a", "b", "z"]})
    assert [c for c in fixed.columns if c.startswith("day_")] == ["day_b", "day_z"]


def test_null_label_is_attack(spark):
    df = spark.createDataFrame([(None,), ("BENIGN",), ("DDoS",)], "label string")
    assert [r[0] for r in df.select(is_attack("label")).collect()] == [1, 0, 1]


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    w = {r["label"]: r["weight"] for r in X.class_weights(df).collect()}
    assert w == {"a": 4 / 6, "b": 2.0}


def test_join_bounded_salted_path_equals_plain_join(spark):
    from netsieve.functions.joins import join_bounded
    big = spark.range(2000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("k"))
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    plain = sorted(tuple(r) for r in big.join(small, "k").collect())
    salted = sorted(tuple(r) for r in
                    join_bounded(big, small, "k", max_rows=0, salt=8).select(*big.columns, "v")
                    .select("k", "id", "v").collect())
    assert plain == salted
    bc = sorted(tuple(r) for r in join_bounded(big, small, "k").select("k", "id", "v").collect())
    assert plain == bc


def test_splits_keep_rows_with_null_ids_groups_and_labels(spark):
    from netsieve.operators import features as X
    df = spark.createDataFrame([(1, "a", "g1"), (2, None, None), (None, "b", "g2"), (4, None, "g1"), (5, "a", None)],
                               "row_id long, label string, grp string")
    assert S.stratified_split(df, "label", "row_id").count() == 5
    assert S.random_split(df, "row_id", 0.5).count() == 5
    assert S.group_split(df, "grp", 0.5).count() == 5
    assert X.attach_class_weights(df, "label").count() == 5
    assert S.oversample_balanced(df, "label", "row_id").where("label is null").count() > 0


def test_sample_is_a_prefix_of_hash_order_at_any_prefix_length(spark, monkeypatch):
    from netsieve.functions.hashing import hash_key
    from netsieve.operators import ranking
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    want = {r.row_id for r in df.orderBy(hash_key("row_id"), "row_id").limit(300).collect()}
    assert {r.row_id for r in S.sample_n(df, "row_id", 300).collect()} == want
    monkeypatch.setattr(ranking, "PREFIX_DIGITS", 1)
    monkeypatch.setattr(ranking, "FINISH_ROWS", 3)  # several refinements of the crossing bucket
    assert {r.row_id for r in S.sample_n(df, "row_id", 300).collect()} == want
    assert S.sample_n(df, "row_id", 5000).count() == 1000 and S.sample_n(df, "row_id", 0).count() == 0


def test_oversampling_spreads_the_copies_of_a_rare_row(spark, monkeypatch):
    monkeypatch.setattr(S, "COPY_RUN", 50)
    df = spark.range(1001).selectExpr("id as row_id", "if(id = 0, 'rare', 'common') as label")
    out = S.oversample_balanced(df, "label", "row_id")
    rare = out.where("label = 'rare'")
    assert rare.count() in (500, 501) and rare.select("copy").distinct().count() == rare.count()


def test_labels_missing_finds_absent_classes_and_null(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "label string")
    other = spark.createDataFrame([("a",), ("a",)], "label string")
    assert {r.label for r in S.labels_missing(train, other, "label").collect()} == {"b", None}


def test_join_beyond_the_bound_works_with_map_columns_and_equal_rows(spark):
    from netsieve.functions.joins import join_bounded
    big = spark.createDataFrame([(1, {"x": 1})] * 40 + [(2, {"y": 2})], "k int, m map<string,int>")
    small = spark.createDataFrame([(1, "one"), (2, "two")], "k int, v string")
    assert join_bounded(big, small, "k", max_rows=0, salt=4).count() == 41
