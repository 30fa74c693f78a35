"""Registered cleaning, feature and split queries (C5-C9, X1-X7, A7, A12, A14-A15,
A19, J3-J4, J6, M1-M10, U1-U6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.functions.expressions import is_attack, rounded
from netsieve.operators import clean as C
from netsieve.operators import features as X
from netsieve.operators import profile as P
from netsieve.operators import split as S
from netsieve.plans.registry import register
from netsieve.plans.sql import (FLOWS_CTE, class_rank, class_size, clean_cte, group_split_cte,
                                median_fill_cte, r6, strat_split_cte, with_ctes)
from netsieve.sources.sinks import materialize
from netsieve.sources.flows import FEATURES, flows

# The days whose flows train, and every day name.
TRAIN_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday"]
WEEKDAYS = ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]
SAMPLE_ROWS = 5_000


def _clean_abs(spark, sf_dir):
    """C5 + C6: |duration|, NaN and +/-inf -> NULL."""
    return C.abs_columns(C.normalize_missing(flows(spark, sf_dir), inf_to_null=True),
                         ["flow_duration"])


def stratified(spark, sf_dir):
    f = flows(spark, sf_dir).select("row_id", "label")
    return S.stratified_split(f, "label", "row_id")


def prepared(spark, sf_dir):
    """Cleaned flows with the stratified split and train-fitted median fill."""
    df = S.stratified_split(_clean_abs(spark, sf_dir), "label", "row_id")
    out, _ = C.fill_median(df, FEATURES, fit_on=df.where(F.col("split") == "train"))
    return out


CA_CTE = "ca AS (SELECT * REPLACE (abs(flow_duration) AS flow_duration) FROM clean)"
PREP_CTES = [FLOWS_CTE, clean_cte(), CA_CTE, strat_split_cte("s"),
             median_fill_cte("prep", "ca", "s", FEATURES)]
FEAT_R6 = ", ".join(f"{r6(c)} AS {c}" for c in FEATURES)


def _feat_r6(df):
    return [rounded(c).alias(c) for c in FEATURES]


# ---- splits and samples ---------------------------------------------------------------

@register("split_stratified", with_ctes(FLOWS_CTE, strat_split_cte("s")) + """
SELECT row_id, label, split FROM s""")
def split_stratified(spark, sf_dir):
    return stratified(spark, sf_dir).select("row_id", "label", "split")


@register("split_three_way", with_ctes(FLOWS_CTE) + f"""
SELECT row_id, label,
  CASE WHEN rk < ceil(n * 0.1) THEN 'holdout'
       WHEN rk < ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * 0.2) THEN 'test'
       ELSE 'train' END AS split
FROM (SELECT row_id, label, {class_rank()} AS rk, {class_size()} AS n FROM flows) r""")
def split_three_way(spark, sf_dir):
    f = flows(spark, sf_dir).select("row_id", "label")
    return S.stratified_split(f, "label", "row_id", cuts=(("holdout", 0.1), ("test", 0.2)))


@register("split_by_day", with_ctes(FLOWS_CTE) + f"""
SELECT row_id, day, CASE WHEN day IN ({', '.join(repr(d) for d in TRAIN_DAYS)})
  THEN 'train' ELSE 'test' END AS split FROM flows""")
def split_by_day(spark, sf_dir):
    return S.split_by_values(flows(spark, sf_dir).select("row_id", "day"), "day", TRAIN_DAYS)


@register("split_by_group", with_ctes(FLOWS_CTE, group_split_cte("g")) + """
SELECT row_id, sequence_id, split FROM g""")
def split_by_group(spark, sf_dir):
    f = flows(spark, sf_dir).select("row_id",
                                    F.floor(F.col("row_id") / 10).cast("bigint").alias("sequence_id"))
    return S.group_split(f, "sequence_id").select("row_id", "sequence_id", "split")


@register("split_random", with_ctes(FLOWS_CTE) + f"""
SELECT row_id, CASE WHEN rk < floor(n * 0.1) THEN 'val' ELSE 'train' END AS split
FROM (SELECT row_id, {class_rank('row_id', None)} AS rk, {class_size(None)} AS n FROM flows) r""")
def split_random(spark, sf_dir):
    return S.random_split(flows(spark, sf_dir).select("row_id"), "row_id", 0.1)


@register("kfold", with_ctes(FLOWS_CTE) + f"""
SELECT row_id, label, CAST(rk % 3 AS INTEGER) AS fold
FROM (SELECT row_id, label, {class_rank()} AS rk FROM flows) r""")
def kfold(spark, sf_dir):
    return S.kfold(flows(spark, sf_dir).select("row_id", "label"), "label", "row_id", 3)


@register("split_class_counts", with_ctes(FLOWS_CTE, strat_split_cte("s")) + """
SELECT label, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'test') AS n_test FROM s GROUP BY label""")
def split_class_counts(spark, sf_dir):
    return S.split_class_counts(stratified(spark, sf_dir), "label", "split")


@register("labels_missing_in_val", with_ctes(FLOWS_CTE) + f"""
SELECT DISTINCT label FROM flows WHERE day IN ({', '.join(repr(d) for d in TRAIN_DAYS)})
EXCEPT
SELECT DISTINCT label FROM flows WHERE day NOT IN ({', '.join(repr(d) for d in TRAIN_DAYS)})""")
def labels_missing_in_val(spark, sf_dir):
    d = S.split_by_values(flows(spark, sf_dir).select("label", "day"), "day", TRAIN_DAYS)
    return S.labels_missing(d.where(F.col("split") == "train"), d.where(F.col("split") == "test"),
                            "label")


@register("downsample_majority", with_ctes(FLOWS_CTE) + f"""
SELECT row_id, label FROM (
  SELECT row_id, label, {class_rank('row_id', None)} AS rk, {class_size(None)} AS n
  FROM flows WHERE label = 'BENIGN') b WHERE rk < round(n * 0.15)
UNION ALL
SELECT row_id, label FROM flows WHERE label <> 'BENIGN' OR label IS NULL""")
def downsample_majority(spark, sf_dir):
    f = flows(spark, sf_dir).select("row_id", "label")
    return S.downsample_class(f, "label", "row_id", "BENIGN", 0.15)


@register("sample_n", with_ctes(FLOWS_CTE) + f"""
SELECT row_id, label FROM (SELECT row_id, label, {class_rank('row_id', None)} AS rk FROM flows) r
WHERE rk < {SAMPLE_ROWS}""")
def sample_n(spark, sf_dir):
    return S.sample_n(flows(spark, sf_dir).select("row_id", "label"), "row_id", SAMPLE_ROWS)


@register("oversample_balanced", with_ctes(
    FLOWS_CTE,
    "w AS (SELECT label, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight "
    "FROM (SELECT label, count(*) AS n FROM flows GROUP BY label) c)",
    "u AS (SELECT f.row_id, f.label, w.weight, "
    "CAST(CAST('0x' || substr(md5(CAST(f.row_id AS VARCHAR) || ':42'), 1, 13) AS BIGINT) AS DOUBLE)"
    " / CAST(4503599627370496 AS DOUBLE) AS u FROM flows f JOIN w USING (label))",
    "c AS (SELECT row_id, label, CAST(floor(weight) + CASE WHEN u < weight - floor(weight) "
    "THEN 1 ELSE 0 END AS INTEGER) AS copies FROM u)") + """
SELECT row_id, label, CAST(unnest(generate_series(1, copies)) AS INTEGER) AS copy
FROM c WHERE copies > 0""")
def oversample_balanced(spark, sf_dir):
    return S.oversample_balanced(flows(spark, sf_dir).select("row_id", "label"), "label", "row_id")


@register("resample_exact", with_ctes(
    FLOWS_CTE,
    f"r AS (SELECT row_id, label, {class_rank()} AS rk, {class_size()} AS n, dense_rank() OVER (ORDER BY label) - 1 AS c FROM flows)",
    "a AS (SELECT *, (SELECT count(*) FROM flows)::HUGEINT AS draws, (SELECT count(DISTINCT label) FROM flows)::HUGEINT * n AS cell FROM r)",
    "p AS (SELECT row_id, label, (2 * draws * (c * n + rk + 1) + cell - 1) // (2 * cell) "
    "- (2 * draws * (c * n + rk) + cell - 1) // (2 * cell) AS copies FROM a)") + """
SELECT row_id, label, CAST(unnest(generate_series(1, CAST(copies AS BIGINT))) AS INTEGER) AS copy FROM p WHERE copies > 0""")
def resample_exact(spark, sf_dir):
    """As many balanced draws as there are rows, exactly."""
    return S.weighted_resample(flows(spark, sf_dir).select("row_id", "label"), "label", "row_id")


@register("resplit_union", with_ctes(FLOWS_CTE, strat_split_cte("s"), f"""
r AS (SELECT row_id, label, split, {class_rank(part="label")} AS rk, {class_size()} AS n FROM s)""") + """
SELECT row_id, label, split AS old_split, CASE WHEN rk < ceil(n * 0.1) THEN 'holdout'
  WHEN rk < ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def resplit_union(spark, sf_dir):
    """Written train and test tables united again and split into holdout, test and train."""
    old = materialize(S.stratified_split(flows(spark, sf_dir).select("row_id", "label"), "label", "row_id"), "old-split",
                      partition_by=("split",))
    train, test = (old.where(F.col("split") == p) for p in ("train", "test"))
    whole = train.unionByName(test).withColumnRenamed("split", "old_split")
    return S.stratified_split(whole, "label", "row_id", cuts=(("holdout", 0.1), ("test", 0.2))).select("row_id", "label", "old_split", "split")


@register("union_by_name", with_ctes(FLOWS_CTE, strat_split_cte("s")) + """
SELECT f.row_id, f.label, s.split, f.flow_duration, f.total_fwd_packets, f.day
FROM flows f JOIN s USING (row_id) WHERE s.split = 'train'
UNION ALL
SELECT f.row_id, f.label, s.split, f.flow_duration, NULL AS total_fwd_packets, NULL AS day
FROM flows f JOIN s USING (row_id) WHERE s.split = 'test'""")
def union_by_name(spark, sf_dir):
    f = S.stratified_split(flows(spark, sf_dir), "label", "row_id")
    train = f.where(F.col("split") == "train").select(
        "row_id", "label", "split", "flow_duration", "total_fwd_packets", "day")
    test = f.where(F.col("split") == "test").select("flow_duration", "split", "label", "row_id")
    return train.unionByName(test, allowMissingColumns=True)


# ---- cleaning -----------------------------------------------------------------------------

@register("clean_median", with_ctes(*PREP_CTES) + f"""
SELECT row_id, split, {FEAT_R6} FROM prep""")
def clean_median(spark, sf_dir):
    return prepared(spark, sf_dir).select("row_id", "split", *_feat_r6(None))


@register("clean_zero_clip", with_ctes(FLOWS_CTE, clean_cte()) + "\nSELECT row_id, " + ", ".join(
    f"{r6(f'greatest(-1e6, least(1e6, coalesce(CAST({c} AS DOUBLE), 0)))')} AS {c}"
    for c in FEATURES) + " FROM clean")
def clean_zero_clip(spark, sf_dir):
    df = C.normalize_missing(flows(spark, sf_dir), inf_to_null=True)
    df = C.clip_columns(C.fill_zero(df, FEATURES), FEATURES, -1e6, 1e6)
    return df.select("row_id", *_feat_r6(df))


@register("missing_pct_by_split", with_ctes(FLOWS_CTE, clean_cte(), strat_split_cte("s")) + "\n"
          + "SELECT * FROM (" + "\nUNION ALL\n".join(
              f"SELECT split, '{c}' AS feature, round(CAST(count(*) FILTER (WHERE {c} IS NULL) "
              f"AS DOUBLE) * 100 / count(*), 4) AS missing_pct FROM clean JOIN s USING (row_id) "
              f"GROUP BY split" for c in FEATURES) + ") t WHERE missing_pct > 0")
def missing_pct_by_split(spark, sf_dir):
    df = C.normalize_missing(flows(spark, sf_dir), inf_to_null=True)
    df = S.stratified_split(df, "label", "row_id")
    return P.missing_pct_by_group(df, "split", FEATURES)


# ---- features -----------------------------------------------------------------------------

@register("label_encode", with_ctes(FLOWS_CTE) + """
SELECT row_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
FROM flows""")
def label_encode(spark, sf_dir):
    out, _ = X.label_index(flows(spark, sf_dir).select("row_id", "label"))
    return out


@register("one_hot", with_ctes(FLOWS_CTE) + "\nSELECT row_id, " + ", ".join(
    f"CASE WHEN day = '{d}' THEN 1 ELSE 0 END AS day_{d}" for d in WEEKDAYS[1:]) + " FROM flows")
def one_hot(spark, sf_dir):
    f = flows(spark, sf_dir).drop("src_ip", "source_file", "ts")
    from netsieve.functions.columns import string_columns
    enc = X.one_hot(f, string_columns(f), drop_first=True, exclude=["label"])
    return enc.select("row_id", *[c for c in enc.columns if c.startswith("day_")])


@register("standard_scale", with_ctes(
    *PREP_CTES, "st AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
        for c in FEATURES) + " FROM prep WHERE split = 'train')") + "\nSELECT row_id, split, "
    + ", ".join(f"{r6(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in FEATURES)
    + " FROM prep CROSS JOIN st")
def standard_scale(spark, sf_dir):
    df = prepared(spark, sf_dir)
    out, _ = X.standard_scale(df, FEATURES, fit_on=df.where(F.col("split") == "train"))
    return out.select("row_id", "split", *_feat_r6(out))


MINMAX_CTES = [
    FLOWS_CTE, clean_cte(), CA_CTE, group_split_cte("g", "ca"),
    median_fill_cte("gp", "ca", "g", FEATURES),
    "mm AS (SELECT " + ", ".join(
        f"min({c}) AS lo_{c}, CASE WHEN max({c}) = min({c}) THEN 1 ELSE max({c}) - min({c}) END"
        f" AS r_{c}" for c in FEATURES) + " FROM gp WHERE split = 'train')"]


def minmax_prepared(spark, sf_dir):
    """Cleaned flows, split by group of ten rows, train-fitted medians and min-max scaling."""
    base = _clean_abs(spark, sf_dir)
    g = S.group_split(base.withColumn("sequence_id", F.floor(F.col("row_id") / 10).cast("bigint")),
                      "sequence_id")
    filled, _ = C.fill_median(g, FEATURES, fit_on=g.where(F.col("split") == "train"))
    out, _ = X.minmax_scale(filled, FEATURES, fit_on=filled.where(F.col("split") == "train"))
    return out


@register("minmax_scale", with_ctes(*MINMAX_CTES)
    + "\nSELECT row_id, split, "
    + ", ".join(f"{r6(f'({c} - lo_{c}) / r_{c}')} AS {c}" for c in FEATURES)
    + " FROM gp CROSS JOIN mm")
def minmax_scale(spark, sf_dir):
    out = minmax_prepared(spark, sf_dir)
    return out.select("row_id", "split", *_feat_r6(out))


DAY_SQL = [
    FLOWS_CTE, clean_cte(),
    "z AS (SELECT row_id, label, CASE WHEN day IN (" + ", ".join(repr(d) for d in TRAIN_DAYS)
    + ") THEN 'train' ELSE 'test' END AS split, " + ", ".join(
        f"greatest(-1e6, least(1e6, coalesce(CAST({c} AS DOUBLE), 0))) AS {c}" for c in FEATURES) + " FROM clean)",
    "mm AS (SELECT " + ", ".join(
        f"min({c}) AS lo_{c}, CASE WHEN max({c}) = min({c}) THEN 1 ELSE max({c}) - min({c}) END"
        f" AS r_{c}" for c in FEATURES) + " FROM z WHERE split = 'train')",
    "scaled AS (SELECT row_id, label, split, " + ", ".join(
        f"({c} - lo_{c}) / r_{c} AS {c}" for c in FEATURES) + " FROM z CROSS JOIN mm)"]


def day_prepared(spark, sf_dir):
    """Missing values filled with 0, clipped, split by day, min-max scaled on the train days."""
    df = C.normalize_missing(flows(spark, sf_dir), inf_to_null=True)
    df = C.clip_columns(C.fill_zero(df, FEATURES), FEATURES, -1e6, 1e6)
    df = S.split_by_values(df, "day", TRAIN_DAYS)
    return X.minmax_scale(df, FEATURES, fit_on=df.where(F.col("split") == "train"))[0]


@register("binary_dataset", with_ctes(
    *DAY_SQL[:2],
    "y AS (SELECT *, CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END AS is_attack FROM clean)",
    "r AS (SELECT *, row_number() OVER (PARTITION BY is_attack ORDER BY md5(CAST(row_id AS VARCHAR) || ':42'), row_id) - 1 "
    "AS rk, count(*) OVER (PARTITION BY is_attack) AS n FROM y)",
    "z AS (SELECT row_id, is_attack, day, CASE WHEN rk < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split, "
    + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in FEATURES) + " FROM r)",
    "st AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
        for c in FEATURES) + " FROM z WHERE split = 'train')") + "\nSELECT row_id, is_attack, split, " + ", ".join(
            f"CASE WHEN day = '{d}' THEN 1 ELSE 0 END AS day_{d}" for d in WEEKDAYS[1:]) + ", "
    + ", ".join(f"{r6(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in FEATURES) + " FROM z CROSS JOIN st")
def binary_dataset(spark, sf_dir):
    """C11 + X4 + C8 + X5 + M2: is_attack, one-hot day, zero fill, standard scaling, stratified split as one table."""
    f = C.normalize_missing(flows(spark, sf_dir), inf_to_null=True).withColumn("is_attack", is_attack("label"))
    f = C.fill_zero(X.one_hot(f, ["day"], drop_first=True), FEATURES)
    f = S.stratified_split(f, "is_attack", "row_id")
    out, _ = X.standard_scale(f, FEATURES, fit_on=f.where(F.col("split") == "train"))
    return out.select("row_id", "is_attack", "split", *[c for c in out.columns if c.startswith("day_")], *_feat_r6(out))


@register("target_corr_top", with_ctes(
    *PREP_CTES,
    "y AS (SELECT p.*, CAST(dense_rank() OVER (ORDER BY f.label) - 1 AS DOUBLE) AS y "
    "FROM prep p JOIN flows f USING (row_id) WHERE p.split = 'train')",
    "c AS (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS r FROM y" for c in FEATURES) + ")")
    + f"""
SELECT feature, {r6('r')} AS abs_corr FROM c WHERE r IS NOT NULL AND NOT isnan(r)
ORDER BY r DESC, feature LIMIT 20""")
def target_corr_top(spark, sf_dir):
    df = prepared(spark, sf_dir).where(F.col("split") == "train")
    df, dropped = P.drop_zero_variance(df, FEATURES)
    df, _ = X.label_index(df, "label", "y")
    keep = [c for c in FEATURES if c not in dropped]
    return P.target_correlation(df, keep, "y", top=20)


@register("class_weights", with_ctes(FLOWS_CTE) + f"""
SELECT label, n, {r6('CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)')} AS weight
FROM (SELECT label, count(*) AS n FROM flows GROUP BY label) c""")
def class_weights(spark, sf_dir):
    w = X.class_weights(flows(spark, sf_dir).select("label"), "label")
    return w.select("label", "n", rounded("weight").alias("weight"))


@register("pos_weight", with_ctes(FLOWS_CTE) + f"""
SELECT count(*) FILTER (WHERE label = 'BENIGN') AS n_neg,
       count(*) FILTER (WHERE label <> 'BENIGN' OR label IS NULL) AS n_pos,
       {r6("CAST(count(*) FILTER (WHERE label = 'BENIGN') AS DOUBLE) / "
           "count(*) FILTER (WHERE label <> 'BENIGN' OR label IS NULL)")} AS pos_weight
FROM flows""")
def pos_weight(spark, sf_dir):
    f = flows(spark, sf_dir).select(is_attack("label").alias("y"))
    out = X.pos_weight(f, "y")
    return out.select("n_neg", "n_pos", rounded("pos_weight").alias("pos_weight"))


@register("weighted_rows", with_ctes(FLOWS_CTE) + f"""
SELECT f.row_id, f.label, {r6('w.weight')} AS weight FROM flows f JOIN (
  SELECT label, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight
  FROM (SELECT label, count(*) AS n FROM flows GROUP BY label) c) w USING (label)""")
def weighted_rows(spark, sf_dir):
    out = X.attach_class_weights(flows(spark, sf_dir).select("row_id", "label"), "label")
    return out.select("row_id", "label", rounded("weight").alias("weight"))


@register("fold_label_names", with_ctes(FLOWS_CTE) + f"""
SELECT fold, label_idx, label, count(*) AS n FROM (
  SELECT CAST(rk % 3 AS INTEGER) AS fold, label,
         CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
  FROM (SELECT row_id, label, {class_rank()} AS rk FROM flows) r) t
GROUP BY fold, label_idx, label""")
def fold_label_names(spark, sf_dir):
    folds = S.kfold(flows(spark, sf_dir).select("row_id", "label"), "label", "row_id", 3)
    parts = [folds.where(F.col("fold") == i) for i in range(3)]
    vocab = X.vocabulary(*parts, label_col="label")
    enc, model = X.label_index(folds, "label", "label_idx", fit_on=vocab)
    counts = enc.groupBy("fold", "label_idx").agg(F.count(F.lit(1)).alias("n"))
    named = X.index_to_label(counts, model.labels, "label_idx", "label")
    return named.select("fold", F.col("label_idx").cast("int").alias("label_idx"), "label", "n")


# ---- CSV round trip ---------------------------------------------------------------------

# Dirty header names as written to the CSV files (leading/trailing spaces on purpose).
DIRTY = {"row_id": " Flow ID", "src_ip": " Source IP", "label": " Label ",
         "flow_duration": " Flow Duration", "total_fwd_packets": " Total Fwd Packets",
         "total_bwd_packets": " Total Backward Packets", "destination_port": " Destination Port",
         "flow_bytes_s": "Flow Bytes/s ", "bwd_psh_flags": " Bwd PSH Flags",
         "fwd_header_length": " Fwd Header Length", "fwd_iat_mean": " Fwd IAT Mean",
         "fwd_iat_max": " Fwd IAT Max"}


def _written_and_read(spark, sf_dir, compression="none"):
    """The flows as a folder of CSV files with the source's blank-padded names, and its ingest."""
    from pyspark.sql import types as T

    from netsieve.session import scratch_path
    from netsieve.sources.csv_files import read_flow_csvs, write_flow_csvs
    path = scratch_path(spark, "flow-csv")
    src = flows(spark, sf_dir).select("source_file", *DIRTY.keys())
    write_flow_csvs(src.select("source_file", *[F.col(c).alias(d) for c, d in DIRTY.items()]),
                    path, "source_file", DIRTY["row_id"], compression=compression)
    types = dict(src.dtypes)
    spark_type = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    schema = T.StructType([T.StructField(DIRTY[c], spark_type[types[c]]) for c in DIRTY])
    return path, read_flow_csvs(spark, path, schema)


@register("csv_ingest", with_ctes(FLOWS_CTE) + """
SELECT row_number() OVER (ORDER BY source_file, row_id) - 1 AS row_id, label, source_file, day, """
          + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" if c == "flow_bytes_s"
                      else c for c in FEATURES) + " FROM flows")
def csv_ingest(spark, sf_dir):
    df = _written_and_read(spark, sf_dir)[1]
    back = {d.strip(): c for c, d in DIRTY.items()}
    df = df.select(*[F.col(n).alias(back.get(n, n)) for n in df.columns])
    df = C.normalize_missing(df, ["flow_bytes_s"])
    return df.select("row_id", "label", "source_file", "day", *FEATURES)


@register("csv_load_status", with_ctes(FLOWS_CTE) + f"""
SELECT source_file, {len(DIRTY)} AS n_columns, CAST(0 AS BIGINT) AS n_unreadable, count(*) AS n_rows,
       CAST(0 AS BIGINT) AS n_malformed FROM flows GROUP BY source_file""")
def csv_load_status(spark, sf_dir):
    """S2 + K4 over gzip files, each streamed to its end in a task; the status table is written and read back."""
    from netsieve.session import scratch_path
    from netsieve.sources.csv_files import load_status
    path, df = _written_and_read(spark, sf_dir, "gzip")
    out = scratch_path(spark, "csv-load-status")
    load_status(spark, path, df).write.parquet(out)
    return spark.read.parquet(out)
