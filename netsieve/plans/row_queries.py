"""Registered row filters, casts, previews, vectors and the macro evaluator."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from netsieve.functions.expressions import argmax, rounded, safe_div
from netsieve.operators import clean as C
from netsieve.operators import features as X
from netsieve.operators import metrics as M
from netsieve.operators import profile as P
from netsieve.operators import split as S
from netsieve.plans.prep_queries import TRAIN_DAYS
from netsieve.plans.registry import register
from netsieve.plans.seq_metric_queries import PRED_CTE, _counts_cte
from netsieve.plans.sql import FLOWS_CTE, clean_cte, r6, with_ctes
from netsieve.sources.flows import flows, with_synthetic_prediction
from netsieve.sources.tables import require_columns

PACKETS = ["total_fwd_packets", "total_bwd_packets", "fwd_iat_mean"]
DAYS_SQL = ", ".join(repr(d) for d in TRAIN_DAYS)


@register("attack_rows", with_ctes(FLOWS_CTE) + """
SELECT row_id, label, CAST(total_fwd_packets AS VARCHAR) AS total_fwd_packets,
  CAST(total_bwd_packets AS DOUBLE) AS total_bwd_packets FROM flows WHERE label IS NULL OR label <> 'BENIGN'""")
def attack_rows(spark, sf_dir):
    """C3 + C10 + C12: rows of every class but the benign one, metadata dropped, columns cast."""
    f = require_columns(flows(spark, sf_dir), "row_id", "label", *PACKETS)
    f = C.drop_columns(C.where_equal(f, "label", "BENIGN", negate=True), ["src_ip", "source_file"])
    f = C.cast_columns(C.cast_columns(f, ["total_fwd_packets"], "string"), ["total_bwd_packets"], "double")
    return f.select("row_id", "label", "total_fwd_packets", "total_bwd_packets")


@register("rows_of_other_days", with_ctes(FLOWS_CTE) + f"""
SELECT row_id, day FROM flows WHERE day IS NULL OR day NOT IN ({DAYS_SQL})""")
def rows_of_other_days(spark, sf_dir):
    """Complement of a membership filter."""
    return C.where_in(flows(spark, sf_dir).select("row_id", "day"), "day", TRAIN_DAYS, negate=True)


@register("rows_in_listed_groups", with_ctes(FLOWS_CTE) + """
SELECT row_id, src_ip FROM flows WHERE src_ip IN (SELECT src_ip FROM flows WHERE total_fwd_packets = 7)""")
def rows_in_listed_groups(spark, sf_dir):
    """Semi join with a list of groups."""
    f = flows(spark, sf_dir)
    return S.rows_in_groups(f.select("row_id", "src_ip"), f.where("total_fwd_packets = 7"), "src_ip")


@register("preview_rows", with_ctes(FLOWS_CTE) + """
SELECT row_id, label, flow_duration, (SELECT count(*) FROM flows) AS n_rows FROM flows ORDER BY row_id LIMIT 3""")
def preview_rows(spark, sf_dir):
    """C16 + T4: the first rows in order, with the table's row count."""
    f = flows(spark, sf_dir).select("row_id", "label", "flow_duration")
    return P.preview(f, ["row_id"]).withColumn("n_rows", F.lit(P.shape(f)[0]).cast("bigint"))


@register("largest_feature", with_ctes(FLOWS_CTE, clean_cte()) + f"""
SELECT row_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS position,
  {r6('CASE WHEN b = 0 THEN NULL ELSE a / b END')} AS ratio
FROM (SELECT row_id, CAST(total_fwd_packets AS DOUBLE) AS a, CAST(total_bwd_packets AS DOUBLE) AS b,
  coalesce(CAST(fwd_iat_mean AS DOUBLE), -1) AS c FROM clean) t""")
def largest_feature(spark, sf_dir):
    """F5 + F6: position of the largest of three features, and a ratio that is NULL on a zero denominator."""
    f = C.normalize_missing(flows(spark, sf_dir), inf_to_null=True)
    x = [F.col(c).cast("double") for c in PACKETS]
    arr = F.array(x[0], x[1], F.coalesce(x[2], F.lit(-1.0)))
    return f.select("row_id", argmax(arr).alias("position"), rounded(safe_div(x[0], x[1])).alias("ratio"))


@register("scaled_vectors", with_ctes(
    FLOWS_CTE, "st AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
        for c in PACKETS[:2]) + " FROM flows)") + f"""
SELECT row_id, {r6('(total_fwd_packets - m_total_fwd_packets) / s_total_fwd_packets')} AS x0,
  {r6('(total_bwd_packets - m_total_bwd_packets) / s_total_bwd_packets')} AS x1 FROM flows CROSS JOIN st""")
def scaled_vectors(spark, sf_dir):
    """X6 + X9: scaler fitted on the whole table, columns assembled into one vector."""
    cols = PACKETS[:2]
    scaled, _ = X.standard_scale(flows(spark, sf_dir).select("row_id", *cols), cols)
    v = X.assemble(scaled, cols).select("row_id", vector_to_array("features").alias("v"))
    return v.select("row_id", *[rounded(F.col("v")[i]).alias(f"x{i}") for i in range(2)])


@register("macro_evaluator", with_ctes(FLOWS_CTE, PRED_CTE, _counts_cte("c", "p")) + f"""
SELECT {r6('avg(recall)')} AS macro_recall, {r6('avg(f1)')} AS macro_f1 FROM c_f""")
def macro_evaluator(spark, sf_dir):
    """G1: the MLlib evaluators' values."""
    p = with_synthetic_prediction(flows(spark, sf_dir).select("row_id", "label"))
    values = [M.macro_recall_value(p), M.MacroEvaluator("macro_f1", "label", "prediction").evaluate(p)]
    return spark.createDataFrame([tuple(round(v, 6) for v in values)], "macro_recall double, macro_f1 double")
