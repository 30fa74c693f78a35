"""Queries over the other stand-in tables (FIXTURES part B): lineitem as a larger flow
table without a dense key, customer balances, imbalanced binary labels; plus X11."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.operators import features as X
from netsieve.operators import profile as P
from netsieve.operators import sequence as Q
from netsieve.operators import split as S
from netsieve.operators.rowindex import with_row_index
from netsieve.plans.registry import register
from netsieve.plans.sql import FLOWS_CTE, class_rank, class_size, r6, with_ctes
from netsieve.sources.flows import FEATURES, LINEITEM_FEATURES, LINEITEM_ORDER, flows, \
    lineitem_flows
from netsieve.sources.tables import read_table

LI_ORDER_SQL = ", ".join(LINEITEM_ORDER)


LI_OUT_SQL = ", ".join(c if c != "l_shipdate" else "strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate"
                      for c in LINEITEM_ORDER)


@register("lineitem_row_index", f"""
SELECT row_number() OVER (ORDER BY {LI_ORDER_SQL}) - 1 AS row_id, {LI_OUT_SQL}
FROM lineitem""")
def lineitem_row_index(spark, sf_dir):
    li = lineitem_flows(spark, sf_dir).select(*LINEITEM_ORDER)
    out = with_row_index(li, LINEITEM_ORDER, "row_id")
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@register("lineitem_split_stratified", f"""
WITH li AS (SELECT row_number() OVER (ORDER BY {LI_ORDER_SQL}) - 1 AS row_id,
  l_returnflag AS label FROM lineitem)
SELECT row_id, label, CASE WHEN rk < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split
FROM (SELECT row_id, label, {class_rank()} AS rk, {class_size()} AS n FROM li) r""")
def lineitem_split_stratified(spark, sf_dir):
    li = with_row_index(lineitem_flows(spark, sf_dir).select(*LINEITEM_ORDER, "label"),
                        LINEITEM_ORDER, "row_id").select("row_id", "label")
    return S.stratified_split(li, "label", "row_id")


@register("lineitem_feature_stats", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, {r6(f'avg({c})')} AS mean, "
    f"{r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, "
    f"{r6(f'quantile_cont({c}, 0.25)')} AS p25, {r6(f'quantile_cont({c}, 0.5)')} AS p50, "
    f"{r6(f'quantile_cont({c}, 0.75)')} AS p75, {r6(f'max({c})')} AS max, "
    f"{r6(f'stddev_samp({c}) / (avg({c}) + 1e-8)')} AS cv FROM lineitem"
    for c in LINEITEM_FEATURES))
def lineitem_feature_stats(spark, sf_dir):
    return P.describe(lineitem_flows(spark, sf_dir), LINEITEM_FEATURES)


@register("lineitem_class_weights", f"""
SELECT l_returnflag AS label, n,
  {r6('CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)')} AS weight
FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag) c""")
def lineitem_class_weights(spark, sf_dir):
    w = X.class_weights(lineitem_flows(spark, sf_dir).select("label"), "label")
    return w.select("label", "n", F.round("weight", 6).alias("weight"))


@register("balance_negative_counts", """
SELECT 'c_acctbal' AS feature, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative
FROM customer""")
def balance_negative_counts(spark, sf_dir):
    return P.negative_counts(read_table(spark, sf_dir, "customer"), ["c_acctbal"])


@register("label_pos_weights", f"""
SELECT 'quality' AS target, count(*) FILTER (WHERE quality = 0) AS n_neg,
  count(*) FILTER (WHERE quality = 1) AS n_pos,
  {r6("CAST(count(*) FILTER (WHERE quality = 0) AS DOUBLE) / count(*) FILTER (WHERE quality = 1)")}
  AS pos_weight FROM labels
UNION ALL
SELECT 'toxic', count(*) FILTER (WHERE toxic = 0), count(*) FILTER (WHERE toxic = 1),
  {r6("CAST(count(*) FILTER (WHERE toxic = 0) AS DOUBLE) / count(*) FILTER (WHERE toxic = 1)")}
FROM labels""")
def label_pos_weights(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    out = None
    for t in ("quality", "toxic"):
        w = X.pos_weight(lab.select(F.col(t).alias("y")), "y").select(
            F.lit(t).alias("target"), "n_neg", "n_pos",
            F.round("pos_weight", 6).alias("pos_weight"))
        out = w if out is None else out.unionByName(w)
    return out


@register("data_summary", with_ctes(FLOWS_CTE) + """
SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_features,
  count(DISTINCT label) AS n_classes, CAST(10 AS BIGINT) AS seq_length,
  (SELECT count(*) FROM (SELECT row_id // 10 AS s FROM flows GROUP BY s HAVING count(*) = 10) t)
  AS n_sequences
FROM flows""")
def data_summary(spark, sf_dir):
    f = flows(spark, sf_dir)
    seqs = Q.tumbling_sequences(f, "row_id", FEATURES, "label", 10)
    return Q.summary(f, seqs, FEATURES, "label", 10)
