"""Registered profiling queries over the flow table."""

from __future__ import annotations

from itertools import combinations

from netsieve.operators import clean as C
from netsieve.operators import profile as P
from netsieve.plans.registry import register
from netsieve.plans.sql import FLOWS_CTE, clean_cte, nn, r6, with_ctes
from netsieve.sources.flows import DOUBLE_FEATURES, FEATURES, KEY_STAT_COLUMNS, flows

FLOW_WIDTH = 15  # columns of the flow view


def clean_flows(spark, sf_dir):
    """Flows with NaN and +/-inf mapped to NULL (the state every statistic reads)."""
    return C.normalize_missing(flows(spark, sf_dir), inf_to_null=True)


def _dist_sql(col: str) -> str:
    return with_ctes(FLOWS_CTE, f"c AS (SELECT {col}, count(*) AS n FROM flows GROUP BY {col})") + f"""
SELECT {col}, n, round(CAST(n AS DOUBLE) * 100 / sum(n) OVER (), 2) AS pct FROM c"""


@register("label_distribution", _dist_sql("label"))
def label_distribution(spark, sf_dir):
    return P.frequency(clean_flows(spark, sf_dir), "label")


@register("day_distribution", _dist_sql("day"))
def day_distribution(spark, sf_dir):
    return P.frequency(flows(spark, sf_dir), "day")


@register("source_distribution", _dist_sql("source_file"))
def source_distribution(spark, sf_dir):
    return P.frequency(flows(spark, sf_dir), "source_file")


@register("load_summary", with_ctes(FLOWS_CTE) + f"""
SELECT source_file, count(*) AS n_rows, CAST({FLOW_WIDTH} AS BIGINT) AS n_cols
FROM flows GROUP BY ROLLUP (source_file)""")
def load_summary(spark, sf_dir):
    return P.load_summary(flows(spark, sf_dir), "source_file")


@register("value_ranges", with_ctes(FLOWS_CTE) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min_value, "
    f"CAST(max({c}) AS DOUBLE) AS max_value FROM flows" for c in KEY_STAT_COLUMNS))
def value_ranges(spark, sf_dir):
    return P.value_ranges(flows(spark, sf_dir), KEY_STAT_COLUMNS)


@register("negative_counts", with_ctes(FLOWS_CTE) + """
SELECT 'flow_duration' AS feature, count(*) FILTER (WHERE flow_duration < 0) AS n_negative
FROM flows""")
def negative_counts(spark, sf_dir):
    return P.negative_counts(flows(spark, sf_dir), ["flow_duration"])


@register("inf_counts", with_ctes(FLOWS_CTE) + "\nSELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE isinf({c})) AS n_inf FROM flows"
    for c in DOUBLE_FEATURES) + ") t WHERE n_inf > 0")
def inf_counts(spark, sf_dir):
    return P.inf_counts(flows(spark, sf_dir), DOUBLE_FEATURES)


@register("missing_counts", with_ctes(FLOWS_CTE, clean_cte()) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM clean"
    for c in FEATURES + ["label"]))
def missing_counts(spark, sf_dir):
    return P.missing_counts(clean_flows(spark, sf_dir), FEATURES + ["label"])


@register("distinct_counts", with_ctes(FLOWS_CTE) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {nn(c)}) AS n_distinct FROM flows"
    for c in FEATURES))
def distinct_counts(spark, sf_dir):
    return P.distinct_counts(flows(spark, sf_dir), FEATURES)


def _extremes_sql(src: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, count(x) AS n, CAST(min(x) AS DOUBLE) AS lo, "
        f"CAST(max(x) AS DOUBLE) AS hi FROM (SELECT {nn(c)} AS x FROM {src}) t"
        for c in FEATURES)


@register("zero_variance_columns", with_ctes(FLOWS_CTE, f"e AS ({_extremes_sql('flows')})") + """
SELECT feature, lo + 0.0 AS value FROM e WHERE n > 0 AND lo = hi""")
def zero_variance_columns(spark, sf_dir):
    return P.zero_variance_columns(flows(spark, sf_dir), FEATURES)


@register("constant_columns", with_ctes(FLOWS_CTE, f"e AS ({_extremes_sql('flows')})") + """
SELECT feature FROM e WHERE n = 0 OR lo = hi""")
def constant_columns(spark, sf_dir):
    return P.constant_columns(flows(spark, sf_dir), FEATURES)


@register("attack_ratio", with_ctes(FLOWS_CTE) + f"""
SELECT count(*) AS n_rows,
       CAST(sum(CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END) AS BIGINT) AS n_attack,
       {r6("avg(CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END)")} AS attack_ratio
FROM flows""")
def attack_ratio(spark, sf_dir):
    return P.attack_ratio(flows(spark, sf_dir), "label")


@register("feature_stats", with_ctes(FLOWS_CTE, clean_cte()) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count(x) AS count, {r6('avg(x)')} AS mean, "
    f"{r6('stddev_samp(x)')} AS std, {r6('min(x)')} AS min, "
    f"{r6('quantile_cont(x, 0.25)')} AS p25, {r6('quantile_cont(x, 0.5)')} AS p50, "
    f"{r6('quantile_cont(x, 0.75)')} AS p75, {r6('max(x)')} AS max, "
    f"{r6('stddev_samp(x) / (avg(x) + 1e-8)')} AS cv "
    f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM clean) t" for c in FEATURES))
def feature_stats(spark, sf_dir):
    return P.describe(clean_flows(spark, sf_dir), FEATURES)


@register("high_corr_pairs", with_ctes(FLOWS_CTE, clean_cte(), "p AS (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, abs(corr(CAST({a} AS DOUBLE), "
    f"CAST({b} AS DOUBLE))) AS r FROM clean" for a, b in combinations(FEATURES, 2)) + ")") + f"""
SELECT feature_a, feature_b, {r6('r')} AS abs_corr FROM p WHERE r > 0.95 AND r < 1 - 1e-9
UNION ALL
SELECT feature_b AS feature_a, feature_a AS feature_b, {r6('r')} AS abs_corr FROM p
WHERE r > 0.95 AND r < 1 - 1e-9""")
def high_corr_pairs(spark, sf_dir):
    return P.high_corr_pairs(clean_flows(spark, sf_dir), FEATURES)


@register("duplicate_columns", with_ctes(FLOWS_CTE, clean_cte(), "p AS (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS duplicate_of, '{b}' AS feature, {i} AS pa, "
    f"bool_and(CAST({a} AS DOUBLE) IS NOT DISTINCT FROM CAST({b} AS DOUBLE)) AS same FROM clean"
    for a, b in combinations(FEATURES, 2) for i in [FEATURES.index(a)]) + ")") + """
SELECT feature, arg_min(duplicate_of, pa) AS duplicate_of FROM p WHERE same GROUP BY feature""")
def duplicate_columns(spark, sf_dir):
    return P.duplicate_columns(clean_flows(spark, sf_dir), FEATURES, "row_id")


@register("first_row_per_label", with_ctes(FLOWS_CTE) + f"""
SELECT label, row_id, {', '.join(KEY_STAT_COLUMNS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS rn FROM flows) t
WHERE rn = 1""")
def first_row_per_label(spark, sf_dir):
    return P.first_row_per_label(flows(spark, sf_dir), "label", "row_id", KEY_STAT_COLUMNS)


def _groups_sql() -> str:
    from netsieve.functions.columns import feature_groups
    return with_ctes(FLOWS_CTE, clean_cte()) + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{g}' AS \"group\", '{c}' AS feature, count({c}) AS n_values FROM clean"
        for g, c in feature_groups(FEATURES))


@register("feature_groups", _groups_sql())
def feature_groups(spark, sf_dir):
    return P.feature_group_counts(clean_flows(spark, sf_dir), FEATURES)
