"""The flow table the rest of the library works on.

The provided tables carry no network flows, so ``flows`` derives one from
``events`` (one flow per event, ``event_id`` is the dense order key).  The
expressions are plain Catalyst expressions, so a projection of ``flows``
only scans the ``events`` columns it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.sources.tables import read_table

# Fixed values of the flow view (must equal the oracle view).
BENIGN = "BENIGN"
BENIGN_EVENT_TYPES = ["view", "click", "signup"]
PORT_MULTIPLIER = 7919
PORT_MODULUS = 65535

LABEL_COL = "label"
ORDER_COL = "row_id"
FEATURES = [
    "flow_duration", "total_fwd_packets", "total_bwd_packets", "destination_port",
    "flow_bytes_s", "bwd_psh_flags", "fwd_header_length", "fwd_iat_mean", "fwd_iat_max",
]
INT_FEATURES = ["flow_duration", "total_fwd_packets", "total_bwd_packets",
                "destination_port", "bwd_psh_flags", "fwd_header_length"]
DOUBLE_FEATURES = ["flow_bytes_s", "fwd_iat_mean", "fwd_iat_max"]
# Columns the reference reads by name: the range report and first-row report.
KEY_STAT_COLUMNS = ["destination_port", "flow_duration", "total_fwd_packets",
                    "total_bwd_packets"]


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow view over ``events`` (see FIXTURES.md, view ``flows``)."""
    ev = read_table(spark, sf_dir, "events")
    k = _k()
    value = F.col("value")
    label = (F.when(F.col("event_type").isin(*BENIGN_EVENT_TYPES), F.lit(BENIGN))
             .when(F.col("event_type") == "purchase", F.lit("DDoS"))
             .when(value > 100, F.lit("PortScan"))
             .otherwise(F.lit("Bot")))
    flow_bytes = (F.when(k == 0, F.lit(float("inf")))
                  .when(k == 1, F.lit(None).cast("double"))
                  .when(k == 2, F.lit(float("nan")))
                  .otherwise(value * 1000 / k))
    day = F.date_format("ts", "EEEE")
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.col("ts"),
        label.alias("label"),
        F.floor((value - 10) * 100).cast("bigint").alias("flow_duration"),
        k.alias("total_fwd_packets"),
        F.floor(value).cast("bigint").alias("total_bwd_packets"),
        ((F.col("event_id") * PORT_MULTIPLIER) % PORT_MODULUS).cast("bigint")
        .alias("destination_port"),
        flow_bytes.alias("flow_bytes_s"),
        F.lit(0).cast("bigint").alias("bwd_psh_flags"),
        k.alias("fwd_header_length"),
        value.alias("fwd_iat_mean"),
        (value * 2 + k.cast("double") / 100).alias("fwd_iat_max"),
        F.concat(F.lit("192.168.1."), F.col("user_id").cast("string")).alias("src_ip"),
        day.alias("day"),
        F.concat(day, F.lit("-flows.csv")).alias("source_file"),
    )


def with_synthetic_prediction(df: DataFrame, name: str = "prediction",
                              benign_every: int = 7, ddos_every: int = 11) -> DataFrame:
    """A deterministic stand-in prediction column for metric checks without a model."""
    rid = F.col(ORDER_COL)
    pred = (F.when(rid % benign_every == 0, F.lit(BENIGN))
            .when(rid % ddos_every == 0, F.lit("DDoS"))
            .otherwise(F.col(LABEL_COL)))
    return df.withColumn(name, pred)


def with_binary_score(df: DataFrame, name: str = "score") -> DataFrame:
    """Stand-in attack probability in (0, 1): (k + 1) / 101."""
    return df.withColumn(name, (F.col("total_fwd_packets") + 1) / F.lit(101.0))


# Larger-scale stand-in: lineitem as a flow table (FIXTURES, part B).
LINEITEM_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_shipdate"]
LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with label = l_returnflag and day = weekday of l_shipdate (no dense key)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(*LINEITEM_ORDER, "l_discount", "l_tax",
                     F.col("l_returnflag").alias("label"),
                     F.date_format("l_shipdate", "EEEE").alias("day"))
