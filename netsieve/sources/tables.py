"""Scan the provided parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; projections/filters applied later are pushed into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any job runs when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required column(s) missing: {missing}; have {df.columns}")
    return df
