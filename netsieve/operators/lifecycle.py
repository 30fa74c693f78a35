"""Model lifecycle: holdout evaluation, promotion, metrics record, append-only registry,
artefact check, run log (L10-L12, K5-K7, S8, S9, A27, A28)."""

from __future__ import annotations

import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve.operators import metrics as M
from netsieve.operators.forest import Forest
from netsieve.operators.models import predict
from netsieve.session import path_exists

REGISTRY_SCHEMA = T.StructType([
    T.StructField("created", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("final_model_path", T.StringType()), T.StructField("objective", T.StringType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("f1", T.DoubleType()),
    T.StructField("features", T.IntegerType()), T.StructField("num_classes", T.IntegerType()),
    T.StructField("notes", T.StringType())])


def evaluate(model: PipelineModel | Forest, df: DataFrame, label_col: str = "label") -> DataFrame:
    """Accuracy and macro precision/recall/F1 of a model on a table."""
    scored = predict(model, df)
    return M.macro(scored, label_col, "class")


def report(model: PipelineModel | Forest, df: DataFrame, label_col: str = "label") -> DataFrame:
    """A24 for a model."""
    return M.report(predict(model, df), label_col, "class")


def load_model(spark: SparkSession, path: str) -> PipelineModel | Forest:
    """A saved model of either kind."""
    return Forest(spark, path) if path_exists(spark, f"{path.rstrip('/')}/head") else PipelineModel.load(path)


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    """The registry table, empty when it does not exist yet."""
    if not path_exists(spark, registry_path):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path)


def promote(spark: SparkSession, model: PipelineModel | Forest | str, metrics: DataFrame, root: str,
            model_name: str, n_features: int, n_classes: int, objective: str = "multiclass",
            notes: str = "") -> DataFrame:
    """L11 + K5 + K6 + K7: save under ``final/``, write the metrics record, append a registry row.

    Metrics come from ``evaluate`` (a one-row DataFrame, computed once), never
    from literals.  ``model`` may be the path of a saved artefact: an absent one
    is an error.  Every promotion gets a version of its own and overwrites nothing.
    """
    if isinstance(model, str):
        if not path_exists(spark, model):
            raise FileNotFoundError(f"no model artefact at {model}")
        model = load_model(spark, model)
    stamp = time.strftime("%Y%m%d_%H%M%S")
    final = f"{root.rstrip('/')}/final/{model_name}_{stamp}_{uuid.uuid4().hex[:8]}"
    model.save(final)
    metrics = spark.createDataFrame([metrics.first()], metrics.schema)
    row = metrics.select(
        F.lit(stamp).alias("created"), F.lit(model_name).alias("model_name"),
        F.lit(final).alias("final_model_path"), F.lit(objective).alias("objective"),
        F.col("accuracy"), F.col("macro_precision").alias("precision"),
        F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"),
        F.lit(n_features).cast("int").alias("features"),
        F.lit(n_classes).cast("int").alias("num_classes"), F.lit(notes).alias("notes"))
    row.coalesce(1).write.json(f"{final}_metrics")
    registry = f"{root.rstrip('/')}/registry"
    row.write.mode("append").parquet(registry)
    return read_registry(spark, registry)


def validate_artefact(spark: SparkSession, model_path: str, feature_cols) -> DataFrame:
    """L12 + S9: reload the promoted model and score one row of the right width."""
    model = load_model(spark, model_path)
    probe = spark.range(1).select(*[F.lit(0.0).alias(c) for c in feature_cols],
                                  F.lit("BENIGN").alias("label"))
    return predict(model, probe).select("class")


def run_log(entries) -> list[tuple]:
    """A27 + A28: (model, rows, train_s, predict_s, rows_per_s) rows for a comparison table."""
    out = []
    for name, rows, train_s, pred_s in entries:
        out.append((name, int(rows), float(train_s), float(pred_s),
                    float(rows) / pred_s if pred_s > 0 else None))
    return out
