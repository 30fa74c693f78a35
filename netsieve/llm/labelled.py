"""A bounded, reproducible sample of labelled documents, and the fold rule of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on, at most.
SAMPLE_ROWS = 20_000


def held_out(id_col: str, modulus: int, fold: int) -> Column:
    """crc32 of the id's decimal text leaves ``fold``; false for a NULL id."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
    return F.coalesce(rest == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, fold: int,
                    rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of at most ``rows`` labelled rows outside the fold, those of smallest hash.

    The sample of label rows is bounded by the parameter, so it is broadcast
    and the text stays where it is read.  NULL ids, labels other than 0 and 1,
    and labels without a document are not used.
    """
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
         .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", modulus, fold)))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(y), "doc_id").select("text", "y")
