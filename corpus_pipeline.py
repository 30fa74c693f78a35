"""Corpus pipeline: quality filter, near-dedup, decontamination, source mix, token-id records.

Every stage reads the whole output of the one before it, as Parquet; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.llm import op1_decontaminate, op5_minhash_forest, op6_mixing, op7_records, op8_quality_gam
from netsieve.llm.queries import table, tokenizer_path
from netsieve.llm.storage import materialise, small_side, unused_name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the additive model rejects (score under its threshold) go.

    All stay if the labels of these documents are none or all the same: such a model is constant and rejects nothing.
    """
    model = op8_quality_gam.train(docs, table(spark, sf_dir, "labels"))
    if model["constant"] is not None:
        return docs
    carry = [c for c in docs.columns if c != "text"] + ["text"]
    score = unused_name(docs, "quality_score")
    scored = op8_quality_gam.scored(docs, model, carry, score=score)
    return scored.where(F.col(score) >= op8_quality_gam.THRESHOLD).select(docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of smallest id.

    A NULL id is in no group and stays; of rows that repeat an id one stays.
    """
    found = op5_minhash_forest.near_duplicates(docs.select("doc_id", "text"))
    dropped = materialise(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "dropped-ids")
    kept = docs.join(small_side(dropped), "doc_id", "left_anti")
    twice = materialise(kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"),
                        "repeated-ids")
    if twice.limit(1).count() == 0:
        return kept.select(docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = (kept.join(small_side(twice), "doc_id", "left_semi").groupBy("doc_id")
           .agg(F.min_by(row, F.struct(F.coalesce("text", F.lit("")), F.to_json(row))).alias("row")).select("row.*"))
    return kept.join(small_side(twice), "doc_id", "left_anti").select(docs.columns).unionByName(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; NULL and empty texts, NULL and repeated ids stay as they are."""
    return op1_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a document is absent, once or twice there, dealt to shards and shuffled in them.

    A NULL source is a source of its own; texts without words have no size and
    stay where their place in the order is taken; repeated rows count each.
    """
    shards = op6_mixing.shard_count(docs)
    mixed = op6_mixing.mixed(docs, shards=shards)
    return mixed.repartition(shards, "mix_shard").sortWithinPartitions("mix_shard", "mix_order").select("mix_row.*")


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id record files of every document, and the digests read back from them.

    A NULL text is empty: its record holds the end id alone; NULL ids come first; repeated rows have records each.
    """
    return op7_records.tokenised(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("token_records", token_records),
]

#: The first stage learns its model: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
