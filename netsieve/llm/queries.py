"""The numbered queries over the corpus tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return add


@query("op5_minhash_forest")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op5_minhash_forest import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def _op6_sql() -> str:
    from netsieve.llm.op6_mixing import oracle
    return oracle()


@query("op6_mixing", _op6_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op6_mixing import mix_report
    return mix_report(table(spark, sf_dir, "documents"))


@query("op2_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op2_topk import quantised, top_k
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("id % 50 = 0"))


@query("op8_quality_gam")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op8_quality_gam import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity_fm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op9_toxicity_fm import toxicity_scores
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op7_records")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op7_records import tokenised
    return tokenised(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op4_token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op10_katz")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op10_katz import katz_scores
    return katz_scores(table(spark, sf_dir, "documents"))


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op1_decontaminate import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op3_language_id import identify
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op11_sentencepiece")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op11_sentencepiece import digests
    return digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op12_periodic_runs import run_report
    return run_report(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsieve.llm.op13_conversation_repair import audits, damaged
    return audits(damaged(table(spark, sf_dir, "conversations")))
