"""Token counts of whole texts; huge documents through overlapping chunks spliced at proven boundaries.

Documents of at most ``LONG`` characters are encoded slice by slice (see
``encoding``).  A longer one becomes rows of overlapping chunks, spread over
tasks, so no task holds the tokens of a whole huge document:

1. every chunk is encoded on its own, with offsets into the document;
2. for neighbouring chunks the tokens inside their overlap are compared.  A
   position is a stable boundary when both encodings start a token there, the
   ``RUN`` tokens on either side agree (ids and offsets), and the tokenizer's
   own rule proves that it always splits there: white space lies between the
   two tokens (rule ``white``);
3. left of the boundary the left chunk's tokens count, right of it the right one's;
4. a document with an overlap that has no such position is cut again with
   overlaps four times as wide; when the overlap would reach the length of a
   chunk it is encoded whole, as for any tokenizer without that rule.

Defined cases: NULL and empty texts have 0 bytes and 0 tokens; NULL or
repeated ids keep their rows; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm import textarrays as T
from netsieve.llm.encoding import cut_rule, encoder
from netsieve.llm.storage import map_arrow, materialise, tasks

LONG, CHUNK, OVERLAP, RUN = 40_000, 16_000, 512, 4
LIMIT = 2048

_TOKEN = np.dtype([("id", "<u4"), ("start", "<i8"), ("end", "<i8")])


def _count_rows(tokenizer: str):
    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for lo, t in T.slices(batch.column(2)):
                _, count = enc.slice(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(count)), batch.column(1).slice(lo, len(count)),
                                                  pa.array(count)], names=["row", "n_bytes", "n_tokens"])
    return run


def _chunk_rows(tokenizer: str):
    """Tokens of each chunk: how many, and those that touch the overlap on either side."""
    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                e = enc.model.encode(x["piece"], add_special_tokens=False)
                tok = np.empty(len(e.ids), _TOKEN)
                tok["id"] = e.ids
                if len(tok):
                    span = np.array(e.offsets, np.int64) + x["at"]
                    tok["start"], tok["end"] = span[:, 0], span[:, 1]
                head_end, tail_start = x["at"] + x["overlap"], x["at"] + x["step"]
                out.append({"row": x["row"], "chunk": x["chunk"], "n": len(tok),
                            "head": tok[tok["start"] < head_end].tobytes(),
                            "tail": tok[tok["end"] > tail_start].tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("row", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())]))
    return run


def splice(tail: np.ndarray, head: np.ndarray, rule: str | None, run: int = RUN) -> tuple[int, int] | None:
    """(tokens of ``tail`` from the boundary on, tokens of ``head`` before it), or None without one."""
    common, i, j = np.intersect1d(tail["start"], head["start"], return_indices=True)
    for a, b in sorted(zip(i.tolist(), j.tolist()), key=lambda p: -min(p[0], len(head) - p[1])):
        if a < run or b < run or len(tail) - a < run or len(head) - b < run:
            continue
        if not np.array_equal(tail[a - run:a + run], head[b - run:b + run]):
            continue
        gap = tail["end"][a - 1] < tail["start"][a]
        if rule == "white" and gap:
            return len(tail) - a, b
    return None


def _splice_rows(rule: str | None):
    def run(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                got = splice(np.frombuffer(x["tail"], _TOKEN), np.frombuffer(x["head"], _TOKEN), rule)
                out.append({"row": x["row"], "less": sum(got) if got else None})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("less", pa.int64())]))
    return run


def _whole_rows(tokenizer: str):
    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            n = [len(enc.whole([t])[0]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["row", "n_tokens"])
    return run


def _spliced(long: DataFrame, tokenizer: str, rule: str | None, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of (row, text) rows, each long."""
    spark, done = long.sparkSession, []
    n = tasks(spark)
    while rule == "white" and 2 * overlap <= chunk:
        step = chunk - overlap
        cut = long.select("row", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
            F.lit(0).cast("long"), F.ceil((F.length("text") - overlap) / step) - 1))).alias("chunk"))
        cut = cut.select("row", "chunk", (F.col("chunk") * step).alias("at"),
                         F.col("text").substr((F.col("chunk") * step + 1).cast("int"), F.lit(chunk)).alias("piece"),
                         F.lit(overlap).alias("overlap"), F.lit(step).alias("step"))
        chunks = materialise(map_arrow(cut.repartition(n, "row", "chunk"), _chunk_rows(tokenizer),
                                       "row long, chunk long, n long, head binary, tail binary", keeps_tables=True), "chunks")
        left = chunks.select("row", (F.col("chunk") + 1).alias("chunk"), "tail")
        seams = map_arrow(chunks.select("row", "chunk", "head").join(left, ["row", "chunk"]), _splice_rows(rule),
                          "row long, less long", keeps_tables=True)
        seams = seams.groupBy("row").agg(F.sum("less").alias("less"), F.count_if(F.col("less").isNull()).alias("open"))
        counted = materialise(chunks.groupBy("row").agg(F.sum("n").alias("n")).join(seams, "row", "left")
                              .select("row", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n_tokens"),
                                      F.coalesce("open", F.lit(0)).alias("open")), "spliced")
        done.append(counted.where("open = 0").select("row", "n_tokens"))
        again = counted.where("open > 0").select("row")
        if again.limit(1).count() == 0:
            break
        long = materialise(long.join(again, "row", "left_semi"), "wider")
        overlap *= 4
    else:
        done.append(map_arrow(long.select("row", "text").repartition(n, "row"), _whole_rows(tokenizer),
                              "row long, n_tokens long", keeps_tables=True))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 long_chars: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per input row."""
    rule = None
    if not tokenizer.endswith(".model"):
        with open(tokenizer, encoding="utf-8") as f:  # the tokenizer is installed on driver and workers alike
            rule = cut_rule(json.load(f))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    is_long = F.length("text") > long_chars
    short = map_arrow(src.where(~is_long).select("doc_id", "n_bytes", "text"), _count_rows(tokenizer),
                      f"row {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long", keeps_tables=True)
    short = short.withColumnRenamed("row", "doc_id")
    long = materialise(src.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    found = _spliced(long.select("row", "text"), tokenizer, rule, chunk, overlap)
    out = short.unionByName(long.select("row", "doc_id", "n_bytes").join(found, "row").drop("row"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
