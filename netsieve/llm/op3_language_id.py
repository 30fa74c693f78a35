"""Language ID by Bayesian evidence fusion.

Text likelihoods (byte trigrams of all labelled documents, naive Bayes) are combined with the
language declared in the markup, the address suffix and a host prior: host counts shrink to their
suffix's, those to all pages' (grouped aggregations of the first, text-only decision).

Defined cases: NULL html is empty text, which the priors decide; NULL or malformed urls share the
empty host; languages are those of the training documents (none: an empty result); rows may repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm import textarrays as T
from netsieve.llm.storage import map_arrow, materialise, small_side

BUCKETS, SHRINK = 1 << 14, 5.0


def _trigrams(t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of the byte trigrams of runs of letters and their neighbours."""
    at = np.arange(max(len(t.buf) - 2, 0))
    doc = np.searchsorted(t.offsets, at, "right") - 1
    ok = (at + 3 <= t.offsets[doc + 1]) & ~T.NOT_LETTER[t.buf[at + 1]] if len(at) else np.zeros(0, bool)
    h = T.span_hashes(t.buf, at[ok], at[ok] + 3, T.FOLDED_CODE)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), doc[ok]


def _count_rows(batches):
    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), object)
        for lo, t in T.slices(batch.column(1)):
            b, doc = _trigrams(t)
            own = langs[lo + doc]
            for lang in set(own.tolist()):
                n = np.bincount(b[own == lang], minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])],
                                                 names=["lang", "bucket", "n"])


def _score_rows(log_p: np.ndarray):
    def run(batches):
        for batch in batches:
            for lo, t in T.slices(batch.column(4)):
                b, doc = _trigrams(t)
                n = len(t.offsets) - 1
                ll = np.column_stack([np.bincount(doc, p[b], n) for p in log_p])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, n) for c in range(4)), pa.array(ll.tolist(), pa.list_(pa.float64()))],
                    names=["page_id", "declared", "suffix", "host", "ll"])
    return run


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, score (posterior), text_lang, declared, host for every page."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = map_arrow(labelled, _count_rows, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n"))
    rows = counts.collect()  # at most languages x BUCKETS numbers
    langs = sorted({r[0] for r in rows})
    if not langs:
        return pages.sparkSession.createDataFrame([], "page_id long, lang string, score double, text_lang string, "
                                                      "declared string, host string")
    n = np.full((len(langs), BUCKETS), 0.5)
    for lang, b, c in rows:
        n[langs.index(lang), b] += c
    html = F.coalesce(F.col("html"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z]+://([^/:?#]+)", 1))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"),
                       F.regexp_extract(F.lower(html), r"<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})", 1).alias("declared"),
                       F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"), host.alias("host"),
                       F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ").alias("text"))
    first = materialise(map_arrow(src, _score_rows(np.log(n / n.sum(1, keepdims=True))),
                                  "page_id long, declared string, suffix string, host string, ll array<double>"), "langid")
    # A text without evidence decides nothing and is not counted in any prior.
    best = F.when(F.array_max("ll") > F.array_min("ll"), F.array_position("ll", F.array_max("ll")).cast("int"))
    first = first.withColumn("text_at", best)
    k = len(langs)

    def table(*keys):
        """Pages of each key by text-only language."""
        return first.groupBy(*keys).agg(F.array(*[F.count_if(F.col("text_at") == i + 1).cast("double") for i in range(k)])
                                        .alias("c"))
    every = table().first().c
    total = sum(every) or 1.0
    prior = F.array(*[F.lit((c + 1.0) / (total + k)) for c in every])
    shrunk = lambda c, up: F.zip_with(c, up, lambda a, b: (a + SHRINK * b) / (
        F.aggregate(c, F.lit(0.0), lambda s, x: s + x) + SHRINK))
    suffixes = table("suffix").select("suffix", shrunk(F.col("c"), prior).alias("by_suffix"))
    hosts = (table("suffix", "host").join(suffixes, "suffix")
             .select("host", "by_suffix", shrunk(F.col("c"), F.col("by_suffix")).alias("by_host")))
    said = table("declared").select("declared", F.zip_with("c", prior, lambda a, p: (a + p) / (p * total + 1.0)).alias("by_said"))
    hosts, said = small_side(materialise(hosts, "langid-hosts")), small_side(materialise(said, "langid-declared"))
    joined = first.join(hosts, "host").join(said, "declared")
    z = F.zip_with(F.zip_with("ll", "by_host", lambda a, p: a + F.log(p)), "by_said", lambda a, p: a + F.log(p))
    names = F.array(*[F.lit(x) for x in langs])
    out = joined.withColumn("z", z).withColumn("top", F.array_max("z"))
    return out.select(
        "page_id", F.element_at(names, F.array_position("z", F.col("top")).cast("int")).alias("lang"),
        (F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))).alias("score"),
        F.element_at(names, F.col("text_at")).alias("text_lang"), "declared", "host")
