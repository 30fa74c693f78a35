"""Benchmark decontamination by SimHash windows, a multi-index of Hamming blocks and exact verification.

DataFrame and SQL functions only.

1. A benchmark item of n words is compared with windows of n words.  Both are
   multisets of 5-word shingles (hashed to 64 bits); an item of fewer words is
   one shingle.  An item of any length is compared whole.
2. A window that reaches the threshold t shares at least t of the item's
   shingle weight.  So only starts are kept at which a window of n words holds
   that many shingles that occur in benchmark items of n words: this drops no match, and leaves
   text that has nothing of the benchmark out of the rest of the work.
3. Every kept window gets a 64-bit SimHash, each shingle weighing its
   multiplicity.  The fingerprints are indexed by 4 blocks of 16 bits: two
   fingerprints within ``RADIUS`` = 15 bits differ by at most 3 bits in some
   block, so looking up all 697 values within 3 bits of each of an item's
   blocks finds every one of them (pigeonhole).
4. Candidates within the radius are verified on their shingle multisets:
   weighted Jaccard (sum of minima over sum of maxima of the multiplicities) >= 0.8.

Texts are keyed by their hash, so copies of a text are searched once.

A pair at similarity 0.8 differs in 9.7 bits on average (sigma 2.9), one at
0.9 in 6.7, an exact copy in none: the radius is what bounds recall.

Defined cases: NULL and empty texts and items take no part; words are
separated by white space and lower-cased; a text shorter than an item is one
window; repeated rows and repeated items each appear; a NULL id is reported
as NULL; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.llm.storage import materialise, small_side, unused_name

SHINGLE, PERCENT = 5, 80
RADIUS, BLOCKS, BLOCK_BITS = 15, 4, 16
_WHITE = " \t\n\x0b\f\r"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's lower-cased words (empty for NULL)."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WHITE))
    words = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def _code(h: str, at: str, size: int) -> str:
    """SQL: hash of ``size`` word hashes from position ``at`` (0-based)."""
    return f"xxhash64({size}, {', '.join(f'get({h}, {at} + {i})' for i in range(size))})"


def shingles(h: str, size: int) -> Column:
    """All shingle codes of a word-hash column, in order."""
    return F.expr(f"if(size({h}) < {size}, cast(array() as array<bigint>), "
                  f"transform(sequence(0, size({h}) - {size}), p -> {_code(h, 'p', size)}))")


def simhash(codes: str) -> Column:
    """64-bit SimHash of an array of codes: bit b is set where most codes have it.

    Sixteen sums hold four 16-bit counters each; above 65535 codes 32 sums hold two 32-bit counters each.
    """
    return F.expr(f"if(size({codes}) <= 65535, {_majority(codes, 16)}, {_majority(codes, 32)})")


def _majority(codes: str, lanes: int) -> str:
    ones = sum(1 << k for k in range(0, 64, lanes))
    sums = (f"transform(sequence(0, {lanes - 1}), j -> aggregate({codes}, 0L, "
            f"(a, x) -> a + (shiftrightunsigned(x, j) & {ones}L)))")
    return (f"element_at(transform(array({sums}), l -> aggregate(sequence(0, 63), 0L, (a, b) -> a | if("
            f"(shiftrightunsigned(element_at(l, b % {lanes} + 1), {lanes} * int(b / {lanes})) & {(1 << lanes) - 1}L) * 2 "
            f"> size({codes}), shiftleft(1L, b), 0L))), 1)")


def _block(fp: str, b: str) -> str:
    return f"(shiftrightunsigned({fp}, {BLOCK_BITS} * {b}) & {(1 << BLOCK_BITS) - 1})"


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n, size, codes, fp, item_key) of each item with a word; equal items share their key."""
    t = (benchmark.select(F.col(id_col).cast("long").alias("item_id"), word_hashes(F.col(text_col)).alias("h"))
         .where("size(h) > 0")
         .withColumn("n", F.size("h")).withColumn("size", F.least(F.lit(SHINGLE), F.col("n"))))
    codes = F.when(F.col("size") == SHINGLE, shingles("h", SHINGLE))
    for k in range(1, SHINGLE):
        codes = codes.when(F.col("size") == k, shingles("h", k))
    t = t.withColumn("codes", codes).withColumn("fp", simhash("codes"))
    return t.withColumn("item_key", F.xxhash64("n", "codes")).drop("h")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("_text_key", F.xxhash64(F.col(text_col)))


def touched(texts: DataFrame, codes: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, size, n, hits): sorted positions at which a text has a shingle of a benchmark item of n words."""
    least = min(sizes)
    at = (texts.where(F.size("h") >= least)
          .select("key", "h", F.explode(F.expr(f"sequence(0, size(h) - {least})")).alias("p")))
    if len(sizes) == 1:
        at = at.select("key", "p", F.lit(least).alias("size"), F.expr(_code("h", "p", least)).alias("code"))
    else:
        each = ", ".join(f"named_struct('size', {k}, 'code', {_code('h', 'p', k)}, 'fits', p + {k} <= size(h))" for k in sizes)
        at = (at.select("key", "p", F.explode(F.expr(f"array({each})")).alias("s")).where("s.fits")
              .select("key", "p", "s.size", "s.code"))
    return (at.join(small_side(codes), ["size", "code"])
            .groupBy("key", "size", "n").agg(F.sort_array(F.collect_set("p")).alias("hits")))


def windows(texts: DataFrame, hits: DataFrame, sizes: list[int], percent: int) -> DataFrame:
    """(key, n, start, codes) of the windows of n words that hold enough shingles of items of n words."""
    per_size = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k in sizes:
        per_size = per_size.when(F.col("size") == k, shingles("h", k))
    t = (texts.join(hits, "key").withColumn("all", per_size).withColumn("c", F.expr("n - size + 1"))
         .withColumn("need", F.expr(f"int(ceil({percent} * c / 100.0D - 1e-9D))"))
         .where("size(hits) >= need"))
    # Any ``need`` consecutive hits that fit into one window allow the starts from which it holds them all.
    spans = ("filter(transform(sequence(0, size(hits) - need), i -> named_struct('a', get(hits, i), "
             "'z', get(hits, i + need - 1))), s -> s.z - s.a < c)")
    starts = (f"array_distinct(flatten(transform({spans}, s -> sequence("
              f"least(greatest(s.z - c + 1, 0), greatest(size(all) - c, 0)), least(s.a, greatest(size(all) - c, 0))))))")
    return (t.select("key", "n", "c", "all", F.explode(F.expr(starts)).alias("start"))
            .select("key", "n", "start", F.expr("slice(all, start + 1, c)").alias("codes")))


def _common(x: str, y: str, repeats: str) -> str:
    """SQL: sum over codes of the smaller multiplicity; ``repeats`` are the codes of y that occur c > 1 times."""
    return (f"size(array_intersect({x}, {y})) + aggregate(coalesce({repeats}, array()), 0, (a, r) -> a + "
            f"greatest(least(size(filter({x}, u -> u = r.code)), int(r.c)) - 1, 0))")


def matches(found: DataFrame, bench: DataFrame, percent: int) -> DataFrame:
    """Verified (key, item_id, similarity, start, hamming) of windows against items of their length."""
    near = F.expr(f"explode(filter(sequence(0, {(1 << BLOCK_BITS) - 1}), x -> bit_count(x) <= {RADIUS // BLOCKS}))")
    probes = (bench.select("item_key", "n", "fp").distinct()
              .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
              .select("*", near.alias("flip")).withColumn("v", F.expr(f"{_block('fp', 'b')} ^ flip")).drop("flip")
              .withColumnRenamed("fp", "item_fp"))
    w = (materialise(found.withColumn("fp", simhash("codes")), "fingerprints")
         .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("v", F.expr(_block("fp", "b"))))
    earlier = " or ".join(f"(b > {i} and bit_count({_block('(fp ^ item_fp)', str(i))}) <= {RADIUS // BLOCKS})"
                          for i in range(BLOCKS - 1))
    repeats = (bench.select("item_key", "codes").distinct().select("item_key", F.explode("codes").alias("code"))
               .groupBy("item_key", "code").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
               .groupBy("item_key").agg(F.collect_list(F.struct("code", "c")).alias("repeats")))
    known = bench.select("item_id", "item_key", F.col("codes").alias("item_codes")).join(repeats, "item_key", "left")
    both = _common("codes", "item_codes", "repeats")
    return (w.join(small_side(materialise(probes, "probes")), ["n", "b", "v"])
            .withColumn("hamming", F.expr("bit_count(fp ^ item_fp)"))
            .where(f"hamming <= {RADIUS} and not ({earlier})")  # a pair found by several blocks counts once
            .join(known, "item_key")
            .withColumn("common", F.expr(both))
            .withColumn("union", F.expr("size(codes) + size(item_codes) - common"))
            .where(f"common > 0 and common * 100 >= {percent} * union")
            .select("key", "item_id", F.expr("common / double(union)").alias("similarity"), "start", "hamming"))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text_col: str = "text") -> DataFrame:
    """(text key, item_id, similarity, start, hamming): the best window of each text and item at or above the threshold."""
    spark = docs.sparkSession
    bench = materialise(items(benchmark), "benchmark")
    sizes = [r.size for r in bench.select("size").distinct().orderBy("size").collect()]  # at most SHINGLE numbers
    if not sizes:
        return spark.createDataFrame([], "key long, item_id long, similarity double, start int, hamming int")
    codes = materialise(bench.select("size", "n", F.explode("codes").alias("code")).distinct(), "benchmark-codes")
    texts = _keyed(docs, text_col).select(F.col("_text_key").alias("key"), F.col(text_col).alias("text"))
    hashed = texts.select("key", word_hashes(F.col("text")).alias("h"))
    hits = materialise(touched(hashed, codes, sizes), "touched")
    keys = materialise(hits.select("key").distinct(), "touched-keys")
    once = texts.join(small_side(keys), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    once = materialise(once.select("key", word_hashes(F.col("text")).alias("h")), "touched-texts")
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s")))
    found = (matches(windows(once, hits, sizes, percent), bench, percent).groupBy("key", "item_id").agg(best.alias("m"))
             .select("key", "item_id", "m.similarity", (-F.col("m.s")).alias("start"), (-F.col("m.h")).alias("hamming")))
    return materialise(found, "leaks")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start (word), hamming for every document that holds a benchmark item."""
    found = leaks(docs, benchmark, percent, text_col)
    keyed = _keyed(docs, text_col).select(F.col(id_col).alias("doc_id"), F.col("_text_key").alias("key"))
    return keyed.join(small_side(found), "key").select("doc_id", "item_id", "similarity", "start", "hamming")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text_col: str = "text") -> DataFrame:
    """The documents without a benchmark item, columns as given (a NULL text holds none)."""
    key = unused_name(docs, "text_key")
    found = materialise(leaks(docs, benchmark, percent, text_col).select(F.col("key").alias(key)).distinct(), "leak-keys")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    return keyed.join(small_side(found), key, "left_anti").select(docs.columns)
