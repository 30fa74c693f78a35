"""Mix sources to target weights: permuted blocks dealt by a splitting tree of hypergeometric draws.

DataFrame and SQL functions only.

1. Targets: sources (in code point order, NULL last) weigh 5, 2, 1, 5, 2, ...
   and share ``budget`` times all words; a target stops at ``limit`` times its
   source and the excess goes to the others by weight (water filling).
2. Every document falls into one of its source's blocks by a hash.  A source
   is taken whole as often as its target allows; the rest is a prefix of the
   source's permuted blocks, and of the last block a prefix in hash order up
   to the document whose middle passes the target.  Block totals and one
   cut-off key a source decide that, so a document's copies are a projection
   after a join with the block table: no document is shuffled or ranked.
3. The (block, copy) units of all sources are divided among the output
   shards by a binary tree: at each node the left half's units are drawn
   without replacement, source after source, each from the exact
   hypergeometric distribution of what is left (inverse distribution
   function, tail cut at nine sigma).  The quotas at the leaves take disjoint
   runs of the source's permuted units, and each shard orders its rows by hash.

One row per source (name, words, target) is metadata, handled in one task;
blocks are a table of about one row per ``BLOCK_DOCS`` documents and source.

Defined cases: NULL text has size 0; NULL source is a source of its own, last;
NULL ids hash as empty; rows equal in id and text are taken alike; an empty
table, or one without words, gives targets 0 and no copies; clashing columns
are kept by ``mix`` because its own columns start with ``mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsieve.llm.storage import materialise, small_side

WEIGHTS = (5, 2, 1)
BUDGET, LIMIT = 1.5, 2
BLOCK_DOCS = 1000
SHARDS = 16
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex(key: Column, digits: int) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10)


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, blocks: int) -> dict[str, Column]:
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{SEED}:"),
                         F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return {"mix_source": F.coalesce(F.col(source_col), F.lit("")), "mix_null": F.col(source_col).isNull(),
            "mix_key": key, "mix_block": F.pmod(_hex(key, 7).cast("long"), F.lit(blocks))}


def block_count(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> int:
    return max(16, -(-docs.count() // block_docs))


def shard_count(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> int:
    """Output shards: sixteen blocks each, at least SHARDS."""
    return max(SHARDS, block_count(docs, block_docs) // 16)


def targets(totals: DataFrame, weights=WEIGHTS, budget: float = BUDGET, limit: int = LIMIT) -> DataFrame:
    """Water filling over one row per source (mix_source, mix_null, source_size)."""
    every = Window.orderBy("mix_null", "mix_source")
    cap = F.col("source_size") * F.lit(float(limit))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    t = (totals.withColumn("mix_rank", F.row_number().over(every)).withColumn("w", w).withColumn("cap", cap)
         .withColumn("fill", F.col("cap") / F.col("w")))
    by_fill = Window.orderBy("fill", "mix_rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(whole) * F.lit(budget)
                               - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # Sources that fill up first come first; the first level at or under its own source's fill
    # is the water level, and later ones (which count a source as full too early) are lower.
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(whole))
    return t.select("mix_source", "mix_null", "mix_rank", "source_size",
                    F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def _draw(pop: str, mine: str, draws: str, u: str) -> str:
    """SQL: hypergeometric draw; of ``pop`` units ``mine`` are of the source, ``draws`` go left."""
    ratio = "((s.m - k) * double(s.n - k) / (double(k + 1) * (s.t - s.m - s.n + k + 1)))"
    total = (f"aggregate(sequence(s.lo, s.hi), named_struct('p', 1D, 'c', 0D), "
             f"(a, k) -> named_struct('p', a.p * {ratio}, 'c', a.c + a.p), a -> a.c)")
    pick = (f"aggregate(sequence(s.lo, s.hi), named_struct('p', 1D, 'c', 0D, 'k', s.lo), "
            f"(a, k) -> named_struct('p', a.p * {ratio}, 'c', a.c + a.p, "
            f"'k', if(a.c + a.p < s.u * s.total, k + 1, a.k)), a -> least(a.k, s.hi))")
    mean = f"({draws} * double({mine}) / greatest({pop}, 1))"
    wide = (f"(9 * sqrt({mean} * (1 - {mine} / double(greatest({pop}, 1))) * ({pop} - {draws})"
            f" / greatest({pop} - 1, 1)) + 2)")
    args = (f"named_struct('t', {pop}, 'm', {mine}, 'n', {draws}, 'u', {u}, "
            f"'lo', greatest(0L, {draws} - ({pop} - {mine}), bigint(floor({mean} - {wide}))), "
            f"'hi', least({draws}, {mine}, bigint(ceil({mean} + {wide}))))")
    fields = ", ".join(f"'{f}', s.{f}" for f in ("t", "m", "n", "u", "lo", "hi"))
    return (f"element_at(transform(transform(array({args}), s -> named_struct({fields}, 'total', {total})), "
            f"s -> {pick}), 1)")


#: Levels of the splitting tree that one task makes: 2**SPREAD_LEVEL subtrees.
SPREAD_LEVEL = 5


def quotas(units: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, mix_rank, quota): the leaves of the splitting tree over (mix_rank, units) rows."""
    node = units.agg(F.array_sort(F.collect_list(F.struct("mix_rank", F.col("units").alias("c")))).alias("have"))
    node = node.select("have", F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    depth = max(shards - 1, 0).bit_length()
    for level in range(depth):
        if level == SPREAD_LEVEL:      # from here on the subtrees go to separate tasks
            node = node.repartition(F.col("lo"))
        half = "floor((hi - lo + 1) / 2)"
        u = (f"(conv(substring(md5(concat_ws(':', '{SEED}', lo, hi, x.mix_rank)), 1, 13), 16, 10)"
             f" / {float(16 ** 13)}D)")
        step = _draw("acc.pop", "x.c", "acc.draws", u)
        node = node.withColumn("all", F.expr("aggregate(have, 0L, (a, x) -> a + x.c)"))
        node = node.withColumn("draws", F.expr(f"bigint(floor(all * {half} / (hi - lo)))"))
        node = node.withColumn("left", F.expr(
            f"aggregate(have, named_struct('pop', all, 'draws', draws, 'out', cast(array() as array<bigint>)), "
            f"(acc, x) -> element_at(transform(array({step}), k -> named_struct('pop', acc.pop - x.c, "
            f"'draws', acc.draws - k, 'out', concat(acc.out, array(k)))), 1), acc -> acc.out)"))
        node = node.withColumn("mid", F.expr(f"int(lo + {half})"))
        left = "zip_with(have, left, (x, k) -> named_struct('mix_rank', x.mix_rank, 'c', k))"
        right = "zip_with(have, left, (x, k) -> named_struct('mix_rank', x.mix_rank, 'c', x.c - k))"
        node = node.selectExpr(
            f"inline(if(hi - lo > 1, array(named_struct('have', {left}, 'lo', lo, 'hi', mid), "
            f"named_struct('have', {right}, 'lo', mid, 'hi', hi)), array(named_struct('have', have, 'lo', lo, 'hi', hi))))")
    return (node.select(F.col("lo").alias("shard"), F.explode("have").alias("x"))
            .select("shard", "x.mix_rank", F.col("x.c").alias("quota")).where("quota > 0"))


def block_plan(keyed: DataFrame, shards: int = SHARDS, weights=WEIGHTS, budget: float = BUDGET,
               limit: int = LIMIT) -> DataFrame:
    """One row per (source, block): target, whole passes, cut-off key of a divided block, shard of each copy.

    ``keyed`` has mix_source, mix_null, mix_block, mix_key and size, and is materialised.
    """
    src = ["mix_source", "mix_null"]
    blocks = materialise(keyed.groupBy(*src, "mix_block").agg(F.sum("size").alias("block_words")), "mix-blocks")
    goal = targets(blocks.groupBy(*src).agg(F.sum("block_words").alias("source_size")), weights, budget, limit)
    goal = (goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                            .otherwise(F.lit(0)).cast("int"))
            .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    goal = small_side(materialise(goal, "mix-targets"))
    order = Window.partitionBy(*src).orderBy("perm", "mix_block")
    perm = F.md5(F.concat_ws(":", F.lit(str(SEED)), "mix_rank", "mix_block"))
    b = (blocks.join(goal, src).withColumn("perm", perm)
         .withColumn("before", F.coalesce(F.sum("block_words").over(
             order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("whole", (F.col("rest") > 0) & (F.col("before") + F.col("block_words") <= F.col("rest")))
         .withColumn("divided", ~F.col("whole") & (F.col("rest") > 0) & (F.col("before") <= F.col("rest"))))
    b = materialise(b, "mix-order")
    # In the divided blocks (one a source, about BLOCK_DOCS documents): the last key taken.
    divided = b.where("divided").select(*src, "mix_block", "before", "rest")
    inside = Window.partitionBy(*src, "mix_block").orderBy("mix_key")
    cut = (keyed.join(small_side(divided), [*src, "mix_block"])
           .withColumn("at", F.col("before") + F.sum("size").over(inside.rangeBetween(Window.unboundedPreceding, 0))
                       - F.col("size") / 2)
           .where("at <= rest").groupBy(*src, "mix_block").agg(F.max("mix_key").alias("cutoff")))
    b = b.join(cut, [*src, "mix_block"], "left").withColumn(
        "units", F.col("passes") + F.when(F.col("whole") | F.col("cutoff").isNotNull(), 1).otherwise(0))
    b = materialise(b.select(*src, "mix_block", "mix_rank", "source_size", "target", "passes", "whole", "cutoff",
                             "units"), "mix-units")
    # Leaves of the tree take consecutive runs of each source's permuted (block, copy) units.
    unit = b.where("units > 0").select(*src, "mix_block", "mix_rank",
                                       F.explode(F.sequence(F.lit(1), F.col("units"))).alias("copy"))
    shuffled = Window.partitionBy("mix_rank").orderBy(
        F.md5(F.concat_ws(":", F.lit(f"{SEED}u"), "mix_rank", "mix_block", "copy")), "mix_block", "copy")
    unit = unit.withColumn("pos", F.row_number().over(shuffled).cast("long"))
    by_shard = Window.partitionBy("mix_rank").orderBy("shard")
    runs = (quotas(b.groupBy("mix_rank").agg(F.sum("units").cast("long").alias("units")), shards)
            .withColumn("last", F.sum("quota").over(by_shard))
            .select("shard", "mix_rank", F.explode(F.expr("sequence(last - quota + 1, last)")).alias("pos")))
    dealt = (unit.join(runs, ["mix_rank", "pos"]).groupBy(*src, "mix_block")
             .agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("deal")))
    return b.join(dealt, [*src, "mix_block"], "left")


def keyed_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, blocks: int) -> DataFrame:
    """(row, id, source, size, keys) of each row, written once; ``row`` is unique."""
    k = _keys(docs, id_col, text_col, source_col, blocks)
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                                   words(F.col(text_col)).alias("size"),
                                   *[c.alias(n) for n, c in k.items()]), "mix-sizes")


def deal(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per copy: ``rows`` (with the mix_ keys) joined to their block's decisions."""
    on = ["mix_source", "mix_null", "mix_block"]
    take = F.col("mix_deal.copy") <= F.col("passes")
    last = F.col("whole") | F.coalesce(F.col("mix_key") <= F.col("cutoff"), F.lit(False))
    return (rows.join(plan.drop("source_size", "target", "mix_rank", "units"), on)
            .withColumn("mix_deal", F.explode("deal")).where(take | last)
            .withColumn("mix_shard", F.col("mix_deal.shard")).withColumn("mix_copy", F.col("mix_deal.copy"))
            .withColumn("mix_order", F.md5(F.concat_ws(":", "mix_key", "mix_copy")))
            .drop("deal", "mix_deal", "passes", "whole", "cutoff", *on, "mix_key"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          shards: int | None = None, block_docs: int = BLOCK_DOCS, weights=WEIGHTS, budget: float = BUDGET,
          limit: int = LIMIT) -> DataFrame:
    """The mix: every taken copy of a row of ``docs`` as a struct ``mix_row``, with mix_shard, mix_copy and mix_order.

    To write shards: ``repartition("mix_shard").sortWithinPartitions("mix_order").select("mix_row.*")``.
    """
    blocks = block_count(docs, block_docs)
    shards = shards or shard_count(docs, block_docs)
    keyed = keyed_sizes(docs, id_col, text_col, source_col, blocks)
    plan = small_side(materialise(block_plan(keyed, shards, weights, budget, limit), "mix-plan"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")
    keys = _keys(docs, id_col, text_col, source_col, blocks)
    return deal(docs.select(row, *[c.alias(n) for n, c in keys.items()]), plan)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``mixed`` with the rows' own columns; those named mix_shard, mix_copy or mix_order give way to the mix's."""
    own = [F.col(f"mix_row.`{c}`") for c in docs.columns if c.lower() not in ("mix_shard", "mix_copy", "mix_order")]
    return mixed(docs, **options).select(*own, "mix_shard", "mix_copy", "mix_order")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words of all its copies in the mix)."""
    block_docs = options.pop("block_docs", BLOCK_DOCS)
    shards = options.pop("shards", None) or shard_count(docs, block_docs)
    keyed = keyed_sizes(docs, id_col, text_col, source_col, block_count(docs, block_docs))
    plan = materialise(block_plan(keyed, shards, **options), "mix-plan")
    taken = (deal(keyed.select("row", "size", "mix_source", "mix_null", "mix_block", "mix_key"), small_side(plan))
             .groupBy("row").agg(F.sum("size").alias("taken")))
    of = plan.select("mix_source", "mix_null", "source_size", "target").distinct()
    return (keyed.join(small_side(of), ["mix_source", "mix_null"]).join(taken, "row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def oracle(block_docs: int = BLOCK_DOCS) -> str:
    """DuckDB SQL for ``mix_report`` over ``documents`` (the tree moves copies between shards, never changes them)."""
    return rf"""
WITH n AS (SELECT greatest(16, ceil(count(*) / {block_docs}.0)::BIGINT) AS blocks FROM documents),
d AS (SELECT doc_id, source IS NULL AS z, coalesce(source, '') AS s,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}:' || md5(coalesce(text, ''))) AS k FROM documents),
e AS (SELECT d.*, ('0x' || substr(k, 1, 7))::BIGINT % blocks AS b FROM d, n),
t0 AS (SELECT s, z, sum(size)::BIGINT AS source_size FROM e GROUP BY s, z),
t1 AS (SELECT *, row_number() OVER (ORDER BY z, s) AS r FROM t0),
t2 AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
        source_size * {LIMIT}.0::DOUBLE AS cap FROM t1),
t3 AS (SELECT *, (sum(source_size) OVER () * {BUDGET}::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
       FROM t2),
t4 AS (SELECT *, least(cap, w * coalesce((SELECT max(level) FROM t3 WHERE level <= cap / w), 0)) AS target FROM t3),
t5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t4),
o AS (SELECT e.*, r, source_size, target, passes, target - passes * source_size AS rest,
        md5('{SEED}:' || r || ':' || b) AS p FROM e JOIN t5 USING (s, z)),
c AS (SELECT *, sum(size) OVER (PARTITION BY s, z ORDER BY p, b, k RANGE UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS mid FROM o)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""
