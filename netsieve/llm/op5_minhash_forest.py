"""MinHash near-duplicates with an LSH forest (sorted signature orders, adaptive depth).

1. One pass over the text gives each document its distinct word shingles'
   count, a fingerprint of the set and ``TREES x DEPTH`` MinHash values.
   Documents with the same set are one *node* (the smallest id), however many
   copies exist.
2. Each tree sorts the nodes by its own DEPTH values.  Nodes sharing the
   first ``START`` values form a region; a region above ``REGION_ROWS`` is
   divided at the next depth, and so on, so the depth adapts to the density
   (beyond the last depth, by a hash of the node).  Inside a region each node
   meets the ``NEIGHBOURS`` next ones of the sorted order: those with the
   longest common prefixes.
3. In a dense region (thousands of edited copies of one text) the nearest
   neighbours need not include the common original.  So at every depth each
   node also meets its region's hub: the node at the end of the path that
   follows the heaviest child.  A copy keeps each of the original's minima
   with probability J, so that path leads to the original.  Candidates stay
   linear in the rows; no group is expanded into all pairs.
4. A 2-bit sketch of all minima drops candidates far below the threshold
   (six sigma away), then the full sets confirm each link exactly, and
   contraction gives the components.
5. A region of more rows than a node meets is *crowded*: there two members
   of different components may still be similar (filled templates, copies
   whose original is absent).  The members of such regions are joined exactly,
   by prefix filtering: sets in one order, rarest shingles first, and a pair
   at the threshold shares a shingle early in both.  Pairs inside a component
   are settled and never made.  The links found join components.

So every pair that shares the first two values of some tree is met.  A pair
at J = 0.8 does so in one tree with probability 0.64; all 12 trees miss it
with probability 5e-6.

Defined cases: a document without words (or NULL text) has an empty set and
no link; fewer words than the shingle size make one shingle of the whole
sequence; rows with the same id are one document with the links of all its
texts; a NULL id takes no part (component NULL, not kept); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsieve.llm import textarrays as T
from netsieve.llm.components import components
from netsieve.llm.storage import map_arrow, materialise, small_side

TREES, DEPTH, START = 12, 8, 2
DEPTHS = (2, 4, 6, 8)
NEIGHBOURS = 8
REGION_ROWS = 20_000
SHINGLE, PERCENT = 5, 80
#: Of 96 sketch values, those that must agree: J = 0.8 gives 81.6 on average (sigma 3.5).
SKETCH_AGREE = 62
#: Shingle counts that order the prefixes are kept per hash bucket; any counts give a right order.
BUCKET_BITS = 20
#: Rows of one shingle that meet in one task, on either side.
CELL_ROWS = 1000

_K = TREES * DEPTH
_MULT = T.mix64(np.arange(1, _K + 1, dtype=np.uint64)) | np.uint64(1)
_XOR = T.mix64(np.arange(1001, 1001 + _K, dtype=np.uint64))
_SIG = "doc_id long, n_shingles long, fp1 long, fp2 long, sk1 long, sk2 long, sk3 long, sig binary"


def _signature_rows(size: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, t in T.slices(texts):
                n = len(t.offsets) - 1
                h, doc = T.shingle_sets(t, size)
                count = np.bincount(doc, minlength=n)
                full = np.flatnonzero(count)
                first = np.searchsorted(doc, full)
                sig = np.zeros((_K, n), np.uint32)
                fp = np.zeros((2, n), np.uint64)
                if len(full):
                    for k in range(_K):
                        v = ((h ^ _XOR[k]) * _MULT[k]) >> np.uint64(32)
                        sig[k, full] = np.minimum.reduceat(v, first)
                    for k, c in enumerate((0x1234567, 0x89ABCDEF01)):
                        fp[k, full] = np.add.reduceat(T.mix64(h ^ np.uint64(c << 8)), first)
                two = (T.mix64(sig.astype(np.uint64)) & np.uint64(3)).reshape(3, 32, n)
                sketch = np.zeros((3, n), np.uint64)
                for j in range(32):
                    sketch |= two[:, j, :] << np.uint64(2 * j)
                raw = np.ascontiguousarray(sig.T.astype(">u4")).tobytes()
                width = 4 * _K
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(count.astype(np.int64)),
                     *(pa.array(x.view(np.int64)) for x in fp), *(pa.array(x.view(np.int64)) for x in sketch),
                     pa.array([raw[i * width:(i + 1) * width] for i in range(n)], pa.binary())],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "sk1", "sk2", "sk3", "sig"])
    return run


def signatures(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per input row: set size, set fingerprint, 2-bit sketch and MinHash values."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, _signature_rows(size), _SIG)


def _prefix(d: int):
    return F.substring("path", 1, 4 * d)


def _similar(x: str, y: str):
    """Sketch agreement and set sizes allow the threshold."""
    differ = sum((F.bit_count(F.expr(
        f"(({x}.sk{i} ^ {y}.sk{i}) | shiftright({x}.sk{i} ^ {y}.sk{i}, 1)) & 6148914691236517205"))
        for i in (1, 2, 3)), F.lit(0))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (F.lit(_K) - differ >= SKETCH_AGREE) & (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT)


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: pairs of nodes the forest proposes, at most NEIGHBOURS + 4 per node and tree;
    and (tree, p, me), the rows of the regions too large for all their pairs to be among them."""
    me = F.struct("node", F.col("n_shingles").alias("n"), "sk1", "sk2", "sk3")
    rows = (nodes.select(me.alias("me"), "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
            .select("me", "tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("path")))
    shared = (rows.groupBy("tree", _prefix(START).alias("p")).agg(F.count(F.lit(1)).alias("c"))
              .where("c > 1").drop("c"))
    rows = materialise(rows.withColumn("p", _prefix(START)).join(shared, ["tree", "p"]).drop("p"), "forest")

    # Regions from the deepest up: rows in each, and the hub along the heaviest child.
    level = rows.groupBy("tree", F.col("path").alias("p")).agg(
        F.count(F.lit(1)).alias("c"), F.min_by("me", F.col("me.node")).alias("hub"))
    levels = {}
    for d in reversed(DEPTHS):
        if d != DEPTH:
            level = (level.groupBy("tree", F.substring("p", 1, 4 * d).alias("p"))
                     .agg(F.sum("c").alias("c"), F.max_by("hub", F.struct("c", -F.col("hub.node"))).alias("hub")))
        levels[d] = level
    placed = rows
    for d in DEPTHS:
        side = levels[d].select("tree", F.col("p").alias(f"p{d}"), F.col("c").alias(f"c{d}"),
                                F.col("hub").alias(f"h{d}"))
        placed = placed.withColumn(f"p{d}", _prefix(d)).join(side, ["tree", f"p{d}"])
    region = F.when(F.col(f"c{DEPTHS[0]}") <= REGION_ROWS, F.col(f"p{DEPTHS[0]}"))
    for d in DEPTHS[1:]:
        region = region.when(F.col(f"c{d}") <= REGION_ROWS, F.col(f"p{d}"))
    part = F.pmod(F.xxhash64("me.node"), F.ceil(F.col(f"c{DEPTH}") / REGION_ROWS))
    placed = materialise(placed.select(
        "tree", "me", "path", region.otherwise(F.col("path")).alias("region"),
        F.when(F.col(f"c{DEPTH}") > REGION_ROWS, part).otherwise(F.lit(0)).alias("part"),
        F.array(*[f"h{d}" for d in DEPTHS]).alias("hubs"),
        (F.col(f"c{START}") > NEIGHBOURS + 1).alias("crowded")), "regions")

    w = Window.partitionBy("tree", "region", "part").orderBy("path", "me.node")
    near = (placed.select("me", F.array(*[F.lead("me", k).over(w) for k in range(1, NEIGHBOURS + 1)]).alias("o"))
            .select("me", F.explode("o").alias("other")))
    hubs = placed.select("me", F.explode(F.array_distinct("hubs")).alias("other"))
    pairs = (near.unionAll(hubs).where("other is not null and other.node <> me.node").where(_similar("me", "other"))
             .select(F.least("me.node", "other.node").alias("a"), F.greatest("me.node", "other.node").alias("b"))
             .distinct())
    return pairs, placed.where("crowded").select("tree", _prefix(START).alias("p"), "me")


def _count_rows(size: int):
    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, t in T.slices(batch.column(1)):
                h, _ = T.shingle_sets(t, size)
                counts += np.bincount((h >> np.uint64(52 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "c"])
    return run


def _posting_rows(size: int, percent: int, counts: np.ndarray):
    def run(batches):
        for batch in batches:
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            said = rest[0].to_numpy(zero_copy_only=False)
            for lo, t in T.slices(batch.column(1)):
                n_docs = len(t.offsets) - 1
                h, doc = T.shingle_sets(t, size)
                freq = counts[(h >> np.uint64(52 - BUCKET_BITS)).astype(np.int64)]
                order = np.lexsort((h, freq, doc))
                h, freq, doc = h[order], freq[order], doc[order]
                n = np.bincount(doc, minlength=n_docs)
                pos = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                n = n[doc]
                # A text of the node with another set has rows of its own; a shingle counted once has no partner.
                use = np.flatnonzero((pos <= n + -percent * n // 100) & (freq > 1) & (n == said[lo + doc]))
                at = pa.array(lo + doc[use])
                first = pos[use] <= n[use] + -2 * percent * n[use] // (100 + percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[use].astype(np.int64)), pa.array(pos[use]), pa.array(first), batch.column(0).take(at),
                     *(c.take(at) for c in rest)],
                    names=["shingle", "pos", "first", "node", *_INFO])
    return run


_INFO = ("n", "component", "sk1", "sk2", "sk3")


def finished(crowded: DataFrame, found: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str,
             text_col: str) -> DataFrame | None:
    """(a, b), a < b: pairs of different components in crowded regions that can reach the threshold (none: no pair).

    A set y and a set x of no fewer elements at the threshold have their first
    common shingle among y's first ``n - ceil(2tn / (1 + t)) + 1`` and x's first
    ``n - ceil(tn) + 1``, and enough elements after it.
    """
    rows = crowded.join(found, crowded["me.node"] == found["node"], "left").select(
        "tree", "p", "me", F.coalesce("component", "me.node").alias("component"))
    rows = materialise(rows, "crowded")
    mixed = (rows.groupBy("tree", "p").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("tree", "p"))
    open_ = materialise(rows.join(small_side(materialise(mixed, "mixed")), ["tree", "p"], "left_semi")
                        .select("me.node", "me.n", "component", "me.sk1", "me.sk2", "me.sk3").distinct(), "open")
    if open_.limit(1).count() == 0:
        return None
    text = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).distinct()
    text = text.join(small_side(open_), "node").select("node", "text", *_INFO)
    seen = (map_arrow(text, _count_rows(size), "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
            .where("c > 1").toArrow())  # at most 2 ** BUCKET_BITS rows
    counts = np.ones(1 << BUCKET_BITS, np.uint32)
    counts[seen["bucket"].to_numpy()] = np.minimum(seen["c"].to_numpy(), 2 ** 32 - 1)
    posts = materialise(map_arrow(text, _posting_rows(size, percent, counts),
                                  "shingle long, pos long, first boolean, node long, n long, component long, "
                                  "sk1 long, sk2 long, sk3 long"), "postings")

    # Of two components one is not the shingle's largest: its rows meet all rows, the largest meets only the others.
    per = posts.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"), F.count_if("first").alias("f"))
    keys = (per.groupBy("shingle").agg(
        F.sum("c").alias("c"), F.sum("f").alias("f"), F.count(F.lit(1)).alias("k"),
        F.max(F.struct("c", "component", "f")).alias("m")).where("k > 1 and f > 0")
        .select("shingle", F.col("m.component").alias("major"), F.expr(
            "array(struct(f - m.f as l, c as r), struct(m.f as l, c - m.c as r))").alias("halves")))
    keys = small_side(materialise(keys, "shared-shingles"))
    rows = posts.join(keys, "shingle").withColumn("minor", F.expr("component <> major"))
    cells = lambda k, half: f"int(ceil(halves[{half}].{k} / {CELL_ROWS}D))"
    left = (rows.where("first").withColumn("half", F.expr("if(minor, 0, 1)"))
            .withColumn("i", F.expr(f"pmod(xxhash64(node), {cells('l', 'half')})"))
            .withColumn("j", F.explode(F.expr(f"sequence(0, {cells('r', 'half')} - 1)"))))
    right = (rows.withColumn("half", F.explode(F.expr("if(minor, array(0, 1), array(0))")))
             .where("halves[half].l > 0")
             .withColumn("j", F.expr(f"int(pmod(xxhash64(node), {cells('r', 'half')}))"))
             .withColumn("i", F.explode(F.expr(f"transform(sequence(0, {cells('l', 'half')} - 1), v -> bigint(v))"))))
    wanted = ["shingle", "half", "i", "j", "node", "pos", *_INFO]
    x, y = left.select(wanted).alias("x"), right.select(wanted).alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("shingle", "half", "i", "j")]
    return (x.join(y, [*same, F.col("x.component") != F.col("y.component"), F.col("x.n") <= F.col("y.n"),
                       F.expr(f"least(x.n - x.pos, y.n - y.pos) * {100 + percent} >= {percent} * (x.n + y.n)"),
                       _similar("x", "y")])
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def _set_rows(size: int):
    def run(batches):
        for batch in batches:
            for lo, t in T.slices(batch.column(1)):
                n = len(t.offsets) - 1
                h, doc = T.shingle_sets(t, size)
                cut = np.searchsorted(doc, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n),
                     pa.array([h[cut[i]:cut[i + 1]].tobytes() for i in range(n)], pa.binary())], names=["node", "s"])
    return run


def _confirm_rows(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both * 100 >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))
    return run


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold (exact)."""
    pairs = materialise(pairs, "candidates")
    wanted = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    text = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    sets = materialise(map_arrow(text.join(small_side(wanted), "node", "left_semi"),
                                 _set_rows(size), "node long, s binary"), "sets")
    side = lambda k: sets.select(F.col("node").alias(k), F.col("s").alias(f"s{k}"))
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb"),
                     _confirm_rows(percent), "a long, b long")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links between their nodes."""
    for k in ("a", "b"):
        side = found.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
        links = links.join(side, k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k))
    links = materialise(links.select("a", "b", "ca", "cb"), "more-links")
    over = components(links, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("to"))
    nodes = found.unionByName(links.select(F.col("a").alias("node"), F.col("ca").alias("component"))).unionByName(
        links.select(F.col("b").alias("node"), F.col("cb").alias("component"))).distinct()
    return nodes.join(over, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept, per input row."""
    sig = materialise(signatures(docs, size, id_col, text_col), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"))
    of = materialise(some.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2"])
                     .select("doc_id", "n_shingles", "node", "fp1", "fp2"), "classes")
    heads = of.where("doc_id = node").select("doc_id", "node", "fp1", "fp2").distinct()
    nodes = sig.join(heads, ["doc_id", "fp1", "fp2"])
    pairs, crowded = candidates(nodes)
    links = confirmed(pairs, docs, size, percent, id_col, text_col)
    # An id that occurs with several texts ties their classes together.
    several = (of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
               .where("a <> z").select("doc_id", "a"))
    ties = of.join(several, "doc_id").select("a", F.col("node").alias("b"))
    found = components(links.unionByName(ties))
    more = finished(crowded, found, docs, size, percent, id_col, text_col)
    if more is not None:
        found = _joined(found, confirmed(more, docs, size, percent, id_col, text_col))
    part = (of.join(found, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")))
    rest = sig.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return part.unionByName(rest).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
