"""Connected components of a link table by repeated contraction (no graph on the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.storage import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in ``links``; component = smallest node reachable.

    Each round maps every node to the smallest of itself and its neighbours,
    follows that map twice (it only ever points to smaller ids), rewrites the
    links with it and drops those that became loops.  Every node that is not
    the smallest of its neighbourhood disappears, so the link table shrinks
    geometrically.  Rounds are written to the shared folder; the driver sees
    one count a round.  NULL ends and loops are no links; an empty table
    gives an empty result; repeated links change nothing.
    """
    edges = (links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
             .where("a is not null and b is not null and a < b").distinct())
    edges = materialise(edges, "links")
    labels = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                         .withColumn("component", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        down = both.groupBy(F.col("a").alias("u")).agg(F.min(F.least("a", "b")).alias("to"))
        down = materialise(down, "down")
        hop = down
        for _ in range(2):
            nxt = down.select(F.col("u").alias("to"), F.col("to").alias("to2"))
            hop = hop.join(nxt, "to", "left").select("u", F.coalesce("to2", "to").alias("to"))
        hop = materialise(hop, "hop")
        new_labels = materialise(
            labels.join(hop.withColumnRenamed("u", "component"), "component", "left")
            .select("node", F.coalesce("to", "component").alias("component")), "labels")
        ra = hop.select(F.col("u").alias("a"), F.col("to").alias("ta"))
        rb = hop.select(F.col("u").alias("b"), F.col("to").alias("tb"))
        new_edges = (edges.join(ra, "a").join(rb, "b")
                     .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                     .where("a < b").distinct())
        new_edges = materialise(new_edges, "links")
        for old in (edges, labels, down, hop):
            discard(old)
        edges, labels = new_edges, new_labels
    return labels
