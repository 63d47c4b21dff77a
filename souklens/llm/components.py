"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.session import checkpointed


def _towards_smallest(links: DataFrame, keep_larger: bool) -> DataFrame:
    """Re-hang the neighbours of every node on the smallest of them. A hot node is pre-aggregated to its minimum and
    met again by a join that adaptive execution may split; its neighbours are never gathered."""
    both = links if not keep_larger else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    met = both.join(low, "a")
    hung = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")) if keep_larger else (
        met.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        .unionByName(low.where(F.col("a") != F.col("low")).select("a", F.col("low").alias("b"))))
    return hung.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected link table; root is the smallest node that can be reached.

    NULL ends and loops are ignored; an empty table gives no rows. Every round is a written table in the shared folder.
    A round is a large star (all neighbours above a node move to its smallest) and a small star (those below it);
    it ends when a round changes nothing, which takes about log(n) rounds however long the chains are.
    """
    pairs = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    now = checkpointed(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    state = None
    while True:
        digest = now.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))").alias("h")).first()
        if state == digest:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = digest
        now = checkpointed(_towards_smallest(_towards_smallest(now, keep_larger=True), keep_larger=False))
