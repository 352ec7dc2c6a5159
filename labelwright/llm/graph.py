"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.store import drop, save


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is its smallest reachable node.

    Each round offers a node and its present label the smallest label among the neighbours,
    then follows every label one step on, so that labels travel twice as far each round. A round
    is two joins and a combining aggregate written to the shared folder; nothing is gathered by
    node. It ends when a round changes nothing. Null ends and self links are ignored.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    pairs = edges.select(a.alias("a"), b.alias("b")).where("a <> b")
    both = save(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).select(F.col("a").alias("node"), "component"), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("component").alias("low"))
        )
        seen = labels.join(near, F.col("node") == F.col("a")).select("node", "component", "low")
        offers = seen.select(
            F.explode(
                F.array(
                    F.struct(F.col("node").alias("node"), F.least("component", "low").alias("component"), F.col("component").alias("was")),
                    F.struct(F.col("component").alias("node"), F.least("component", "low").alias("component"), F.lit(None).cast("long").alias("was")),
                )
            ).alias("o")
        ).select("o.*")
        hooked = offers.groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        step = hooked.select(F.col("node").alias("up"), F.col("component").alias("top"))
        jumped = hooked.join(step, F.col("component") == F.col("up")).select("node", F.col("top").alias("component"), "was")
        after = save(jumped, "labels")
        drop(labels)
        if after.where("component <> was").isEmpty():
            drop(both)
            return after.select("node", "component")
        labels = after
