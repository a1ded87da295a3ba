"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then follows
    the label of that label, so paths halve. Labels are written after each
    round; the driver sees only the count of changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(both, f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    rounds = 0
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .select(F.col("a").alias("node"), "component")
            .unionByName(labels)
            .groupBy("node")
            .agg(F.min("component").alias("component"))
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = near.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"))
        old = labels.withColumnRenamed("component", "old")
        rounds += 1
        after = scratch.keep(step, f"{name}-{rounds}")
        changed = after.join(old, "node").where(F.col("component") < F.col("old")).limit(1).count()
        scratch.drop(f"{name}-{rounds - 1}")
        labels = after
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
