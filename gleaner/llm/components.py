"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch


def connected_components(links: DataFrame, work: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable over ``links``; a row for every linked node.

    Each round every node takes the smallest label among its own and its neighbours', then the
    label of that label, so labels run along paths in doubling steps. Rounds go on until no label
    falls. Links to oneself and repeated links change nothing; null ends are left out.
    """
    ends = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = work.table("cc-links", ends.union(ends.select("b", "a")).distinct())
    labels = work.table("cc-0", both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    for step in range(1, 1000):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("node").alias("via"), F.col("component").alias("next"))
        jumped = lower.join(target, F.col("component") == F.col("via"), "left").select("node", "old", F.least("component", "next").alias("component"))
        now = work.table(f"cc-{step}", jumped)
        fell = now.where("component < old").limit(1).count()
        work.drop(f"cc-{step - 1}")
        labels = now.select("node", "component")
        if not fell:
            return labels
    raise RuntimeError("the components did not settle")
