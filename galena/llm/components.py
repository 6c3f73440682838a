"""Connected components by the smallest label, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, comp of every node of ``links`` (a, b): comp is the smallest node reached.

    Each round takes the smallest label of a node's neighbours, then the label of
    that label, so chains shorten by half.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(f"{label}-links", both)
    labels = scratch.keep(f"{label}-0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    step = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = scratch.keep(f"{label}-near", labels.join(near, "node").select("node", F.least("comp", "near").alias("next"), "comp"))
        jump = lower.join(lower.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select("node", F.least("next", "far").alias("next"), "comp")
        step += 1
        table = scratch.keep(f"{label}-{step}", jump)
        if table.filter("next <> comp").isEmpty():
            return table.select("node", "comp")
        scratch.drop(f"{label}-{step - 1}") if step > 1 else None
        labels = table.select("node", F.col("next").alias("comp"))
