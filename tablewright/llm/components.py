"""Connected components of a graph of links, by label spreading with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.places import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``root`` for every node of the links ``a``, ``b``: the smallest node it reaches.

    Each round every node takes the smallest label among its neighbours', and then its
    label's label; the number of rounds grows with the logarithm of the longest path.
    Labels are counts and minima only, written to the shared folder once a round, so
    that neither a hub nor a component is ever in one task or on the driver.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.union(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = both.groupBy("node").agg(F.min("other").alias("near"))
    labels = labels.select("node", F.least("node", "near").alias("root"))
    labels = scratch.keep(labels, "labels")
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("root").alias("offer"))
        offers = both.join(known, "other").groupBy("node").agg(F.min("offer").alias("offer"))
        better = scratch.keep(
            labels.join(offers, "node").select("node", F.col("root").alias("old"), F.least("root", "offer").alias("root")), "better"
        )
        # The label of the label: a shortcut along the path to the root.
        roots = better.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = scratch.keep(better.join(roots, "root").select("node", "old", F.least("root", "next").alias("root")), "labels")
        scratch.drop(labels, better)
        labels = moved.select("node", "root")
        if moved.where(F.col("root") != F.col("old")).isEmpty():
            return labels
