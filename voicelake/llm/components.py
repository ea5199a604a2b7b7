"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelake.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(one, two) -> (node, component): every linked node and the smallest node that it reaches.

    Each round ties a node's larger neighbours to its smallest one, then does
    the same for smaller neighbours, until the edges stay as they are; the
    number of rounds grows with the logarithm of the longest path.
    """
    edges = scratch.table(links.select(F.greatest("one", "two").alias("high"), F.least("one", "two").alias("low")).filter("high <> low").distinct(), f"edges-{name}-0")
    before, step = None, 0
    while True:
        step += 1
        both = edges.select(F.col("high").alias("at"), F.col("low").alias("other")).unionByName(edges.select(F.col("low").alias("at"), F.col("high").alias("other")))
        least = both.groupBy("at").agg(F.least(F.min("other"), F.col("at")).alias("least"))
        wide = both.join(scratch.table(least, f"least-{name}-{step}"), "at").filter("other > at").select(F.col("other").alias("high"), F.col("least").alias("low")).filter("high <> low").distinct()
        wide = scratch.table(wide, f"wide-{name}-{step}")
        lowest = scratch.table(wide.groupBy("high").agg(F.min("low").alias("least")), f"lowest-{name}-{step}")
        tied = wide.join(lowest, "high").select(F.when(F.col("low") == F.col("least"), F.col("high")).otherwise(F.col("low")).alias("high"), F.col("least").alias("low"))
        edges = scratch.table(tied.filter("high <> low").distinct(), f"edges-{name}-{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("high", "low").cast("long"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = edges.select(F.col("low").alias("node")).distinct()
    return scratch.table(edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), f"components-{name}")
