"""The next row of each, over a whole table in order, without a task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.llm.scratch import Scratch


def with_next(rows: DataFrame, order: list[Column], carried: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with the struct ``next``: the ``carried`` columns of the row that follows in ``order``, after the last the first.

    ``order`` must tell all rows apart, so that sampled ranges come out even;
    each range is a window, and its first row (one a range) is handed to the
    range before. The rows should be narrow: they are exchanged twice. A
    single row follows itself.
    """
    ranged = scratch.table(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_range").orderBy(*order)
    chained = ranged.withColumn("_lead", F.lead(F.struct(*carried)).over(inside)).withColumn("_place", F.row_number().over(inside))
    chained = scratch.table(chained, "chained")
    # one small row a range, a number that the session sets
    heads = chained.filter("_place = 1").select("_range", F.struct(*carried).alias("_head"))
    ranges = Window.orderBy("_range")
    following = F.coalesce(F.lead("_head").over(ranges), F.first("_head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("_range").alias("_from"), following.alias("_following"))
    joined = chained.join(F.broadcast(heads), F.col("_range") == F.col("_from"))
    return joined.withColumn("next", F.coalesce("_lead", "_following")).drop("_range", "_lead", "_place", "_from", "_following")
