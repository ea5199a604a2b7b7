"""Running values along an order, for keys that are longer than one task should hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks whose ends meet in one block of the next level.
FAN = 4096

_INSIDE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}


def block_key(by: list[str], block: Column) -> Column:
    """One struct of the keys (k0, k1, ...) and the block (at): null keys are equal inside a struct, so that joins keep them."""
    return F.struct(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(by)], block.cast("long").alias("at"))


def _end(kind: str, value: Column, order: list[str]) -> Column:
    if kind != "last":
        return _INSIDE[kind](value)
    return F.max(F.when(value.isNotNull(), F.struct(*[F.col(f"`{c}`").alias(f"o{n}") for n, c in enumerate(order)], value.alias("v"))))["v"]


def running(rows: DataFrame, by: list[str], order: list[str], block: Column, measures: dict[str, tuple[str, Column, bool]], levels: int = 1) -> DataFrame:
    """Adds running values over a key's rows, in ``order``: name -> (sum, count, max, min or last non-null; of what; whether the row itself is left out).

    ``block`` is a whole number that never falls along the order. Each block is first summed up, before any exchange; one
    row a block passes the window by key, and rows meet by key and block only, where they start from what their block
    is given. So the longest task holds one block of a key, and with ``levels`` above 1 the blocks' ends themselves are
    scanned in blocks of FAN. The input is read twice; sums of floating numbers are added block by block.

    Nulls: keys and blocks may be null, a null order comes first as in any window, null values are passed over; a sum,
    maximum, minimum or last value before the first one is null, a count 0. ``order`` should tell a key's rows apart.
    """
    dealt = rows.withColumn("_block", block_key(by, block))
    names = {name: f"m{n}" for n, name in enumerate(measures)}
    ends = dealt.groupBy("_block").agg(*[_end(kind, value, order).alias(names[m]) for m, (kind, value, _) in measures.items()])
    keys = [f"k{n}" for n in range(len(by))]
    ends = ends.select("_block.*", *names.values())
    lifted = {f"c{m}": ("sum" if measures[n][0] == "count" else measures[n][0], F.col(m), True) for n, m in names.items()}
    if levels > 1:
        carried = running(ends, keys, ["at"], F.floor(F.col("at") / FAN), lifted, levels - 1)
    else:
        past = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumns({c: _INSIDE[kind](value).over(past) for c, (kind, value, _) in lifted.items()})
    carried = carried.select(F.struct(*keys, "at").alias("_block"), F.struct(*lifted).alias("_past"))
    series = Window.partitionBy("_block").orderBy(*order)

    def value_of(name: str) -> Column:
        kind, value, without = measures[name]
        own = _INSIDE[kind](value).over(series.rowsBetween(Window.unboundedPreceding, -1 if without else 0))
        past = F.col(f"_past.c{names[name]}")
        if kind == "count":
            return F.coalesce(past, F.lit(0)) + own
        if kind == "sum":
            return F.coalesce(past + own, past, own)
        return F.coalesce(own, past) if kind == "last" else (F.greatest if kind == "max" else F.least)(past, own)

    return dealt.join(carried, "_block").select(*[F.col(f"`{c}`") for c in rows.columns], *[value_of(name).alias(name) for name in measures])
