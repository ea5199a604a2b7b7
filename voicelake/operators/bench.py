"""Benchmark roll-ups and corpus selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voicelake.operators.telemetry import join_groups, medians, ranked_value


def bench_summary(records: DataFrame, key: list[str], rtf: str, seconds: str, rss: str, load: str) -> DataFrame:
    """records, median and p95 of both measures, largest memory and load, a key joined by '/'."""
    named = records.withColumn("key", F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    found = named.groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.max(F.coalesce(F.col(rss), F.lit(0))).alias("max_rss"), F.max(F.coalesce(F.col(load), F.lit(0.0))).alias("max_load"))
    middle = {"_low": (0.5, F.floor((F.col("n") - 1) / 2)), "_high": (0.5, F.floor(F.col("n") / 2)), "_p95": (0.95, F.bround((F.col("n") - 1) * F.lit(0.95)))}
    for column, name in ((rtf, "rtf"), (seconds, "seconds")):
        ranks = ranked_value(named, ["key"], column, middle)
        found = found.join(ranks.select("key", ((F.col("_low") + F.col("_high")) / 2).alias(f"median_{name}"), F.col("_p95").alias(f"p95_{name}")), "key", "left")
    return found


def warm_vs_cold(records: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """A group's first row is cold; the median of the others is warm."""
    placed = records.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    cold = placed.filter("_k = 1").select(*by, F.col(value).alias("cold"))
    return join_groups(cold, medians(placed.filter("_k > 1"), by, value, "warm_median"), by, "left")


def bench_pivot(records: DataFrame, by: str, column: str, names: list[str], value: str) -> DataFrame:
    """The median of each name of a column as a column of its own."""
    found = medians(records.filter(F.col(column).isin(*names)), [by, column], value)
    return join_groups(records.select(by).distinct(), found.groupBy(by).pivot(column, names).agg(F.first("median")), [by], "left")


def compare_runs(records: DataFrame, keys: list[str], run: str, a, b, value: str) -> DataFrame:
    side = lambda r, name: records.filter(F.col(run) == r).select(*keys, F.col(value).alias(name))
    both = side(a, "a").join(side(b, "b"), keys)
    return both.withColumn("difference", F.col("b") - F.col("a")).withColumn("ratio", F.try_divide("b", "a"))


def select_corpus(samples: DataFrame, size: str, order: str, short: float, medium: float, n: int = 10) -> DataFrame:
    """The n shortest of at most ``short``; the first n in order with short < size <= medium. Ids like short_01."""
    category = F.when(F.col(size) <= short, "short").when(F.col(size) <= medium, "medium")
    marked = samples.withColumn("category", category).filter("category IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.when(F.col("category") == "short", F.col(size)), order))
    return marked.withColumn("_k", place).filter(F.col("_k") <= n).withColumn("sample_id", F.concat_ws("_", "category", F.lpad(F.col("_k").cast("string"), 2, "0"))).drop("_k")


def composite_cut(samples: DataFrame, by: list[str], order: str, size: str, gap: int, limit: int) -> DataFrame:
    """Samples in order, each followed by a gap, up to the first that reaches the limit."""
    upto = F.sum(F.col(size) + gap).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return samples.withColumn("total", upto).filter(F.col("total") - F.col(size) - gap < limit)


def union_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    return out


def require_full(selected: DataFrame, n: int = 10) -> DataFrame:
    """The selection of ``select_corpus`` if each category has its n rows; else ValueError. Reads at most 2 n rows."""
    found = {r["category"]: r["count"] for r in selected.groupBy("category").count().collect()}
    short = [c for c in ("short", "medium") if found.get(c, 0) < n]
    if short:
        raise ValueError(f"fewer than {n} rows: {', '.join(short)}")
    return selected
