"""Mixing sources to target weights with hash-threshold histograms.

Every row gets a 60-bit hash. A source that must give ``whole`` repeats and a
part of one more takes the rows whose hash is at or below a threshold. The
threshold is found from histograms: words are summed by source and hash digit,
the cell in which the budget runs out is the only one that the next, finer
histogram reads, and so on until that cell holds one hash. Nothing is sorted,
and a larger budget always takes a superset (nested thresholds).

Defined results: null text counts 0 words; a null source is a source of its
own, last in order; rows that are equal in id and text share a hash, and where
the budget runs out among them, as many of them as fit are taken, whichever; an
empty table gives an empty mix; the mix has the columns of the input, whatever
their names; the report has its own alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.llm.scratch import Scratch
from voicelake.llm.text import all_columns, hash60, word_count

DIGIT_BITS, HASH_BITS = 12, 60
#: One small row a source: below this many the plan is broadcast (some 10 MB), beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def row_hash(id_col: Column, text: Column) -> Column:
    return hash60(id_col, text)


def targets(sizes: DataFrame, weights: list[int], share: float, max_repeats: int) -> DataFrame:
    """(source, source_size) -> target words: ``share`` of all words by weight, capped, the excess reshared.

    Reshaping until no source is above its cap is water filling: in order of
    cap / weight, the capped sources come first, and one level holds for the rest.
    The windows run over one row a source.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(max_repeats)).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ).cast("double")
    ranked = ranked.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(fits["level"] * F.col("weight"), F.col("cap").cast("double")))).select(
        "source", "source_size", "target"
    )


def thresholds(measured: DataFrame, scratch: Scratch, weights: list[int], share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """(source, hash, size) -> one row a source: source_size, target, whole repeats, last hash that gets one more.

    Where the rows of one hash ``at`` get one more in part, ``some`` is their number.
    """
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, max_repeats)
    repeats = F.least(F.lit(max_repeats), F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))).cast("long")
    plan = plan.withColumn("whole", repeats).withColumn(
        "budget", F.when(F.col("whole") >= max_repeats, F.lit(-1.0)).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))
    )
    plan = plan.withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "cut": F.lit(-1).cast("long"), "at": F.lit(None).cast("long"), "some": F.lit(0).cast("long"), "open": (F.col("budget") >= 0) & (F.col("source_size") > 0)})
    plan = scratch.table(plan, "plan-0")
    for step, left in enumerate(range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS), 1):
        if plan.filter("open").isEmpty():
            break
        plan = scratch.table(_refined(measured, plan, left), f"plan-{step}")
    return plan.select("source", "source_size", "target", "whole", "cut", "at", "some")


def _refined(measured: DataFrame, plan: DataFrame, left: int) -> DataFrame:
    """The plan after one more digit of the hash; ``left`` bits remain below that digit."""
    asked = plan.filter("open").select(F.col("source").alias("asked"), "budget", "prefix", "below")
    rows = _with(measured, asked, "asked").filter(F.shiftright("hash", left + DIGIT_BITS) == F.col("prefix"))
    cells = rows.groupBy("asked", F.shiftright("hash", left).alias("cell")).agg(
        F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.max("budget").alias("budget"), F.max("below").alias("below"), F.count(F.lit(1)).alias("rows")
    )
    upto = Window.partitionBy("asked").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = cells.filter((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")))
    alone = F.col("low") == F.col("high")
    # of rows with one hash, which are equal, as many as come nearest to the budget
    some = F.floor((F.col("budget") - F.col("before")) * F.col("rows") / F.col("words") + 0.5).cast("long")
    edge = edge.withColumn("some", F.when(alone, some)).select(
        F.col("asked"), F.col("cell").alias("new_prefix"), F.col("before").alias("new_below"), F.when(alone, F.when(F.col("some") >= F.col("rows"), F.col("low")).otherwise(F.col("low") - 1)).alias("new_cut"),
        F.when((F.col("some") > 0) & (F.col("some") < F.col("rows")), F.col("low")).alias("new_at"), F.col("some").alias("new_some"),
    )
    found = plan.join(edge, F.col("source").eqNullSafe(F.col("asked")), "left")
    return found.select(
        "source", "source_size", "target", "whole", "budget",
        F.coalesce("new_prefix", "prefix").alias("prefix"), F.coalesce("new_below", "below").alias("below"),
        F.when(F.col("open"), F.coalesce("new_cut", "cut")).otherwise(F.col("cut")).alias("cut"),
        F.coalesce("new_at", "at").alias("at"), F.coalesce(F.when(F.col("new_at").isNotNull(), F.col("new_some")), "some").alias("some"),
        (F.col("open") & F.col("new_prefix").isNotNull() & F.col("new_cut").isNull()).alias("open"),
    )


def _with(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Rows joined to their source's plan; the plan is broadcast only if its counted rows are few."""
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col(key)))


def _with_copies(rows: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (source, hash, ...) with their source's plan and ``copies``, how often each is taken."""
    joined = _with(rows, plan.withColumnRenamed("source", "plan_source"), "plan_source")
    times = F.col("whole") + (F.col("hash") <= F.col("cut")).cast("long")
    if plan.filter("at IS NOT NULL").isEmpty():
        return joined.withColumn("copies", times)
    cut_through = F.coalesce(F.col("hash") == F.col("at"), F.lit(False))
    # equal rows are numbered in the parts that they were written in, and the parts one after the other
    edge = scratch.table(joined.filter(cut_through).withColumn("part", F.spark_partition_id()), "edge")
    before = Window.partitionBy("edge_source").orderBy("edge_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = edge.groupBy(F.col("source").alias("edge_source"), F.col("part").alias("edge_part")).agg(F.count(F.lit(1)).alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = edge.join(parts.drop("n"), F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("part") == F.col("edge_part")))
    place = F.col("earlier") + F.row_number().over(Window.partitionBy("source", "part").orderBy("hash"))
    placed = placed.withColumn("copies", F.col("whole") + (place <= F.col("some")).cast("long"))
    rest = joined.filter(~cut_through).withColumn("copies", times)
    return rest.unionByName(placed.select(*rest.columns))


def measure(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, source, size and hash of every row, read from the text once."""
    return scratch.table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash")), "measured")


def mix_report(docs: DataFrame, weights: list[int] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """One row a document: its size, its source's size and target, the words that the mix takes from it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    measured = measure(docs, scratch)
    plan = thresholds(measured, scratch, list(weights), share, max_repeats)
    joined = _with_copies(measured, plan, scratch)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, weights: list[int] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns and no others."""
    scratch = Scratch(docs.sparkSession, "mixing")
    plan = thresholds(measure(docs, scratch), scratch, list(weights), share, max_repeats)
    packed = docs.select(F.struct(*all_columns(docs)).alias("row"), "source", row_hash(F.col("doc_id"), F.col("text")).alias("hash"))  # so that no column of the input meets one of the plan's
    taken = _with_copies(packed, plan, scratch).filter("copies > 0").select("row", "copies")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op1_mix(spark, sf_dir):
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH measured AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM measured GROUP BY source
), capped AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / ((place - 1) % 3 + 1) AS ratio FROM sizes
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM capped WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, place LIMIT 1
), plan AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM level) * weight) AS target FROM levels
), asked AS (
  SELECT *, CAST(least(3, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)) AS BIGINT) AS whole FROM plan
), groups AS (
  SELECT source, hash, sum(size) AS words, count(*) AS n FROM measured GROUP BY source, hash
), run AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM groups
), edges AS (
  SELECT a.source, r.hash, r.n, CASE WHEN r.before + r.words <= a.target - a.whole * a.source_size THEN r.n
    ELSE CAST(floor((a.target - a.whole * a.source_size - r.before) * r.n / r.words + 0.5) AS BIGINT) END AS part
  FROM asked a JOIN run r ON a.source IS NOT DISTINCT FROM r.source WHERE a.whole < 3 AND r.before <= a.target - a.whole * a.source_size
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source, hash) AS place FROM measured
)
SELECT m.doc_id, m.size, a.source_size, a.target, (a.whole + CASE WHEN m.place <= e.part THEN 1 ELSE 0 END) * m.size AS taken,
       m.source, a.whole + CASE WHEN m.place <= e.part THEN 1 ELSE 0 END AS copies
FROM placed m JOIN asked a ON m.source IS NOT DISTINCT FROM a.source LEFT JOIN edges e ON m.source IS NOT DISTINCT FROM e.source AND m.hash = e.hash
"""
