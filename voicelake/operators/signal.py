"""Framing and signal statistics of sample chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voicelake.operators.scan import running


def frame_audio(chunks: DataFrame, keys: list[str], order: str, samples: str, frame_len: int, tail: str = "hold", block: int | None = None) -> DataFrame:
    """Chunks of any length re-cut to fixed frames; the carry crosses chunk edges through offsets, not through state.

    A chunk gives at most its frames' fragments; fragments of a frame meet again by key and frame.
    With ``block`` so many numbers of chunks of a recording share a task; else a recording is one task.
    """
    if block:
        placed = running(chunks, keys, [order], F.floor(F.col(order) / block), {"_at": ("sum", F.size(samples), True)})
    else:
        placed = chunks.withColumn("_at", F.sum(F.size(samples)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.withColumn("_at", F.coalesce("_at", F.lit(0)).cast("long")).filter(F.size(samples) > 0)
    touched = F.explode(F.sequence(F.floor(F.col("_at") / frame_len), F.floor((F.col("_at") + F.size(samples) - 1) / frame_len)))
    cut = placed.withColumn("frame_idx", touched)
    low = F.greatest(F.col("frame_idx") * frame_len - F.col("_at"), F.lit(0))
    high = F.least((F.col("frame_idx") + 1) * frame_len - F.col("_at"), F.size(samples).cast("long"))
    parts = cut.select(*keys, "frame_idx", F.col("_at"), F.slice(samples, (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "part"))), lambda p: p["part"]))
    frames = parts.groupBy(*keys, "frame_idx").agg(joined.alias("samples"))
    return frames if tail == "emit" else frames.filter(F.size("samples") == frame_len)


def signal_profile(chunks: DataFrame, by: list[str], samples: str) -> DataFrame:
    per = chunks.select(
        *by, F.size(samples).cast("long").alias("n"), F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x).alias("q"),
        F.array_max(F.transform(samples, F.abs)).alias("p"), F.size(F.filter(samples, lambda x: x != 0)).cast("long").alias("z"),
    )
    return per.groupBy(*by).agg(
        F.sum("n").alias("samples"), F.coalesce(F.sqrt(F.try_divide(F.sum("q"), F.sum("n"))), F.lit(0.0)).alias("rms"), F.max("p").alias("peak"), F.sum("z").alias("nonzero")
    )


def signal_loss(chunks: DataFrame, by: list[str], samples: str, stages: tuple[str, ...] = ("a", "b", "c", "d")) -> DataFrame:
    """Nonzero samples a stage, side by side; lost if the last stage has fewer than the first."""
    wide = signal_profile(chunks, [*by, "stage"], samples).groupBy(*by).pivot("stage", list(stages)).agg(F.sum("nonzero"))
    filled = wide.select(*by, *[F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in stages])
    return filled.withColumn("lost", F.col(stages[-1]) < F.col(stages[0]))


def fill_silence(frames: DataFrame, keys: list[str], at: str, step: str, level: str) -> DataFrame:
    """A gap-free series a key; missing places get level 0."""
    spine = frames.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi")).select(*keys, F.explode(F.expr(f"sequence(_lo, _hi, {step})")).alias(at))
    return spine.join(frames.withColumn("_has", F.lit(True)), [*keys, at], "left").select(*keys, at, F.coalesce(level, F.lit(0.0)).alias(level), F.col("_has").isNull().alias("is_fill"))


def detect_discontinuities(chunks: DataFrame, keys: list[str], number: str) -> DataFrame:
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(number))
    return chunks.withColumn("discontinuity", F.coalesce(F.col(number) - before != 1, F.lit(False)))
