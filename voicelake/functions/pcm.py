"""Sample conversions as array expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = {"i16": 32768.0, "i24": 8388608.0, "i32": 2147483648.0}


def to_float_pcm(samples: Column, source: str = "i16") -> Column:
    return F.transform(samples, lambda x: (x / F.lit(SCALE[source])).cast("float"))


def to_int_pcm(samples: Column, target: str = "i16") -> Column:
    """Clamps to [-1, 1] and truncates toward zero; computed in double, so 32-bit targets saturate."""
    top, kind = (32767.0, "short") if target == "i16" else (2147483647.0, "int")
    return F.transform(samples, lambda x: (F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x.cast("double"))) * F.lit(top)).cast(kind))


def mixdown_stereo(samples: Column) -> Column:
    """Mean of each complete pair; an odd last sample is left out."""
    pairs = F.floor(F.size(samples) / 2).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), lambda i: (F.get(samples, 2 * i).cast("double") + F.get(samples, 2 * i + 1).cast("double")) * 0.5)
    return F.when(pairs > 0, both).otherwise(F.array().cast("array<double>"))


def upmix_mono(samples: Column) -> Column:
    return F.flatten(F.transform(samples, lambda x: F.array(x, x)))


def channel(samples: Column, n: int, c: Column) -> Column:
    return F.filter(samples, lambda x, i: i % n == c)


def interleave(channels: Column) -> Column:
    """An array of equally long channels as one array."""
    frames = F.coalesce(F.size(F.get(channels, F.lit(0))), F.lit(0))
    laid = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(frames - 1, F.lit(0))), lambda i: F.transform(channels, lambda c: F.get(c, i))))
    return F.when(frames > 0, laid).otherwise(F.slice(F.flatten(channels), 1, 0))


def align_frames(samples: Column, channels: int) -> Column:
    return F.slice(samples, F.lit(1), (F.floor(F.size(samples) / channels) * channels).cast("int"))


def rms(samples: Column) -> Column:
    """Root mean square in double; 0 of nothing."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def resample_linear(samples: Column, source: int, target: int) -> Column:
    """Linear interpolation on end-exclusive grids, clamped at the edge; as it is for one sample or equal rates."""
    if source == target:
        return samples
    n = F.size(samples)
    m = F.greatest(F.lit(1), F.bround(n * F.lit(float(target)) / F.lit(float(source))).cast("int"))

    def at(i: Column) -> Column:
        position = i * n / m
        low = F.least(F.floor(position).cast("int"), n - 1)
        one, two = F.get(samples, low).cast("double"), F.get(samples, F.least(low + 1, n - 1)).cast("double")
        return one + (two - one) * (position - low)

    return F.when(n > 1, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.transform(samples, lambda x: x.cast("double")))


def format_totals(recordings: DataFrame, by: list[str], targets: list[tuple[int, int, int]]) -> DataFrame:
    """(by, frames, rate) -> a row a target format (rate, channels, bytes a sample): all its frames, rounded up a recording, and bytes."""
    formats = F.explode(F.array(*[F.struct(F.lit(r).alias("target_rate"), F.lit(c).alias("target_channels"), F.lit(b).alias("sample_bytes")) for r, c, b in targets]))
    target = recordings.withColumn("_t", formats).select(*by, "frames", "rate", "_t.*")
    out = F.expr("(frames * CAST(target_rate AS BIGINT) + rate - 1) div rate")
    sums = target.withColumn("out", out).groupBy(*by, "target_rate", "target_channels", "sample_bytes").agg(F.sum("out").alias("frames"))
    return sums.withColumn("bytes", F.col("frames") * F.col("target_channels") * F.col("sample_bytes"))
