"""Band-limited resampling of long recordings in blocks with halos."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelake.functions import pcm

#: Zero crossings of the windowed sinc on each side.
REACH = 24


def resample_block(samples: np.ndarray, first: int, out_first: int, out_count: int, source: int, target: int) -> np.ndarray:
    """Outputs out_first.. of a recording from input samples that start at place ``first``."""
    cut = min(1.0, target / source)
    half = int(ceil(REACH / cut))
    position = np.arange(out_first, out_first + out_count) * (source / target)
    base = np.floor(position).astype(np.int64)
    taps = base[:, None] + np.arange(-half + 1, half + 1)[None, :]
    distance = position[:, None] - taps
    weight = cut * np.sinc(cut * distance) * (0.5 + 0.5 * np.cos(np.pi * np.clip(distance / half, -1, 1)))
    inside = (taps >= first) & (taps < first + len(samples))
    values = np.where(inside, samples[np.clip(taps - first, 0, max(len(samples) - 1, 0))] if len(samples) else 0.0, 0.0)
    return (values * weight).sum(axis=1).astype(np.float32)


#: Frames of a block at the source's rate.
BLOCK = 1 << 15


def resample_bandlimited(chunks: DataFrame, key: str, source: int, target: int, block: int = BLOCK) -> DataFrame:
    """(key, start_frame, samples) at one rate -> the same at another, in blocks; ceil(n target / source) samples in all.

    Chunks may have any length. Each sends the parts of itself that a block of ``block`` frames needs, its own and the
    filter's reach on both sides, to that block; the parts meet by an exchange on key and block. So a block knows its whole
    neighbourhood however small the chunks are, and a recording spreads over tasks. Missing frames are silent.
    """
    if source == target:
        return chunks.select(key, "start_frame", "samples")
    half = int(ceil(REACH / min(1.0, target / source))) + 1
    end = F.col("start_frame") + F.size("samples")
    first, last = F.greatest(F.floor((F.col("start_frame") - half) / block), F.lit(0)), F.floor((end - 1 + half) / block)
    asked = chunks.filter(F.size("samples") > 0).select(key, "start_frame", "samples", F.explode(F.sequence(first, last)).alias("_block"))
    low = F.greatest(F.col("_block") * block - half - F.col("start_frame"), F.lit(0))
    high = F.least((F.col("_block") + 1) * block + half - F.col("start_frame"), F.size("samples"))
    parts = asked.select(key, "_block", (F.col("start_frame") + low).alias("start_frame"), F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("samples")).filter(F.size("samples") > 0)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("start_frame")
        at, starts = table.column("_block")[0].as_py() * block, table.column("start_frame").to_numpy()
        own = [x.values.to_numpy(zero_copy_only=False) for x in table.column("samples")]
        origin, stop = int(starts[0]), int(max(s + len(x) for s, x in zip(starts, own, strict=True)))
        samples = np.zeros(stop - origin)
        for s, x in zip(starts, own, strict=True):
            samples[s - origin : s - origin + len(x)] = x
        stop = min(at + block, stop)
        out_first, out_stop = -(-at * target // source), -(-stop * target // source)
        rows = 1 if out_stop > out_first else 0
        found = resample_block(samples, origin, out_first, out_stop - out_first, source, target) if rows else None
        return pa.table({key: table.column(key).slice(0, rows), "start_frame": pa.array([out_first][:rows], pa.int64()), "samples": pa.array([found][:rows], pa.list_(pa.float32()))})

    kind = dict(chunks.dtypes)[key]
    return parts.groupBy(key, "_block").applyInArrow(run, f"{key} {kind}, start_frame long, samples array<float>")


def normalize_corpus(chunks: DataFrame, key: str, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(rate, channels) to (rate, channels): mixdown, resample and upmix, each only where the formats differ.

    start_frame counts frames at the source's rate before and at the target's after.
    """
    out = chunks.select(key, "start_frame", "samples")
    if source[1] == 2 and (target[1] == 1 or source[0] != target[0]):
        out = out.withColumn("samples", pcm.mixdown_stereo(F.col("samples")))
    mono = source[1] == 1 or source[0] != target[0] or target[1] == 1
    out = resample_bandlimited(out, key, source[0], target[0])
    return out.withColumn("samples", pcm.upmix_mono(F.col("samples"))) if mono and target[1] == 2 else out
