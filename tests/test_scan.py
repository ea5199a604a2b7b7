"""Two-level scans: the same rows as windows by key, with no task that holds a key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voicelake.operators.scan import running
from voicelake.operators.segment import Machine, SegmentConfig, _blocked, segment_utterances
from voicelake.operators.signal import frame_audio
from voicelake.operators.telemetry import backpressure_episodes, in_flight, occupancy


def rows_of(df):
    return sorted(map(str, df.collect()))


def series(spark, seed=1, n=400):
    """Unordered rows of three keys, one of them null, with gaps, null values and a column whose name has a dot."""
    rng = random.Random(seed)
    rows = [(k, at, rng.choice([None, -3, 1, 4, 20]), f"r{at}") for k in ("a", None, "b") for at in rng.sample(range(-50, 2 * n), n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "`k.1` string, at long, v long, `x.y` string")


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_running_is_the_window(spark, width, levels):
    df = series(spark)
    kinds = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}
    measures = {f"{kind}_{without}": (kind, F.col("v"), without) for kind in kinds for without in (False, True)}
    got = running(df, ["k.1"], ["at"], F.floor(F.col("at") / width), measures, levels)
    by_key = Window.partitionBy("`k.1`").orderBy("at")
    want = df.select("*", *[kinds[kind](F.col("v")).over(by_key.rowsBetween(Window.unboundedPreceding, -1 if without else 0)).alias(name) for name, (kind, _, without) in measures.items()])
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_running_without_rows_or_keys(spark):
    df = series(spark)
    two = df.filter("`k.1` = 'a'").withColumnRenamed("x.y", "y")
    got = running(two, [], ["at", "y"], F.floor(F.col("at") / 9), {"n": ("count", F.col("v"), False)})
    assert rows_of(got) == rows_of(two.withColumn("n", F.count("v").over(Window.orderBy("at", "y").rowsBetween(Window.unboundedPreceding, 0))))
    assert running(two.limit(0), [], ["at"], F.col("at"), {"n": ("sum", F.col("v"), True)}).count() == 0


@pytest.mark.parametrize("case", range(6))
def test_blocked_segments_are_the_machines(spark, case):
    """Streams of many blocks, one with a null key; runs of quiet and of speech cross any number of blocks."""
    rng = random.Random(case)
    cap = [None, None, None, None, 12, 40][case]
    cfg = SegmentConfig(0.015, 0.008, rng.randint(0, 5), rng.randint(1, 6), rng.randint(1, 9), cap)
    many = {k: [x for _ in range(30) for x in [rng.choice([0, None, 0.01, 0.02])] * rng.randint(1, 12)] for k in range(12)}
    many[20], many[21], many[22] = [0.0] * 300, [0.02] * 300, [0.02]
    if not cap:
        many[None] = [0.0] * 50 + [0.02] * 30
    rows = [(k, i, x if x is None else float(x)) for k, s in many.items() for i, x in enumerate(s)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream long, frame_idx long, rms double")
    for on_end in ("emit", "discard"):
        want = []
        for k, s in many.items():
            machine = Machine(cfg)
            found = [machine.push(i, x or 0.0) for i, x in enumerate(s)] + ([machine.flush(len(s) - 1)] if on_end == "emit" else [])
            want += [(k, *x) for x in found if x]
        for span in (None, 1, 7):
            got = segment_utterances(df, cfg, ["stream"], on_end, span)
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), span


def test_one_stream_runs_in_all_tasks(spark):
    """One stream of all rows: the rows of each operator are spread over the tasks, none of which has half of them."""
    df = spark.range(20_000).select(F.lit(1).alias("stream"), F.col("id").alias("frame_idx"), (F.pmod(F.xxhash64("id"), F.lit(3)) * 0.01).alias("rms"))
    asked = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = running(df, ["stream"], ["frame_idx"], F.floor(F.col("frame_idx") / 100), {"n": ("count", F.col("rms"), False)})
        per_task = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(per_task) == 4 and max(r["n"] for r in per_task) < 10_000
        cfg = SegmentConfig(min_voiced=1, end_quiet=2, max_frames=None)
        frames, spans = _blocked(df, ["stream"], cfg, 100)
        per_task = frames.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(per_task) == 4 and max(r["n"] for r in per_task) < 10_000
        assert "ReusedExchange" in spans._jdf.queryExecution().executedPlan().toString()  # levels are exchanged once
        assert rows_of(segment_utterances(df, cfg, ["stream"], span=100)) == rows_of(segment_utterances(df, cfg, ["stream"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", asked)


@pytest.mark.parametrize("width", [1, 6, 10_000])
def test_buffers_and_frames_by_blocks(spark, width):
    df, block = series(spark, 5).withColumnRenamed("k.1", "k").withColumnRenamed("x.y", "y"), F.floor(F.col("at") / width)
    delta = F.coalesce("v", F.lit(0))
    assert rows_of(occupancy(df, ["k"], ["at"], delta, 100, 48000, block)) == rows_of(occupancy(df, ["k"], ["at"], delta, 100, 48000))
    assert rows_of(backpressure_episodes(df, ["k"], ["at"], "v", 20, 1, block)) == rows_of(backpressure_episodes(df, ["k"], ["at"], "v", 20, 1))
    spans = df.select("k", "y", "at", F.when(F.col("v").isNotNull(), F.col("at") + F.abs("v")).alias("until"))
    assert rows_of(in_flight(spans, ["k"], "y", "at", "until", 3, block)) == rows_of(in_flight(spans, ["k"], "y", "at", "until", 3))
    chunks = df.filter("at >= 0").select("k", "at", F.expr("transform(sequence(1, coalesce(abs(v), 1)), i -> CAST(at * 100 + i AS DOUBLE))").alias("s"))
    for tail in ("hold", "emit"):
        assert rows_of(frame_audio(chunks, ["k"], "at", "s", 16, tail, width)) == rows_of(frame_audio(chunks, ["k"], "at", "s", 16, tail))
