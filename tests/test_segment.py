"""Segmentation: closed form, fold, stream and a plain machine agree."""

import random

import numpy as np
import pytest

from voicelake.operators.segment import Machine, SegmentConfig, segment_utterances


def plain(series, cfg):
    m = Machine(cfg)
    out = [m.push(i, x) for i, x in enumerate(series)]
    out.append(m.flush(len(series) - 1) if series else None)
    return [x for x in out if x]


def frames(spark, many):
    return spark.createDataFrame([(k, i, float(x)) for k, s in enumerate(many) for i, x in enumerate(s)], "stream_id long, frame_idx long, rms double")


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["stream_id"], r["utterance_id"])):
        out.setdefault(r["stream_id"], []).append(tuple(r)[1:])
    return out


def test_fixture(spark):
    series = [0.001] * 10 + [0.25] * 20 + [0.001] * 20
    got = segment_utterances(frames(spark, [series]), SegmentConfig(), ["stream_id"]).collect()
    assert [(r["start_frame"], r["end_frame"], r["forced_cutoff"]) for r in got] == [(5, 47, False)]


def test_short_tone_gives_nothing(spark):
    assert segment_utterances(frames(spark, [[0.0] * 25 + [0.2] * 2 + [0.0] * 25]), SegmentConfig(), ["stream_id"]).count() == 0


@pytest.mark.parametrize("case", range(3))
def test_random_series(spark, case):
    rng = random.Random(case)
    cfg = SegmentConfig(0.015, 0.008, rng.randint(0, 5), rng.randint(2, 6), rng.randint(1, 6), [None, 12, 40][case])
    many = [[rng.choice([0, 0.005, 0.01, 0.02]) for _ in range(rng.randint(1, 80))] for _ in range(300)]
    want = {k: v for k, s in enumerate(many) if (v := plain(s, cfg))}
    assert collected(segment_utterances(frames(spark, many), cfg, ["stream_id"])) == want


def test_stream_equals_batch(spark):
    from voicelake.plans.live import stream_segments
    from voicelake.plans.segments import CFG, levels

    stream = stream_segments(spark, "/root/testdata/sf0.001").collect()
    batch = segment_utterances(levels(spark, "/root/testdata/sf0.001").drop("event_id"), CFG, ["stream_id"], on_end="discard").collect()
    assert sorted(tuple(r)[:-1] for r in stream) == sorted(map(tuple, batch))


def test_empty(spark):
    assert segment_utterances(frames(spark, []), SegmentConfig(), ["stream_id"]).count() == 0
    assert np.isfinite(SegmentConfig().start)


def test_sweep_is_one_exchange_of_levels(spark):
    """Each configuration as by itself; the plan's exchange does not depend on the number of configurations."""
    import random

    from voicelake.operators.segment import sweep_segmentation

    rng = random.Random(7)
    rows = [(s, k, rng.choice([0.0, 0.005, 0.01, 0.02])) for s in (1, 2, None) for k in range(200)]
    df = spark.createDataFrame(rows, "stream long, frame_idx long, rms double").repartition(3)
    configs = {k: SegmentConfig(0.015, 0.008, k % 3, 1 + k, 1 + k % 4, 9 if k % 2 else None) for k in range(5)}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = sweep_segmentation(df, configs, ["stream"])
        got = sorted(map(str, found.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = []
    for cfg_id, cfg in configs.items():
        for s in (1, 2, None):
            machine = Machine(cfg)
            found_here = [x for _, k, level in [r for r in rows if r[0] == s] if (x := machine.push(k, level))]
            if last := machine.flush(199):
                found_here.append(last)
            want += [(cfg_id, s, *x) for x in found_here]
    assert got == sorted(map(str, spark.createDataFrame(want, found.schema).collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Generate" not in plan


def test_long_epochs_go_through_one_pass(spark):
    """Runs of long epochs over the bounds of batches; no table is made a run."""
    rng = random.Random(9)
    rows = [(s, k, rng.choice([0.0, 0.4, 0.6, 0.9, 0.9])) for s in (1, 2) for k in range(400)]
    cfg = SegmentConfig(0.5, 0.3, 2, 2, 3, 12)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = segment_utterances(spark.createDataFrame(rows, "stream_id long, frame_idx long, rms double"), cfg, ["stream_id"])
        got = collected(found)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == {s: plain([x for k, _, x in rows if k == s], cfg) for s in (1, 2)}
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
