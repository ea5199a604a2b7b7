"""Streams whose rows come out of order, late or twice; ranks of large groups; models a worker."""

import random
import time
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voicelake.operators import inference, telemetry
from voicelake.operators.inference import apply_engine
from voicelake.operators.segment import Machine, SegmentConfig
from voicelake.streaming import live
from voicelake.workspace import fresh

cloudpickle.register_pickle_by_value(__import__(__name__))  # workers do not have this module
CFG = SegmentConfig(0.5, 0.3, 2, 2, 3, 12)


def plain(levels):
    machine = Machine(CFG)
    return [x for k, level in enumerate(levels) if (x := machine.push(k, level))]


def run(spark, batches, schema, tmp_path, **more):
    """Batches as files, one a trigger."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = live.stream_pipeline(source, CFG, "out", **more)
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()


def test_shuffled_levels(spark, tmp_path):
    rng = random.Random(1)
    streams = {s: [rng.choice([0.0, 0.1, 0.4, 0.6, 0.9]) for _ in range(70)] for s in range(3)}
    rows = [(s, k, x) for s, levels in streams.items() for k, x in enumerate(levels)]
    rng.shuffle(rows)
    rows += rows[:20]  # copies come last
    _, got = run(spark, [rows[k::4] for k in range(4)], "stream_id long, frame_idx long, rms double", tmp_path)
    for s, levels in streams.items():
        assert sorted(tuple(r)[1:6] for r in got if r["stream_id"] == s) == plain(levels)
    assert {r["direction"] for r in got} == {"out"}


def test_chunks_of_any_length(spark, tmp_path):
    """Frames run over the bounds of chunks and batches; a model stage follows, and its failures are rows."""
    rng, frame = np.random.RandomState(2), 16
    samples = (rng.rand(frame * 90) * np.repeat(rng.choice([0.1, 1.6], 90), frame)).tolist()
    levels = np.sqrt(np.mean(np.array(samples).reshape(-1, frame) ** 2, axis=1))
    cuts = sorted({0, len(samples), *rng.randint(0, len(samples), 40).tolist()})
    chunks = [(7, k, samples[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    random.Random(3).shuffle(chunks)

    def odd():
        def model(x):
            if x % 2:
                raise ValueError("odd")
            return str(x), 1.0

        return model

    stage = lambda df: apply_engine(df, "stt", odd, "utterance_id")
    _, got = run(spark, [chunks[::2], chunks[1::2]], "stream_id long, seq long, samples array<double>", tmp_path, frame=frame, order="seq", value="samples", stage=stage)
    want = plain(levels)
    assert len(want) > 3 and sorted(tuple(r)[1:6] for r in got) == want
    assert {r["utterance_id"]: r["stt"]["status"] for r in got} == {u[0]: "failed" if u[0] % 2 else "success" for u in want}


def test_any_order_of_a_long_stream(spark, tmp_path):
    """6000 frames, the odd ones first; a second stream begins with number 1 and has its halves swapped."""
    rng = random.Random(5)
    streams = {s: [rng.choice([0.0, 0.1, 0.4, 0.6, 0.9]) for _ in range(6000)] for s in (0, 1)}
    rows = [[(0, k, x, 0) for k, x in enumerate(streams[0]) if k % 2 == odd] + [(1, k + 1, x, 1) for k, x in enumerate(streams[1]) if (k < 3000) == odd] for odd in (1, 0)]
    for batch in rows:
        rng.shuffle(batch)
    _, got = run(spark, rows, "stream_id long, frame_idx long, rms double, begins long", tmp_path, first="begins")
    assert sorted(tuple(r)[1:6] for r in got if r["stream_id"] == 0) == plain(streams[0])
    shifted = [(n, start - 1, end - 1, voiced, cut) for n, start, end, voiced, cut in sorted(tuple(r)[1:6] for r in got if r["stream_id"] == 1)]
    assert shifted == plain(streams[1]) and {r["late"] for r in got} == {0}


def test_many_streams_share_states(spark, tmp_path):
    """900 short streams and one long one with its odd frames first: a state a group and a block of held frames, not one a stream and a frame."""
    rng = random.Random(11)
    streams = {(s,): [rng.choice([0.0, 0.4, 0.6, 0.9]) for _ in range(8000 if s == 7 else 12)] for s in range(900)}
    batches = [[(s, k, x) for (s,), levels in streams.items() for k, x in enumerate(levels) if k % 2 == odd] for odd in (1, 0)]
    query, got = run(spark, [batches[0], batches[1] + batches[0][:50]], "stream_id long, frame_idx long, rms double", tmp_path)
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) < 900
    found = {}
    for r in sorted(map(tuple, got)):
        found.setdefault((r[0],), []).append(r[1:6])
    assert found == {s: want for s, levels in streams.items() if (want := plain(levels))}


def test_a_silent_stream_is_flushed(spark, tmp_path):
    """A frame is missing for good: after the silence the held rows follow, and the open utterance ends."""
    levels = [0.9] * 4 + [0.0] * 4 + [0.9] * 3
    rows = [(1, k, x) for k, x in enumerate(levels) if k != 6]
    spark.createDataFrame(rows, "stream_id long, frame_idx long, rms double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id long, frame_idx long, rms double").parquet(str(tmp_path / "in"))
    found = live.stream_pipeline(source, CFG, "out", idle_ms=1500)
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    got, until = [], time.time() + 60
    while len(got) < 2 and time.time() < until:
        time.sleep(1)
        got = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    query.stop()
    machine = Machine(CFG)
    want = [x for k, level in enumerate([x for k, x in enumerate(levels) if k != 6]) if (x := machine.push(k, level))] + [machine.flush(9)]
    assert sorted(tuple(r)[1:6] for r in got) == want


def test_deadlines(spark, tmp_path):
    """First answers, answers before and after their requests, late answers, copies, none; each request gives one row."""
    t = lambda s: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=s)
    batches = [
        [(1, "sent", t(0)), (2, "sent", t(1)), (3, "answered", t(6)), (4, "sent", t(2)), (6, "sent", t(4)), (6, "sent", t(4))],
        [(1, "answered", t(9)), (1, "answered", t(5)), (3, "sent", t(5)), (2, "answered", t(12)), (5, "answered", t(7)), (6, "answered", t(14))],
        [(None, "tick", t(1000))],
        [(2, "answered", t(1001)), (None, "tick", t(5000))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "request_id long, kind string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema("request_id long, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = live.correlate_stream(source, 10_000, 60_000)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["request_id"], r["status"], (r["answered"] - r["sent"]).total_seconds() if r["answered"] else None) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "ok", 5.0), (2, "timeout", None), (3, "ok", 1.0), (4, "timeout", None), (6, "ok", 10.0)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_open_requests_share_states(spark, tmp_path):
    """2000 requests, answers first in every second: as many states as groups, and a row a request."""
    t = lambda s: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=s)
    answers = [(k, "answered", t(k % 7 + (3 if k % 3 else 30))) for k in range(2000)]
    sent = [(k, "sent", t(k % 7)) for k in range(2000)]
    for k, rows in enumerate([answers[::2] + sent[1::2], answers[1::2] + sent[::2], [(None, "tick", t(1000))]]):
        spark.createDataFrame(rows, "request_id long, kind string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema("request_id long, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = live.correlate_stream(source, 10_000, 60_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert 0 < max(held) <= live.GROUPS and held[-1] == 0
    got = {(r["request_id"], r["status"], (r["answered"] - r["sent"]).total_seconds() if r["answered"] else None) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(k, "ok", 3.0) if k % 3 else (k, "timeout", None) for k in range(2000)}


def test_counters_of_many_batches(spark, tmp_path):
    """More batches than a query keeps reports of: late rows and transfers all count."""
    schema = "k int, ts timestamp, requested long, moved long"
    t = lambda s: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=s)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    counters = live.run_counters(spark)
    try:
        for k in range(12):
            rows = [(k, t(1000 * k), 10, 7), (k, t(0), 5, 0)]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k:02d}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        found = live.counted(source).withColumn("event_type", F.lit("error"))
        query = live.slo_windows(found, "ts", "1 minute", "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        late, sums = counters.of(query)
        assert len(query.recentProgress) <= 3
    finally:
        spark.streams.removeListener(counters)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert sums == {"received": 180, "emitted": 84, "underruns": 12}
    assert late == 9  # late rows are told by the watermark of the batch before the last


def test_a_batch_is_committed_once(spark, tmp_path):
    """The job dies after a batch was written and before it was committed; the next run replaces what was written."""
    rng = random.Random(3)
    legs = {d: [rng.choice([0.0, 0.6, 0.9]) for _ in range(60)] for d in ("in", "out")}
    for k in range(3):
        rows = [(1, d, n, x) for d, levels in legs.items() for n, x in enumerate(levels) if n // 20 == k]
        spark.createDataFrame(rows, "stream_id long, direction string, frame_idx long, rms double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    chunks = lambda: spark.readStream.schema("stream_id long, direction string, frame_idx long, rms double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = live.stream_pipeline(chunks(), CFG)
    path, state, written = str(tmp_path / "out"), str(tmp_path / "state"), []

    def fails_once(batch, batch_id):
        batch.write.mode("overwrite").partitionBy("direction").parquet(f"{path}/batch_id={batch_id}")
        written.append(batch_id)
        if batch_id == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        found.writeStream.foreachBatch(fails_once).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert written == [0, 1]
    live.write_translations(live.stream_pipeline(chunks(), CFG), path, state).awaitTermination()
    got = live.read_translations(spark, path, found.schema).collect()
    for d, levels in legs.items():
        assert sorted(tuple(r[c] for c in ("utterance_id", "start_frame", "end_frame", "voiced_frames", "forced_cutoff")) for r in got if r["direction"] == d) == plain(levels)


@pytest.mark.parametrize("whole", [10, 10**9])
def test_ranks_of_one_large_group(spark, whole):
    rng = np.random.RandomState(0)
    x = np.concatenate((rng.lognormal(size=40_000), np.repeat(1.0, 15_000), [np.nan] * 0))
    df = spark.createDataFrame(pd.DataFrame({"g": ["big"] * len(x), "v": x})).unionByName(spark.createDataFrame([(None, 3.0), (None, 1.0), ("few", None)], "g string, v double"))
    telemetry.WHOLE, kept = whole, telemetry.WHOLE
    try:
        got = {r["g"]: r for r in telemetry.latency_stats(df, "v", ["g"]).collect()}
        middle = {r["g"]: r["median"] for r in telemetry.medians(df, ["g"], "v").collect()}
    finally:
        telemetry.WHOLE = kept
    ordered = np.sort(x)
    assert (got["big"]["p95"], got["big"]["p99"], got["big"]["count"]) == (ordered[int(len(x) * 0.95)], ordered[int(len(x) * 0.99)], len(x))
    assert middle == {"big": np.median(x), None: 2.0} and got[None]["p95"] == 3.0 and set(got) == {"big", None}


def test_a_model_is_made_once_a_worker(spark, tmp_path):
    """Two jobs of 16 tasks: as many loads as worker processes, not as tasks; a second model of the stage is its own."""
    place = fresh(spark, "loads")
    import os

    os.makedirs(place.removeprefix("file:"), exist_ok=True)
    folder = place.removeprefix("file:")

    def factory():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda value: (str(os.getpid()), 1.0)

    df = spark.range(64).repartition(16).withColumn("v", F.col("id").cast("string"))
    pids = {r[0] for _ in range(2) for r in apply_engine(df, "stt", factory, "v").select("stt.output").collect()}
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads)) and pids <= set(loads)
    other = apply_engine(df, "stt", lambda: lambda value: ("other", 1.0), "v").select("stt.output").distinct().collect()
    assert [r[0] for r in other] == ["other"]


def poisoned():
    """A model that doubles samples; a batch with a bad row fails as a whole, and how often it was asked is counted."""

    class Model:
        calls = 0

        def batch(self, values):
            self.calls += 1
            if any(np.isnan(v).any() for v in values):
                raise ValueError("bad samples")
            return [(2 * v, float(len(values))) for v in values]

    return Model()


def test_a_poisoned_row_stands_alone(spark):
    """One bad row of 1000 in a batch: it fails, the others do not, and halving asks some twenty times."""
    rows = [(k, [float(k), float("nan") if k == 617 else 1.0]) for k in range(1000)] + [(1000, None), (1001, [])]
    df = spark.createDataFrame(rows, "`a.b` long, samples array<float>").coalesce(1)
    got = {r["a.b"]: r["s2s"] for r in apply_engine(df, "s2s", poisoned, "samples", output="array<float>").collect()}
    assert {k for k, r in got.items() if r["status"] == "failed"} == {617} and got[617]["message"] == "bad samples" and got[617]["code"] == "INFERENCE_FAILED"
    assert got[1000]["status"] == "skipped" and got[1001]["output"] == [] and all(got[k]["output"] == [2.0 * k, 2.0] for k in range(1000) if k != 617)
    import pyarrow as pa

    own = poisoned()
    inference.results(own, pa.array([r[1] for r in rows[:1000]], pa.list_(pa.float32())), pa.list_(pa.float32()))
    assert own.calls <= 21


def test_outputs_of_a_wrong_type_are_rows(spark):
    df = spark.createDataFrame([(k,) for k in range(4)], "k long")
    model = lambda: lambda k: ("text" if k == 2 else [0.5] * k, 1.0)
    got = {r["k"]: r["m"] for r in apply_engine(df, "m", model, "k", output="array<float>").collect()}
    assert got[2]["status"] == "failed" and got[3]["output"] == [0.5] * 3 and got[0]["status"] == "success"
    good, bad = inference.unpack_result(apply_engine(df, "m", model, "k", output="array<float>"), "m")
    assert (good.count(), bad.count()) == (3, 1)


def test_speech_to_speech_and_spoken_samples(spark):
    def model():
        def run(samples):
            if len(samples) == 3:
                raise NotImplementedError("three")
            return -samples, 1.0

        return run

    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0] * 3), (3, []), (4, None)], "k long, samples array<float>")
    got = {r["k"]: r for r in inference.speech_to_speech(df, ["k"], "samples", model).collect()}
    assert set(got) == {1, 2} and got[1]["output"] == [-0.5, -0.25] and (got[2]["status"], got[2]["code"], got[2]["clauses"]) == ("failed", "UNSUPPORTED_CAPABILITY", 0)
    hear = lambda: lambda samples: (" ".join(["Well, we said it all then."] * len(samples)), 5.0)
    say = lambda: lambda text: ([float(len(text))] * 2, 1.0)
    asked = df.withColumn("target", F.when(F.col("k") == 1, "en-GB").otherwise("de"))
    spoken = {r["k"]: r for r in inference.translate_direct(asked, ["k"], "samples", hear, say, target=F.col("target"), audio="array<float>").collect()}
    clauses = spoken[1]["clauses"]
    assert clauses > 1 and len(spoken[1]["samples"]) == 2 * clauses and spoken[1]["samples"][0] == spoken[1]["samples"][1] and spoken[1]["tts_ms"] == clauses
    assert (spoken[2]["status"], spoken[2]["failed_stage"], spoken[2]["code"], spoken[2]["samples"]) == ("failed", "speech_translation", "UNSUPPORTED_CAPABILITY", None)


def test_batches_and_blanks(spark):
    class Model:
        def batch(self, values):
            return [ValueError("bad") if v == "bad" else (v * 2, 1.0) for v in values]

    rows = apply_engine(spark.createDataFrame([("a",), (None,), ("bad",)], "v string"), "s", Model, "v").select("v", "s.status", "s.output").collect()
    assert {tuple(r) for r in rows} == {("a", "success", "aa"), (None, "skipped", None), ("bad", "failed", None)}


def test_models_get_small_parts_of_a_batch_and_the_heard_text_goes_on_once(spark):
    """All workers of a task hold a part at a time; the recognised text is not also kept in the stage's outcome."""
    from pyspark.sql import functions as F

    from voicelake.operators import inference

    class Parts:
        def batch(self, values):
            return [(str(sum(map(len, values))), 0.0)] * len(values)

    texts = spark.range(0, 8000, 1, 1).select("id", F.repeat(F.lit("word "), 100).alias("text"))
    seen = inference.apply_engine(texts, "parts", Parts, "text").select(F.col("parts.output").cast("long").alias("size"))
    assert seen.count() == 8000 and seen.agg(F.max("size")).first()[0] <= 1 << 20
    passed, apply = [], inference.apply_engine
    try:
        inference.apply_engine = lambda df, *a, **k: passed.append(df.schema) or apply(df, *a, **k)
        same = lambda: lambda text: (text, 1.0)
        done = inference.translate_cascade(texts.limit(3), ["id"], "text", same, same, same)
    finally:
        inference.apply_engine = apply
    assert passed[1]["stt"].dataType.names == ["status", "code", "message"] and done.count() == 3
