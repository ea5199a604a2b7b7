import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicelake.functions import pcm
from voicelake.functions import text as T
from voicelake.operators.inference import apply_engine, translate_direct
from voicelake.operators.quality import word_edits
from voicelake.operators.resample import resample_bandlimited
from voicelake.sources import framelog, tables, wav


def one(spark, values, column):
    return spark.createDataFrame([([float(v) for v in values],)], "x array<double>").select(column(F.col("x")).alias("y")).first()[0]


def test_conversions(spark):
    assert one(spark, [-2.0, -1.5, 1.5, 2.0], pcm.to_int_pcm) == [-32767, -32767, 32767, 32767]
    assert one(spark, [2.0, -2.0], lambda c: pcm.to_int_pcm(c, "i32")) == [2147483647, -2147483647]
    assert one(spark, [0.5, 0.5, 1, 0, -0.5, 0.5], pcm.mixdown_stereo) == [0.5, 0.5, 0.0]
    assert one(spark, [1.0], pcm.mixdown_stereo) == []
    assert one(spark, [0.5, 1, -0.5], pcm.upmix_mono) == [0.5, 0.5, 1, 1, -0.5, -0.5]
    assert len(one(spark, [1.0] * 5, lambda c: pcm.align_frames(c, 2))) == 4
    assert one(spark, [], pcm.rms) == 0
    both = spark.createDataFrame([([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]],)], "x array<array<double>>").select(pcm.interleave(F.col("x"))).first()[0]
    assert both == [1, 4, 2, 5, 3, 6]


@pytest.mark.parametrize("n,source,target,want", [(4800, 48000, 16000, 1600), (1600, 16000, 48000, 4800), (3777, 24000, 48000, 7554)])
def test_bandlimited_length_and_level(spark, n, source, target, want):
    wave = np.sin(np.arange(n) * 0.02) * 0.4
    chunks = [(1, k, [float(x) for x in wave[k : k + 800]]) for k in range(0, n, 800)]
    df = spark.createDataFrame(chunks, "id long, start_frame long, samples array<double>")
    out = np.concatenate([r["samples"] for r in sorted(resample_bandlimited(df, "id", source, target).collect(), key=lambda r: r["start_frame"])])
    assert len(out) == want
    inner = slice(want // 5, -want // 5)
    ideal = np.sin(np.arange(want) * source / target * 0.02) * 0.4
    assert np.abs(out[inner] - ideal[inner]).max() < 0.01


def as_file(kind, bits, channels, samples, extensible=False, odd=False):
    """A WAV file by hand, with a chunk of odd size before the data."""
    whole = {16: 32767, 24: 8388607, 32: 2147483647}
    if kind == 3:
        body = np.asarray(samples, "<f4").tobytes()
    elif bits == 24:
        body = b"".join(int(round(x * whole[24])).to_bytes(3, "little", signed=True) for x in samples)
    else:
        body = np.round(np.asarray(samples) * whole[bits]).astype(f"<i{bits // 8}").tobytes()
    spec = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, 16000, 16000 * channels * bits // 8, channels * bits // 8, bits)
    spec += struct.pack("<HHIH14x", 22, bits, 0, kind) if extensible else b""
    chunks = b"fmt " + struct.pack("<I", len(spec)) + spec + (b"LIST" + struct.pack("<I", 3) + b"abc\0" if odd else b"") + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


@pytest.mark.parametrize("kind, bits, channels, extensible", [(1, 16, 1, False), (1, 24, 2, False), (1, 32, 1, True), (3, 32, 2, False), (3, 32, 1, True), (1, 24, 1, True)])
def test_wav_formats_in_ranges(spark, tmp_path, kind, bits, channels, extensible):
    """Every format, read by ranges that are shorter than the file; the chunks are those of one range."""
    x = np.sin(np.arange(9000 * channels) * 0.01) * 0.7
    (tmp_path / "a.wav").write_bytes(as_file(kind, bits, channels, x, extensible, odd=True))
    for limit in (1 << 20, 4001):
        rows = sorted(wav.read_audio_corpus(spark, str(tmp_path), 700, limit).collect(), key=lambda r: r["chunk_id"])
        assert [(r["chunk_id"], r["start_frame"], r["channels"], r["error"]) for r in rows] == [(k, 700 * k, channels, None) for k in range(13)]
        assert np.abs(np.concatenate([r["samples"] for r in rows]) - x).max() < 1e-4


def test_wav_faults_and_empty_folders(spark, tmp_path):
    good = as_file(1, 16, 1, [0.1] * 5)
    for name, data in {"riff": b"RIFFxxxxWAVE", "none": b"", "cut": good[:-4], "kind": as_file(1, 16, 3, [0.0] * 3), "zero": as_file(1, 16, 1, []), "good": good}.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[1][:-4]: r for r in wav.read_audio_corpus(spark, str(tmp_path), range_bytes=40).collect()}
    errors = {k: r["error"] for k, r in rows.items()}
    assert errors == {"riff": "no fmt or data chunk", "none": "not a RIFF/WAVE file", "cut": "truncated chunk", "kind": "3 channels", "zero": None, "good": None}
    assert rows["zero"]["samples"] == [] and len(rows["good"]["samples"]) == 5
    (tmp_path / "sub").mkdir()
    assert wav.read_audio_corpus(spark, str(tmp_path / "sub")).count() == 0


def test_a_file_of_over_two_gigabytes(tmp_path):
    """A sparse file: its last range is read by itself, at its place."""
    frames = 600_000_000
    head = b"RIFF" + struct.pack("<I", 36 + 4 * frames) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 48000, 192000, 4, 32) + b"data" + struct.pack("<I", 4 * frames)
    with open(tmp_path / "long.wav", "wb") as file:
        file.write(head)
        file.seek(44 + 4 * (frames - 1))
        file.write(struct.pack("<f", 0.5))
    reader = wav._WavReader(str(tmp_path), 1_000_000, 128 << 20)
    ranges = reader.partitions()
    assert len(ranges) == -(-(44 + 4 * frames) // (128 << 20))
    starts = [row for batch in reader.read(ranges[-1]) for row in zip(batch.column("start_frame").to_pylist(), batch.column("samples"), strict=True)]
    assert starts[-1][0] == 599_000_000 and starts[-1][1].values.to_numpy()[-1] == 0.5
    assert starts[0][0] - 1_000_000 < (ranges[-1].first - 44) // 4 <= starts[0][0]


def test_wav_files_and_composites(spark, tmp_path, monkeypatch):
    """Recordings out of order and in small batches come back as they were; a composite has its zeros."""
    rng = np.random.RandomState(1)
    whole = {name: rng.rand(2000 + 300 * k).astype(np.float32) * 2 - 1 for k, name in enumerate(["a", "b/ä", "c"])}
    rows = [(name, at, 16000, 1, x[at : at + 130].tolist()) for name, x in whole.items() for at in range(0, len(x), 130)] + [(None, 0, 16000, 1, [0.5])]
    np.random.RandomState(2).shuffle(rows)
    monkeypatch.setattr(wav, "MOST_RIFF", wav.MOST_RIFF)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(n, int(at), r, c, s) for n, at, r, c, s in rows], "name string, start_frame long, rate int, channels int, samples array<float>")
        wav.write_audio_corpus(df, "name", str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    back = {r["path"].rsplit("/", 1)[1]: np.array(r["samples"]) for r in wav.read_audio_corpus(spark, str(tmp_path / "out"), 100_000).collect()}
    assert set(back) == {"a.wav", "b%2F%C3%A4.wav", "c.wav"}
    for name, x in whole.items():
        got = back[{"b/ä": "b%2F%C3%A4"}.get(name, name) + ".wav"]
        assert len(got) == len(x) and np.abs(got * 32768 / 32767 - x).max() < 1e-4
    clips = df.filter("name IS NOT NULL").withColumn("all", F.lit("all"))
    wav.write_audio_corpus(wav.concat_with_gap(clips, "all", "start_frame", 50).select("all", F.col("start_sample").alias("start_frame"), F.lit(16000).alias("rate"), F.lit(1).alias("channels"), "samples"), "all", str(tmp_path / "one"))
    one = wav.read_audio_corpus(spark, str(tmp_path / "one"), 1_000_000).first()
    assert len(one["samples"]) == sum(map(len, whole.values())) + 50 * (len(rows) - 1) and not any(one["samples"][-50:])


def test_a_header_beyond_four_gigabytes(tmp_path):
    head = wav.wav_header(3_000_000_000, 48000, 1)
    with open(tmp_path / "x.wav", "wb") as file:
        file.write(head)
        file.truncate(len(head) + 6_000_000_000)
    with open(tmp_path / "x.wav", "rb") as file:
        assert wav.read_header(file, len(head) + 6_000_000_000) == wav.WavHeader(1, 16, 48000, 1, len(head), 3_000_000_000)


@pytest.mark.parametrize("source, target", [(48000, 16000), (16000, 48000), (24000, 48000), (44100, 16000)])
def test_resampling_of_any_chunks(spark, source, target):
    """Chunks of 5 samples, uneven ones, and one whole chunk give the same; so do small blocks."""
    x = np.sin(np.arange(3777) * 0.02) * 0.4
    cuts = {"whole": [0, len(x)], "five": list(range(0, len(x), 5)) + [len(x)], "odd": sorted({0, len(x), *np.random.RandomState(4).randint(0, len(x), 60).tolist()})}
    rows = [(name, a, x[a:b].tolist()) for name, at in cuts.items() for a, b in zip(at, at[1:])] + [("odd", len(x), [])]
    df = spark.createDataFrame(rows, "id string, start_frame long, samples array<double>").repartition(3)
    outs = []
    for block in (1 << 15, 200):
        got = sorted(resample_bandlimited(df, "id", source, target, block).collect(), key=lambda r: r["start_frame"])
        for name in cuts:
            mine = [r for r in got if r["id"] == name]
            assert all(r["start_frame"] == sum(len(q["samples"]) for q in mine[:k]) for k, r in enumerate(mine))
            outs.append(np.concatenate([r["samples"] for r in mine]))
    assert {len(o) for o in outs} == {-(-len(x) * target // source)}
    assert max(np.abs(o - outs[0]).max() for o in outs) < 1e-6


def test_frame_log(spark, tmp_path):
    good = struct.pack(framelog.PREFIX, framelog.MAGIC, 1, 3, 2, 4) + b"{}" + bytes(4)
    bad = {"m": (b"XXXX", 1, 0, 0, 0), "v": (framelog.MAGIC, 99, 0, 0, 0), "h": (framelog.MAGIC, 1, 0, 9999, 0), "p": (framelog.MAGIC, 1, 0, 0, 3)}
    for name, prefix in bad.items():
        (tmp_path / name).write_bytes(good + struct.pack(framelog.PREFIX, *prefix))
    rows = framelog.read_frame_log(spark, str(tmp_path), 128, 256).collect()
    assert {r["path"][-1]: r["reject_reason"] for r in rows if r["reject_reason"]} == {"m": "magic", "v": "version", "h": "header", "p": "alignment"}
    assert sum(r["reject_reason"] is None for r in rows) == 4


@pytest.mark.parametrize("text,want", [
    ("The boats came home before the storm, they wrote.", ["The boats came home before the storm,", "they wrote."]),
    ("Dear all, is the river rising? Please call back soon!", ["Dear all, is the river rising?", "Please call back soon!"]),
    ("Done. ok", ["Done. ok"]), ("Wait. a b", ["Wait.", "a b"]), ("  ", []), (None, []),
])
def test_clauses(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.split_clauses(F.col("t"))).first()[0] == want


def test_lexicon_and_tags(spark):
    df = spark.createDataFrame([("Good morning team, the wire", "pt-BR")], "t string, l string")
    got = df.select(T.lexical_translate(F.col("t"), F.lit("en"), F.col("l"), {"good morning": "bom dia"}, {"team": "equipe"}, {}), T.primary_language(F.col("l")), T.voice_family(F.col("l"))).first()
    assert tuple(got) == ("Bom dia equipe, the wire", "pt", "p")


def test_words_are_mapped_once(spark):
    rows = [(" One two \n", "en-US", "pt-BR"), ("Two, Um", "pt", "en"), (" as is ", "de", "en"), (None, "en", "pt"), ("a+b $1", "en", "pt")]
    df = spark.createDataFrame(rows, "t string, s string, l string")
    got = df.select(T.lexical_translate(F.col("t"), F.col("s"), F.col("l"), {"a+b": "$2"}, {"one": "two", "two": "three"}, {"um": "one"})).collect()
    assert [r[0] for r in got] == ["Two three", "Two, One", "as is", "", "$2 $1"]


def test_word_edits(spark):
    df = spark.createDataFrame([("a b c d", "a x c")], "a string, b string")
    assert df.select(word_edits(F.col("a"), F.col("b"))).first()[0] == 2


def test_engine_errors_are_rows(spark):
    def factory():
        def model(x):
            if x == "no":
                raise NotImplementedError("no")
            if x == "bad":
                raise ValueError("bad")
            return x.upper(), 2.0

        return model

    rows = {r["t"]: r["test"] for r in apply_engine(spark.createDataFrame([("ok",), ("no",), ("bad",)], "t string"), "test", factory, "t").collect()}
    assert rows["ok"]["output"] == "OK" and rows["no"]["code"] == "UNSUPPORTED_CAPABILITY" and rows["bad"]["code"] == "INFERENCE_FAILED"


def test_direct_translation(spark):
    echo = lambda: lambda x: (x, 1.0)
    df = spark.createDataFrame([(1, "One two three, four. Five six"), (2, " ")], "id long, t string")
    rows = translate_direct(df, ["id"], "t", echo, echo).collect()
    assert [(r["id"], r["clauses"], r["tts_ms"]) for r in rows] == [(1, 3, 3.0)]


def test_tables(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"b": 1}\n\n{"a": 2}\n')
    df = tables.read_bench_jsonl(spark, str(tmp_path / "a.jsonl"))
    tables.write_bench_csv(df, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part*")).read_text().splitlines()[0] == "a,b"
    doc = json.loads(tables.manifest(spark.createDataFrame([("s2", 1.23456789), ("s1", 2.0)], "sample_id string, duration_s double"), "d").first()[0])
    assert [s["sample_id"] for s in doc["samples"]] == ["s1", "s2"] and doc["samples"][1]["duration_s"] == 1.234568


def test_normalize_corpus(spark):
    from voicelake.operators.resample import normalize_corpus

    stereo = [float(x) for k in range(4800) for x in (0.1, 0.3)]
    df = spark.createDataFrame([(1, 0, stereo)], "id long, start_frame long, samples array<double>")
    out = normalize_corpus(df, "id", (48000, 2), (16000, 1)).first()["samples"]
    assert len(out) == 1600 and abs(out[800] - 0.2) < 0.01
    assert len(normalize_corpus(df, "id", (48000, 2), (48000, 2)).first()["samples"]) == 9600


def test_corpus_must_be_full(spark):
    from voicelake.operators.bench import require_full, select_corpus

    rows = spark.createDataFrame([(i, 5.0 if i < 9 else 9.0) for i in range(30)], "id long, s double")
    with pytest.raises(ValueError, match="short"):
        require_full(select_corpus(rows, "s", "id", 7, 12))
