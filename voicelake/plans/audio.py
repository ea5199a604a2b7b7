"""Queries of sample arrays; a row of embeddings stands for a chunk of PCM, its label for the stream."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voicelake.functions import pcm
from voicelake.operators import signal
from voicelake.plans.registry import query, table
from voicelake.sources import wav

SAMPLES = "s AS (SELECT vec_id, label, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("samples", F.transform("embedding", lambda x: x.cast("double")))


def _rows(df, samples, *keys):
    return df.select("vec_id", *keys, F.posexplode(samples).alias("i", "sample"))


@query(f"WITH {SAMPLES} SELECT vec_id, i, trunc(least(1, greatest(-1, x)) * 32767)::INT AS sample FROM s")
def to_int_pcm(spark, sf_dir):
    return _rows(_chunks(spark, sf_dir), F.transform(pcm.to_int_pcm(F.col("samples")), lambda x: x.cast("int")))


@query(f"WITH {SAMPLES} SELECT vec_id, i, round(trunc(least(1, greatest(-1, x)) * 32767) / 32768.0, 6) AS sample FROM s")
def to_float_pcm(spark, sf_dir):
    return _rows(_chunks(spark, sf_dir), F.transform(pcm.to_float_pcm(pcm.to_int_pcm(F.col("samples"))), lambda x: F.round(x.cast("double"), 6)))


@query(f"WITH {SAMPLES} SELECT vec_id, (i // 2)::INT AS i, round((max(CASE WHEN i % 2 = 0 THEN x END) + max(CASE WHEN i % 2 = 1 THEN x END)) * 0.5, 6) AS sample FROM s GROUP BY vec_id, i // 2 HAVING count(*) = 2")
def mixdown_stereo(spark, sf_dir):
    return _rows(_chunks(spark, sf_dir), F.transform(pcm.mixdown_stereo(F.col("samples")), lambda x: F.round(x, 6)))


@query(f"WITH {SAMPLES} SELECT vec_id, count(*) * 2 AS n, round(sum(x) * 2, 4) AS total FROM s GROUP BY vec_id")
def upmix_mono(spark, sf_dir):
    up = _chunks(spark, sf_dir).withColumn("u", pcm.upmix_mono(F.col("samples")))
    return up.select("vec_id", F.size("u").cast("long").alias("n"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH {SAMPLES} SELECT vec_id, i % 2 AS channel, (i // 2)::INT AS i, round(x, 6) AS sample FROM s")
def deinterleave(spark, sf_dir):
    both = _chunks(spark, sf_dir).withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1))))
    return _rows(both, F.transform(pcm.channel(F.col("samples"), 2, F.col("channel")), lambda x: F.round(x, 6)), "channel")


@query("SELECT vec_id, len(embedding) // 3 * 3 AS kept, len(embedding) % 3 AS dropped FROM embeddings")
def align_frames(spark, sf_dir):
    kept = F.size(pcm.align_frames(F.col("embedding"), 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", kept.cast("long").alias("kept"), (F.size("embedding") - kept).cast("long").alias("dropped"))


@query("SELECT p_partkey, p_size * 1000 AS rate, p_size * 1000 * 2 AS frame_bytes, p_size * 1000 * 20 // 1000 AS samples_20ms, 48000 * 1000 // (p_size * 1000) AS duration_ms, ceil(4800 * 16000.0 / (p_size * 1000))::BIGINT AS frames_16k, p_size * 1000 <> 16000 AS converts FROM part")
def format_facts(spark, sf_dir):
    rate = (F.col("p_size") * 1000).cast("long")
    return table(spark, sf_dir, "part").select(
        "p_partkey", rate.alias("rate"), (rate * 2).alias("frame_bytes"), F.floor(rate * 20 / 1000).alias("samples_20ms"), F.floor(F.lit(48000 * 1000) / rate).alias("duration_ms"),
        F.ceil(F.lit(4800 * 16000.0) / rate).alias("frames_16k"), (rate != 16000).alias("converts"),
    )


@query("""SELECT label, r AS target_rate, c AS target_channels, b AS sample_bytes, sum(ceil(len(embedding) * r / 24000.0))::BIGINT AS frames, sum(ceil(len(embedding) * r / 24000.0) * c * b)::BIGINT AS bytes
FROM embeddings CROSS JOIN (VALUES (16000, 1, 4), (48000, 2, 2)) AS t(r, c, b) GROUP BY label, r, c, b""")
def format_totals(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select("label", F.size("embedding").cast("long").alias("frames"), F.lit(24000).cast("long").alias("rate"))
    return pcm.format_totals(chunks, ["label"], [(16000, 1, 4), (48000, 2, 2)])


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms FROM embeddings")
def frame_levels(spark, sf_dir):
    return _chunks(spark, sf_dir).select("vec_id", "label", F.round(pcm.rms(F.col("samples")), 6).alias("rms"))


@query(f"""WITH {SAMPLES}, o AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS p FROM s), n AS (SELECT label, count(*) // 48 AS whole FROM o GROUP BY label)
SELECT o.label, p // 48 AS frame_idx, count(*) AS n, round(sqrt(sum(x * x) / 48), 6) AS rms FROM o JOIN n USING (label) WHERE p // 48 < whole GROUP BY o.label, p // 48""")
def frame_audio(spark, sf_dir):
    frames = signal.frame_audio(_chunks(spark, sf_dir), ["label"], "vec_id", "samples", 48)
    return frames.select("label", "frame_idx", F.size("samples").cast("long").alias("n"), F.round(pcm.rms(F.col("samples")), 6).alias("rms"))


@query(f"WITH {SAMPLES} SELECT label, count(*) AS samples, round(sqrt(sum(x * x) / count(*)), 6) AS rms, round(max(abs(x)), 6) AS peak, count(CASE WHEN x <> 0 THEN 1 END) AS nonzero FROM s GROUP BY label")
def signal_profile(spark, sf_dir):
    p = signal.signal_profile(_chunks(spark, sf_dir), ["label"], "samples")
    return p.select("label", "samples", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), "nonzero")


@query(f"""WITH {SAMPLES}, g AS (SELECT label, vec_id % 4 AS stage, count(CASE WHEN x <> 0 THEN 1 END) AS nz FROM s GROUP BY ALL)
SELECT label, coalesce(sum(nz) FILTER (stage = 0), 0)::BIGINT AS a, coalesce(sum(nz) FILTER (stage = 1), 0)::BIGINT AS b, coalesce(sum(nz) FILTER (stage = 2), 0)::BIGINT AS c, coalesce(sum(nz) FILTER (stage = 3), 0)::BIGINT AS d,
coalesce(sum(nz) FILTER (stage = 3), 0) < coalesce(sum(nz) FILTER (stage = 0), 0) AS lost FROM g GROUP BY label""")
def signal_loss(spark, sf_dir):
    return signal.signal_loss(_chunks(spark, sf_dir).withColumn("stage", F.element_at(F.array(*[F.lit(x) for x in "abcd"]), (F.col("vec_id") % 4 + 1).cast("int"))), ["label"], "samples")


@query("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, len(embedding) AS n, greatest(1, round_even(len(embedding) * 16000.0 / 24000.0, 0))::INT AS m FROM embeddings), p AS (SELECT *, unnest(range(0, m))::INT AS i FROM m),
q AS (SELECT *, i * n / m AS pos, least(floor(i * n / m)::INT, n - 1) AS lo FROM p) SELECT vec_id, i, round(e[lo + 1] + (e[least(lo + 1, n - 1) + 1] - e[lo + 1]) * (pos - lo), 6) AS sample FROM q""")
def resample_linear(spark, sf_dir):
    return _rows(_chunks(spark, sf_dir), F.transform(pcm.resample_linear(F.col("samples"), 24000, 16000), lambda x: F.round(x, 6)))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hour, sum(value) AS level FROM events GROUP BY ALL), b AS (SELECT user_id, min(hour) AS lo, max(hour) AS hi FROM h GROUP BY user_id),
s AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM b) SELECT s.user_id, CAST(s.hour AS VARCHAR) AS hour, round(coalesce(level, 0), 4) AS level, level IS NULL AS is_fill FROM s LEFT JOIN h USING (user_id, hour)""")
def fill_silence(spark, sf_dir):
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("value").alias("level"))
    filled = signal.fill_silence(hours, ["user_id"], "hour", "INTERVAL 1 HOUR", "level")
    return filled.select("user_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), F.round("level", 4).alias("level"), "is_fill")


@query("SELECT user_id, event_id, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <> 1, false) AS discontinuity FROM events")
def detect_discontinuities(spark, sf_dir):
    return signal.detect_discontinuities(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("""WITH c AS (SELECT label, vec_id, embedding, len(embedding) AS n FROM embeddings)
SELECT label, (sum(n + 100) OVER (PARTITION BY label ORDER BY vec_id) - n - 100)::BIGINT AS start_sample, (n + 100)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total,
CASE WHEN n > 0 THEN embedding[1]::DOUBLE ELSE 0 END AS first FROM c""")
def concat_with_gap(spark, sf_dir):
    """A label's chunks as one composite, 100 zeros after each."""
    clips = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").alias("samples"))
    done = wav.concat_with_gap(clips, "label", "vec_id", 100)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return done.select("label", "start_sample", F.size("samples").cast("long").alias("n"), F.round(total, 4).alias("total"), F.col("samples")[0].cast("double").alias("first"))
