"""Streaming queries: tables are read as file streams, run to their end and read back."""

import numpy as np
from pyspark.sql import functions as F

from voicelake.operators.inference import translate_cascade
from voicelake.operators.scan import running
from voicelake.operators.segment import segment_stream
from voicelake.plans.registry import query, table
from voicelake.plans.segments import CFG, LEVELS, SEGMENTS, levels, machine_sql
from voicelake.plans.transcripts import CLAUSES
from voicelake.sources.tables import read_chunk_stream
from voicelake.streaming import live
from voicelake.workspace import fresh


def _run(df, mode: str):
    """Runs a stream to its end into a Parquet table (append) or a table of its last state (complete)."""
    spark, place = df.sparkSession, fresh(df.sparkSession, "stream")
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{place}/out")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/out")
    df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/out")


def _run_parts(parts: list, place: str, made):
    """Runs a stream over a folder that the parts are written to one after another, each of as many files as its tasks make.

    The query goes on from its checkpoint after each part, so that a part is a batch however many files it has.
    """
    spark = parts[0].sparkSession
    out = fresh(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(place)
        df = made(spark.readStream.schema(part.schema).parquet(place))
        df.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/out")


def _stream(spark, sf_dir: str, name: str):
    static = table(spark, sf_dir, name)
    rows = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern, since a stream's plain path has to be a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in static.columns else rows


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, count(CASE WHEN event_type = 'error' THEN 1 END) AS underruns, count(*) AS n FROM events GROUP BY 1")
def stream_slo(spark, sf_dir):
    done = _run(live.slo_windows(_stream(spark, sf_dir, "events"), "ts", "1 hour", "2 hours"), "complete")
    return done.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "underruns", "n")


@query("SELECT conv_id, arg_max(text, turn + CASE WHEN role = 'assistant' THEN 1000000 ELSE 0 END) AS text, CASE WHEN bool_or(role = 'assistant') THEN 'committed' ELSE 'provisional' END AS state FROM conversations GROUP BY conv_id")
def stream_commit(spark, sf_dir):
    parts = _stream(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "assistant").alias("is_final"), F.col("turn").alias("chunk_id"), "text")
    return _run(live.commit_partials(parts, "conv_id"), "complete")


@query("SELECT user_id, sum(event_id % 7)::BIGINT AS received, sum(event_id % 5)::BIGINT AS emitted, count(CASE WHEN event_id % 5 = 0 THEN 1 END) AS underruns FROM events GROUP BY user_id")
def stream_metrics(spark, sf_dir):
    moved = _stream(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("requested"), (F.col("event_id") % 5).alias("moved"))
    return _run(live.live_metrics(moved, ["user_id"]), "complete")


@query("SELECT event_id, user_id, value FROM events")
def stream_dedupe(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    doubled = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return _run(live.dedupe_chunks(doubled, ["event_id"], "ts", "1 hour").drop("ts"), "append")


@query(SEGMENTS + " SELECT *, 0::BIGINT AS late FROM utterances WHERE NOT forced_cutoff")
def stream_segments(spark, sf_dir):
    """Closed utterances of the streaming machine; the frames come in files dealt without regard to their order, a file a batch."""
    place = fresh(spark, "levels")
    levels(spark, sf_dir).select("stream_id", "frame_idx", "rms").repartition(5, F.xxhash64("stream_id", "frame_idx")).write.parquet(place)
    source = spark.readStream.schema("stream_id long, frame_idx long, rms double").option("maxFilesPerTrigger", 1).parquet(place)
    return _run(segment_stream(source, CFG), "append")


@query("""WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WHERE value >= 30), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, CAST(date_trunc('second', min(ts)) AS VARCHAR) AS start, count(*) AS voiced FROM s GROUP BY user_id, k""")
def voiced_sessions(spark, sf_dir):
    """Sessions of a stream of voiced events, by its last state."""
    voiced = _stream(spark, sf_dir, "events").filter("value >= 30")
    done = _run(live.voiced_sessions(voiced, "user_id", "ts", "6 hours", "1 day"), "complete")
    return done.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "voiced")


_LONG = "levels AS (SELECT user_id % 4 AS stream_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS frame_idx, value AS rms FROM events)"


@query(f"WITH {_LONG}, {machine_sql('stream_id', 'levels', '60', '30', '3', '2', '2')} SELECT *, 0::BIGINT AS late FROM utterances WHERE NOT forced_cutoff")
def stream_long_segments(spark, sf_dir):
    """Four streams of all events; the odd frames come first, and the even ones set them free."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("stream_id"), "ts", "event_id", F.col("value").alias("rms"))
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    rows = running(rows, ["stream_id"], ["ts", "event_id"], hour, {"n": ("count", F.lit(1), False)}).select("stream_id", (F.col("n") - 1).cast("long").alias("frame_idx"), "rms")
    return _run_parts([rows.filter(F.col("frame_idx") % 2 == odd) for odd in (1, 0)], fresh(spark, "levels"), lambda source: segment_stream(source, CFG))


_LEGS = f"""WITH {LEVELS}, legs AS (SELECT stream_id, 'outgoing' AS direction, frame_idx, rms FROM levels UNION ALL SELECT stream_id, 'incoming', frame_idx, 100 - rms FROM levels),
{machine_sql('direction, stream_id', 'legs', '60', '30', '3', '2', '2')}"""


@query(_LEGS + """ SELECT stream_id, direction, CASE direction WHEN 'outgoing' THEN 'pt' ELSE 'en' END AS source, CASE direction WHEN 'outgoing' THEN 'en' ELSE 'pt' END AS target,
utterance_id, start_frame, end_frame, voiced_frames FROM utterances WHERE NOT forced_cutoff""")
def stream_legs(spark, sf_dir):
    """Both legs of every call in one job, languages swapped, from files of chunks to committed batches."""
    place, out = fresh(spark, "legs"), fresh(spark, "translations")
    rows = levels(spark, sf_dir).select("stream_id", "frame_idx", "rms")
    both = rows.withColumn("direction", F.lit("outgoing")).unionByName(rows.withColumns({"rms": 100 - F.col("rms"), "direction": F.lit("incoming")}))
    both.repartition(3, F.xxhash64("stream_id", "frame_idx")).write.parquet(place)
    chunks = read_chunk_stream(spark, place, "stream_id long, frame_idx long, rms double, direction string", 1)
    languages = lambda df: df.withColumns({"source": F.when(F.col("direction") == "outgoing", "pt").otherwise("en"), "target": F.when(F.col("direction") == "outgoing", "en").otherwise("pt")})
    found = live.stream_pipeline(chunks, CFG, stage=languages)
    live.write_translations(found, out, f"{out}-state").awaitTermination()
    return live.read_translations(spark, out, found.schema).select("stream_id", "direction", "source", "target", "utterance_id", "start_frame", "end_frame", "voiced_frames")


@query("""SELECT o_orderkey AS request_id, strftime(o_orderdate, '%Y-%m-%d') AS sent, strftime(min(l_shipdate), '%Y-%m-%d') AS answered, CASE WHEN min(l_shipdate) IS NULL THEN 'timeout' ELSE 'ok' END AS status
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey, o_orderdate""")
def stream_timeouts(spark, sf_dir):
    """Orders with the first shipment inside 30 days, a row each, from messages in three spans of time and a last tick."""
    place, day = fresh(spark, "messages"), 86_400_000
    sent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit("sent").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("at"))
    got = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.lit("answered").alias("kind"), F.col("l_shipdate").cast("timestamp").alias("at"))
    messages = sent.unionByName(got)
    low, high = messages.agg(F.min("at"), F.max("at")).first()
    third = (high - low) / 3
    parts = [messages.filter((F.col("at") >= F.lit(low + k * third)) & ((F.col("at") < F.lit(low + (k + 1) * third)) if k < 2 else F.lit(True))) for k in range(3)]
    tick = spark.range(1).select(F.lit(None).cast("long").alias("request_id"), F.lit("tick").alias("kind"), (F.lit(high) + F.expr("INTERVAL 100 DAYS")).alias("at"))
    done = _run_parts([*parts, tick], place, lambda source: live.correlate_stream(source, 30 * day, day))
    dated = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return done.select("request_id", dated("sent"), dated("answered"), "status")


#: What the recogniser says for the steps of a level, and the translator's word for each.
HEARD = ["boats", "came,", "home", "before", "the", "storm.", "they", "wrote"]
MEANT = ["barcos", "vieram,", "casa", "antes", "da", "chuva.", "eles", "disseram"]
LOUD, FULL, WORDS = 0.095, 0.325, 9


def _recogniser():
    """Words by the levels of the first samples; nothing is heard of quiet chunks, and overdriven ones fail."""

    def hear(samples):
        x = np.abs(samples.astype(np.float64))
        if len(x) and x.max() > FULL:
            raise ValueError("overdriven")
        return ("" if not len(x) or x.max() < LOUD else " ".join(HEARD[int(v * 40) % 8] for v in x[:WORDS])), float(len(x))

    return hear


def _translator():
    words = dict(zip(HEARD, MEANT, strict=True))
    return lambda text: (" ".join(words[w] for w in text.split(" ")), float(len(text)))


def _speaker():
    """A level a letter."""
    return lambda text: ([ord(c) / 128 for c in text], float(len(text)))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_SPEECH = CLAUSES.replace("FROM conversations", "FROM spoken")


@query(rf"""WITH chunks AS (SELECT label AS conv_id, vec_id AS turn, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS x FROM embeddings),
heard AS (SELECT conv_id, turn, list_transform(x[1:{WORDS}], lambda v: {_LIST(MEANT)}[floor(v * 40)::BIGINT % 8 + 1]) AS ws FROM chunks WHERE list_max(x) BETWEEN {LOUD} AND {FULL}),
spoken AS (SELECT conv_id, turn, array_to_string(ws, ' ') AS text FROM heard), {_SPEECH}
SELECT conv_id AS label, turn AS vec_id, array_to_string(c, ' ') AS translated_text, len(c)::BIGINT AS clauses, list_sum(list_transform(c, lambda p: len(p)))::BIGINT AS n_samples, 0::BIGINT AS failed_clauses, 'success' AS status, NULL::VARCHAR AS code FROM clauses
UNION ALL SELECT conv_id, turn, NULL, 0, NULL, 0, 'failed', 'INFERENCE_FAILED' FROM chunks WHERE list_max(x) > {FULL}""")
def speech_cascade(spark, sf_dir):
    """Chunks of samples through recognition, translation and synthesis, samples again: models that compute, on arrays."""
    chunks = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    done = translate_cascade(chunks, ["label", "vec_id"], "embedding", _recogniser, _translator, _speaker, audio="array<float>")
    return done.select("label", "vec_id", "translated_text", "clauses", F.when(F.col("samples").isNotNull(), F.size("samples")).cast("long").alias("n_samples"), "failed_clauses", "status", "code")


LEXICON = {"the": "o", "and": "e", "with": "com"}


def _said(text):
    """A stand-in for a translation model: each word looked up once."""
    if len(text) % 11 == 0:
        raise NotImplementedError("no model for this length")
    return " ".join(LEXICON.get(w, w) for w in text.split(" ")), 2.0


_CASCADE = CLAUSES.replace("FROM conversations", "FROM spoken")
_SAID = f"list_transform(string_split(text, ' '), lambda w: coalesce(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in LEXICON.items())}}}[w], w))"


@query(rf"""WITH spoken AS (SELECT conv_id, turn, array_to_string({_SAID}, ' ') AS text FROM conversations WHERE trim(text) <> '' AND len(text) % 11 <> 0), {_CASCADE}
SELECT conv_id, turn, array_to_string(c, ' ') AS translated_text, len(c)::BIGINT AS clauses, 2.0::DOUBLE AS mt_ms, 3.0 * len(c)::DOUBLE AS tts_ms, 0::BIGINT AS failed_clauses, 'success' AS status, NULL::VARCHAR AS failed_stage, NULL::VARCHAR AS code FROM clauses
UNION ALL SELECT conv_id, turn, NULL, 0, NULL, 0, 0, 'failed', 'translation', 'UNSUPPORTED_CAPABILITY' FROM conversations WHERE trim(text) <> '' AND len(text) % 11 = 0""")
def cascade_translations(spark, sf_dir):
    """Turns through recognition, word-by-word translation and synthesis; failed utterances keep a row."""
    heard, spoken = lambda: lambda text: (text, 1.0), lambda: lambda text: (text, 3.0)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return translate_cascade(turns, ["conv_id", "turn"], "text", heard, lambda: _said, spoken).drop("message")
