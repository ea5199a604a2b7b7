"""Queries of segmentation; events of a user, in time order, stand for a stream of levels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voicelake.operators.scan import running
from voicelake.operators.segment import SegmentConfig, gather, segment_facts, segment_utterances
from voicelake.operators.segment import sweep_segmentation as sweep
from voicelake.plans.registry import query, table

CFG = SegmentConfig(start=60.0, keep=30.0, pre_roll=2, min_voiced=2, end_quiet=3, max_frames=None)


def levels(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.col("value").alias("rms"), "event_id")


LEVELS = "levels AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS rms, event_id FROM events)"


def machine_sql(keys: str, source: str, start: str, keep: str, quiet: str, least: str, pre: str) -> str:
    return f"""
loud AS (SELECT *, max(CASE WHEN rms >= {keep} THEN frame_idx END) OVER (PARTITION BY {keys} ORDER BY frame_idx) AS loud FROM {source}),
closers AS (SELECT *, CASE WHEN rms < {keep} AND frame_idx - coalesce(loud, -1) = {quiet} THEN 1 ELSE 0 END AS closer FROM loud),
epochs AS (SELECT *, coalesce(sum(closer) OVER (PARTITION BY {keys} ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM closers),
onsets AS (SELECT *, min(CASE WHEN rms >= {start} THEN frame_idx END) OVER (PARTITION BY {keys}, epoch) AS onset FROM epochs),
spans AS (SELECT {keys}, epoch, min(onset) AS onset, max(frame_idx) AS end_frame, max(closer) AS closed,
          count(CASE WHEN frame_idx >= onset AND rms >= {keep} THEN 1 END) AS voiced_frames FROM onsets GROUP BY {keys}, epoch HAVING min(onset) IS NOT NULL),
resets AS (SELECT *, coalesce(lag(end_frame) OVER (PARTITION BY {keys} ORDER BY epoch) + 1, 0) AS reset FROM spans),
utterances AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY epoch) AS utterance_id, CAST(onset - least({pre}, onset - reset) AS BIGINT) AS start_frame,
               CAST(end_frame AS BIGINT) AS end_frame, voiced_frames, closed = 0 AS forced_cutoff FROM resets WHERE voiced_frames >= {least})"""


SEGMENTS = f"WITH {LEVELS}, {machine_sql('stream_id', 'levels', '60', '30', '3', '2', '2')}"


@query(SEGMENTS + " SELECT *, (end_frame - start_frame + 1) * 320 AS n_samples, (end_frame - start_frame + 1) * 320 * 1000 // 16000 AS duration_ms FROM utterances", name="segment_utterances")
def segments(spark, sf_dir):
    return segment_facts(segment_utterances(levels(spark, sf_dir).drop("event_id"), CFG, ["stream_id"]), 320, 16000)


@query(SEGMENTS + " SELECT stream_id, count(*) AS n, max(utterance_id) AS last_id, sum(CAST(forced_cutoff AS INT))::BIGINT AS forced FROM utterances GROUP BY stream_id")
def flush_tail(spark, sf_dir):
    found = segment_utterances(levels(spark, sf_dir).drop("event_id"), CFG, ["stream_id"])
    return found.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.max("utterance_id").alias("last_id"), F.sum(F.col("forced_cutoff").cast("int")).alias("forced"))


@query(
    f"WITH {LEVELS}, grid(cfg_id, start, keep, quiet) AS (VALUES (1, 60.0, 30.0, 2), (2, 60.0, 30.0, 3), (3, 75.0, 20.0, 5)), both_sides AS (SELECT * FROM levels CROSS JOIN grid), "
    + machine_sql("cfg_id, stream_id", "both_sides", "start", "keep", "quiet", "2", "2")
    + " SELECT cfg_id, count(*) AS utterances, sum(voiced_frames)::BIGINT AS voiced, sum(end_frame - start_frame + 1)::BIGINT AS frames FROM utterances GROUP BY cfg_id"
)
def sweep_segmentation(spark, sf_dir):
    configs = {i: SegmentConfig(start, keep, 2, 2, quiet, None) for i, start, keep, quiet in ((1, 60.0, 30.0, 2), (2, 60.0, 30.0, 3), (3, 75.0, 20.0, 5))}
    found = sweep(levels(spark, sf_dir), configs, ["stream_id"])
    return found.groupBy("cfg_id").agg(F.count(F.lit(1)).alias("utterances"), F.sum("voiced_frames").alias("voiced"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("frames"))


@query(SEGMENTS + " SELECT u.stream_id, u.utterance_id, count(*) AS n, string_agg(CAST(l.event_id AS VARCHAR), ',' ORDER BY l.frame_idx) AS ids FROM utterances u JOIN levels l ON l.stream_id = u.stream_id AND l.frame_idx BETWEEN u.start_frame AND u.end_frame GROUP BY ALL")
def gather_samples(spark, sf_dir):
    frames = levels(spark, sf_dir)
    inside = gather(segment_utterances(frames.drop("event_id"), CFG, ["stream_id"]), frames, "stream_id")
    ordered = F.array_sort(F.collect_list(F.struct("frame_idx", "event_id")))
    return inside.groupBy("stream_id", "utterance_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT vec_id, 1::BIGINT AS utterance_id, 0::BIGINT AS start_frame, len(embedding)::BIGINT AS n_samples, true AS forced_cutoff, len(embedding)::BIGINT * 1000000 // 16000 AS end_us FROM embeddings WHERE len(embedding) > 0")
def whole_recording_segments(spark, sf_dir):
    n = F.size("embedding").cast("long")
    return table(spark, sf_dir, "embeddings").filter(n > 0).select(
        "vec_id", F.lit(1).cast("long").alias("utterance_id"), F.lit(0).cast("long").alias("start_frame"), n.alias("n_samples"), F.lit(True).alias("forced_cutoff"), F.floor(n * 1000000 / 16000).alias("end_us")
    )


#: The plain machine, a step a frame, with a cap of 12 frames.
CAPPED = f"""WITH RECURSIVE {LEVELS}, machine(stream_id, f, first, idle, voiced, quiet, begun, heard, cut) AS (
  SELECT DISTINCT stream_id, -1::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN FROM levels
  UNION ALL
  SELECT stream_id, f, CASE WHEN over THEN -1 ELSE first END, CASE WHEN over OR first >= 0 THEN 0 ELSE idle + 1 END, CASE WHEN over THEN 0 ELSE voiced END, CASE WHEN over THEN 0 ELSE quiet END,
         CASE WHEN over AND voiced >= 2 THEN first END, CASE WHEN over AND voiced >= 2 THEN voiced END, CASE WHEN over AND voiced >= 2 THEN quiet < 3 END
  FROM (SELECT *, first >= 0 AND (quiet >= 3 OR f - first + 1 >= 12) AS over FROM (
    SELECT stream_id, f, idle, first, CASE WHEN first < 0 THEN 0 WHEN rms >= 30 THEN voiced + 1 ELSE voiced END AS voiced, CASE WHEN first < 0 OR rms >= 30 THEN 0 ELSE quiet + 1 END AS quiet FROM (
      SELECT m.stream_id, l.frame_idx AS f, l.rms, m.idle, m.voiced, m.quiet, CASE WHEN m.first < 0 AND l.rms >= 60 THEN l.frame_idx - least(2, m.idle) ELSE m.first END AS first
      FROM machine m JOIN levels l ON l.stream_id = m.stream_id AND l.frame_idx = m.f + 1)))
), found AS (
  SELECT stream_id, begun AS start_frame, f AS end_frame, heard AS voiced_frames, cut AS forced_cutoff FROM machine WHERE begun IS NOT NULL
  UNION ALL SELECT stream_id, first, f, voiced, true FROM machine JOIN (SELECT stream_id, max(frame_idx) AS f FROM levels GROUP BY stream_id) USING (stream_id, f) WHERE first >= 0 AND voiced >= 2
) SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_frame) AS utterance_id, * EXCLUDE (stream_id) FROM found"""


@query(CAPPED)
def capped_segments(spark, sf_dir):
    return segment_utterances(levels(spark, sf_dir).drop("event_id"), SegmentConfig(60.0, 30.0, 2, 2, 3, 12), ["stream_id"])


@query(
    "WITH levels AS (SELECT 0 AS stream_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS frame_idx, value AS rms FROM events), "
    + machine_sql("stream_id", "levels", "60", "30", "3", "2", "2")
    + " SELECT * FROM utterances"
)
def one_stream_segments(spark, sf_dir):
    """All events as one stream: numbered by blocks of an hour, segmented by blocks of frames, so that no task holds the stream."""
    events = table(spark, sf_dir, "events").select(F.lit(0).alias("stream_id"), "ts", "event_id", F.col("value").alias("rms"))
    numbered = running(events, ["stream_id"], ["ts", "event_id"], F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000), {"n": ("count", F.lit(1), False)})
    frames = numbered.select("stream_id", (F.col("n") - 1).alias("frame_idx"), "rms")
    return segment_utterances(frames, CFG, ["stream_id"], span=4096)
