"""Queries of buffers, latencies and engines; lineitem and events stand for logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voicelake.operators import telemetry as T
from voicelake.plans.registry import query, table


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("requested", F.col("l_quantity").cast("long")).withColumn("moved", F.least(F.col("requested"), F.lit(40)) - F.when(F.col("l_linenumber") == 7, F.least(F.col("requested"), F.lit(40))).otherwise(0))


ITEMS = "t AS (SELECT *, l_quantity::BIGINT AS requested, CASE WHEN l_linenumber = 7 THEN 0 ELSE least(l_quantity::BIGINT, 40) END AS moved FROM lineitem)"


@query(f"WITH {ITEMS} SELECT l_suppkey, sum(requested)::BIGINT AS received, sum(moved)::BIGINT AS emitted, sum((requested - moved) // 2)::BIGINT AS dropped, count(CASE WHEN moved = 0 THEN 1 END) AS underruns, count(CASE WHEN moved + 1 < requested THEN 1 END) AS overruns FROM t GROUP BY l_suppkey")
def audio_counters(spark, sf_dir):
    return T.audio_counters(_items(spark, sf_dir), ["l_suppkey"], channels=2)


LATENCY = "count(*) AS count, min(x) AS min, max(x) AS max, floor(avg(x))::BIGINT AS avg, list_sort(list(x))[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS p95, list_sort(list(x))[least(floor(count(*) * 0.99)::BIGINT, count(*) - 1) + 1] AS p99"


@query(f"SELECT l_returnflag, l_linestatus, {LATENCY} FROM (SELECT *, l_extendedprice AS x FROM lineitem) GROUP BY ALL")
def latency_stats(spark, sf_dir):
    return T.latency_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


@query(f"WITH r AS (SELECT *, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem) SELECT l_suppkey, {LATENCY} FROM r WHERE k <= 20 GROUP BY l_suppkey")
def last_n_latency(spark, sf_dir):
    return T.latency_stats(T.last_n(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], 20), "l_extendedprice", ["l_suppkey"])


@query("""SELECT user_id, event_id, current::BIGINT AS current, round(current / 100, 6) AS fill, current / 100 < 0.1 AS low, current / 100 > 0.9 AS high, round(100 / 48000 * 1000 * (current / 100), 6) AS latency_ms FROM
(SELECT *, sum(CASE WHEN event_type IN ('click', 'view') THEN 5 ELSE -3 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS current FROM events)""")
def occupancy(spark, sf_dir):
    delta = F.when(F.col("event_type").isin("click", "view"), 5).otherwise(-3)
    o = T.occupancy(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], delta, 100, 48000)
    return o.select("user_id", "event_id", "current", F.round("fill", 6).alias("fill"), "low", "high", F.round("latency_ms", 6).alias("latency_ms"))


@query("""WITH m AS (SELECT *, CASE WHEN value >= 80 THEN 1 WHEN value <= 20 THEN 0 END AS mark FROM events), o AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS s FROM m),
p AS (SELECT *, CASE WHEN s = 1 AND coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) = 0 THEN 1 ELSE 0 END AS b FROM o), q AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM p)
SELECT user_id, episode::BIGINT AS episode, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM q WHERE s = 1 GROUP BY user_id, episode""")
def backpressure_episodes(spark, sf_dir):
    return T.backpressure_episodes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 80, 20)


@query("""WITH s AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS request_id, CAST(l_shipdate AS DATE) AS lo, CASE WHEN l_returnflag <> 'R' THEN CAST(l_shipdate AS DATE) + l_quantity::INT END AS hi FROM lineitem),
b AS (SELECT l_suppkey, request_id, lo AS moment, 1 AS d FROM s UNION ALL SELECT l_suppkey, request_id, hi, -1 FROM s WHERE hi IS NOT NULL),
c AS (SELECT *, sum(d) OVER (PARTITION BY l_suppkey ORDER BY moment, d, request_id ROWS UNBOUNDED PRECEDING) AS concurrency FROM b) SELECT l_suppkey, request_id, moment::VARCHAR AS start, concurrency::BIGINT AS concurrency, concurrency > 4 AS would_reject FROM c WHERE d = 1""")
def in_flight(spark, sf_dir):
    """Shipments stand for requests; returned ones are never answered."""
    start = F.to_date("l_shipdate")
    end = F.when(F.col("l_returnflag") != "R", F.date_add(start, F.col("l_quantity").cast("int")))
    spans = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("request_id"), start.alias("lo"), end.alias("hi"))
    return T.in_flight(spans, ["l_suppkey"], "request_id", "lo", "hi", 4).withColumn("start", F.col("at").cast("string")).drop("at")


@query("""WITH e AS (SELECT *, value > 50 AS timed_out FROM events WHERE event_type = 'error'), r AS (SELECT *, sum(CASE WHEN timed_out THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, event_id, timed_out, n::BIGINT AS n, NOT timed_out AND n <= 3 AS restarted FROM r""")
def restart_budget(spark, sf_dir):
    crashes = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "ts", "event_id", (F.col("value") > 50).alias("timed_out"))
    return T.restart_budget(crashes, ["user_id"], ["ts", "event_id"], on_timeout=False).drop("ts")


@query("""SELECT o_custkey, o_orderkey, date_diff('day', o_orderdate, lead(o_orderdate) OVER w) AS up_days, lag(o_orderstatus) OVER w IS NULL OR lag(o_orderstatus) OVER w = 'F' AS legal_start FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lifetimes(spark, sf_dir):
    states = table(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "F", "stopped").otherwise("ready"))
    found = T.lifetimes(states, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate", "state")
    return found.select("o_custkey", "o_orderkey", F.datediff("until", "o_orderdate").cast("long").alias("up_days"), "legal_start")


@query(f"WITH {ITEMS} SELECT l_suppkey, sum(least(moved, 20))::BIGINT AS written, sum(greatest(moved - 20, 0))::BIGINT AS retried, sum(requested - moved)::BIGINT AS dropped FROM t GROUP BY l_suppkey")
def playout_drops(spark, sf_dir):
    return T.playout_drops(_items(spark, sf_dir), ["l_suppkey"], 20)


@query("""WITH l AS (SELECT *, CASE event_type WHEN 'view' THEN 'ping' WHEN 'signup' THEN 'crash' WHEN 'error' THEN CASE WHEN value > 50 THEN 'timeout' ELSE 'failed' END ELSE 'request' END AS kind FROM events)
SELECT user_id, count(*) FILTER (kind IN ('request', 'failed', 'timeout')) AS requests_total, count(*) FILTER (kind IN ('failed', 'timeout')) AS failed, count(*) FILTER (kind = 'timeout') AS timeouts, least(count(*) FILTER (kind = 'crash'), 3) AS restarts, arg_max(value, (ts, event_id)) FILTER (kind = 'ping') AS last_rtt FROM l GROUP BY user_id""")
def engine_metrics(spark, sf_dir):
    type_ = F.col("event_type")
    kind = F.when(type_ == "view", "ping").when(type_ == "signup", "crash").when((type_ == "error") & (F.col("value") > 50), "timeout").when(type_ == "error", "failed").otherwise("request")
    return T.engine_metrics(table(spark, sf_dir, "events").withColumn("kind", kind), ["user_id"], ["ts", "event_id"])


#: Events as utterances: their type is the outcome, their value gives the times.
UTTERANCES = """u AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'empty' ELSE 'processed' END AS outcome, event_id % 4 AS clauses, event_id % 480 AS frames_out, event_id % 3 AS frames_lost, 1000 + event_id % 2000 AS audio_ms,
floor(value)::BIGINT AS stt_ms, floor(value * 2)::BIGINT AS mt_ms, floor(value * 3)::BIGINT AS tts_ms, CASE WHEN event_id % 5 = 0 THEN 0 ELSE floor(value * 4)::BIGINT END AS first_audio_ms, floor(value * 6)::BIGINT AS total_ms FROM events)"""


def _utterances(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "empty").otherwise("processed")
    times = {"stt_ms": F.floor(v), "mt_ms": F.floor(v * 2), "tts_ms": F.floor(v * 3), "first_audio_ms": F.when(e % 5 == 0, F.lit(0).cast("long")).otherwise(F.floor(v * 4)), "total_ms": F.floor(v * 6)}
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", v.alias("value"), outcome.alias("outcome"), (e % 4).alias("clauses"), (e % 480).alias("frames_out"), (e % 3).alias("frames_lost"), (1000 + e % 2000).alias("audio_ms"))
    return rows.withColumns(times).drop("value")


@query(f"""WITH {UTTERANCES} SELECT user_id, count(*) FILTER (outcome = 'processed') AS processed, count(*) FILTER (outcome = 'empty') AS empty, count(*) FILTER (outcome = 'failed') AS failed, sum(frames_out)::BIGINT AS frames_emitted, sum(frames_lost)::BIGINT AS frames_dropped,
{", ".join(f"arg_max({s}_ms, (ts, event_id)) FILTER (outcome = 'processed') AS last_{s}_ms" for s in T.STAGES)} FROM u GROUP BY user_id""")
def pipeline_metrics(spark, sf_dir):
    return T.pipeline_metrics(_utterances(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query(f"""WITH {UTTERANCES}, t AS (SELECT * FROM u WHERE outcome = 'processed'),
s AS (SELECT user_id, sum(audio_ms) AS input_duration_ms, min(event_id) % 1000 AS startup_ms, sum(total_ms) AS total_turnaround_ms FROM u GROUP BY user_id),
d AS (SELECT user_id, count(*) AS n FROM u GROUP BY user_id),
x AS (SELECT user_id, count(*) AS n, sum(clauses) AS clauses, sum(stt_ms) AS stt, sum(mt_ms) AS mt, sum(tts_ms) AS tts, arg_min(first_audio_ms, event_id) AS first, sum(frames_out) AS frames, string_agg('e' || event_id, ' ' ORDER BY event_id) AS words FROM t GROUP BY user_id)
SELECT s.user_id, 'in/' || s.user_id || '.wav' AS input_file, 'out/' || s.user_id || '.wav' AS output_file, CASE WHEN s.user_id % 2 = 0 THEN 'direct' ELSE 'cascade' END AS route, 'pt-BR' AS source_language, 'en-US' AS target_language,
s.input_duration_ms::BIGINT AS input_duration_ms, s.startup_ms::BIGINT AS startup_ms, s.total_turnaround_ms::BIGINT AS total_turnaround_ms, (coalesce(x.frames, 0) * 1000 // 48000)::BIGINT AS output_duration_ms, d.n AS utterances_detected,
coalesce(x.n, 0) AS utterances_translated, coalesce(x.clauses, 0)::BIGINT AS clauses_synthesized, coalesce(x.stt, 0)::BIGINT AS speech_stage_ms, coalesce(x.mt, 0)::BIGINT AS mt_stage_ms, coalesce(x.tts, 0)::BIGINT AS tts_stage_ms,
coalesce(nullif(x.first, 0), s.total_turnaround_ms)::BIGINT AS first_audio_ms, round(s.total_turnaround_ms / s.input_duration_ms, 3) AS realtime_factor, x.words AS translated_text
FROM s JOIN d USING (user_id) LEFT JOIN x USING (user_id)""")
def session_summary(spark, sf_dir):
    """A user's events as the utterances of a session; stage times of empty and failed ones do not count."""
    u = _utterances(spark, sf_dir)
    name = lambda folder: F.concat(F.lit(folder), F.col("user_id").cast("string"), F.lit(".wav"))
    sessions = u.groupBy("user_id").agg(F.sum("audio_ms").alias("input_duration_ms"), (F.min("event_id") % 1000).alias("startup_ms"), F.sum("total_ms").alias("total_turnaround_ms"))
    route = F.when(F.col("user_id") % 2 == 0, "direct").otherwise("cascade")
    sessions = sessions.withColumns({"input_file": name("in/"), "output_file": name("out/"), "route": route, "source_language": F.lit("pt-BR"), "target_language": F.lit("en-US")})
    renamed = {"clauses": "clauses_synthesized", "stt_ms": "speech_stage_ms", "mt_ms": "mt_stage_ms", "tts_ms": "tts_stage_ms", "frames_out": "output_frames"}
    said = u.withColumnsRenamed(renamed).withColumns({"translated": F.col("outcome") == "processed", "translated_text": F.concat(F.lit("e"), F.col("event_id").cast("string"))})
    return T.session_summary(sessions, said, ["user_id"], "event_id", 48000, include_text=True)


@query("WITH t AS (SELECT user_id, date_trunc('hour', ts) AS tick, sum(value) AS rss, sum(value % 7) AS cpu FROM events GROUP BY ALL) SELECT user_id, round(max(rss), 4) AS peak_rss, round(avg(cpu), 4) AS cpu_avg, round(max(cpu), 4) AS cpu_peak, count(*) AS ticks FROM t GROUP BY user_id")
def process_tree_usage(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("tick"), "value", (F.col("value") % 7).alias("cpu"))
    used = T.process_tree_usage(samples, ["user_id"], "tick", "value", "cpu")
    return used.select("user_id", *[F.round(c, 4).alias(c) for c in ("peak_rss", "cpu_avg", "cpu_peak")], "ticks")


@query("SELECT event_type, count(CASE WHEN value <= 1 THEN 1 END) AS le_1, count(CASE WHEN value <= 5 THEN 1 END) AS le_5, count(CASE WHEN value <= 10 THEN 1 END) AS le_10, count(*) AS le_inf FROM events GROUP BY event_type")
def latency_histogram(spark, sf_dir):
    return T.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [1, 5, 10])


_VERDICTS = ", ".join(f"CASE WHEN {m} < {a} THEN 'pass' WHEN {m} < {b} THEN 'acceptable' ELSE 'fail' END AS {m.removesuffix('_ms')}" for m, (a, b) in T.TARGETS.items())


@query(f"""WITH {UTTERANCES}, m AS (SELECT user_id, sum(frames_lost) / sum(frames_out) AS drop_rate, count(*) FILTER (outcome = 'empty') * 60000 / sum(audio_ms) AS underruns_per_minute, count(*) FILTER (outcome = 'failed') * 60000 / sum(audio_ms) AS overruns_per_minute,
avg(stt_ms) * 10 AS stt_ms, avg(mt_ms) AS mt_ms, avg(tts_ms) * 2 AS tts_ms, avg(total_ms) * 3 AS total_ms, avg(first_audio_ms) * 3 AS first_audio_ms, list_sort(list(first_audio_ms * 8))[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS p95_first_audio_ms FROM u GROUP BY user_id)
SELECT user_id, {_VERDICTS}, CASE WHEN first_audio_ms < 500 THEN 'excellent' WHEN first_audio_ms <= 1500 THEN 'stretch' WHEN first_audio_ms <= 3000 THEN 'MVP' ELSE 'poor' END AS band, p95_first_audio_ms <= 3000 AS passes_gate FROM m""")
def slo_report(spark, sf_dir):
    a_minute = lambda outcome: F.count_if(F.col("outcome") == outcome) * 60000 / F.sum("audio_ms")
    u = _utterances(spark, sf_dir)
    m = u.groupBy("user_id").agg(
        (F.sum("frames_lost") / F.sum("frames_out")).alias("drop_rate"), a_minute("empty").alias("underruns_per_minute"), a_minute("failed").alias("overruns_per_minute"),
        *[(F.avg(f"{s}_ms") * k).alias(f"{s}_ms") for s, k in (("stt", 10), ("mt", 1), ("tts", 2), ("total", 3), ("first_audio", 3))],
    )
    p95 = T.latency_stats(u.withColumn("ms", F.col("first_audio_ms") * 8), "ms", ["user_id"]).select("user_id", F.col("p95").alias("p95_first_audio_ms"))
    return T.slo_report(m.join(p95, "user_id"), ["user_id"])


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, count(CASE WHEN event_type = 'error' THEN 1 END) AS underruns, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) < 1 AS meets FROM events GROUP BY 1")
def slo_per_minute(spark, sf_dir):
    windows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour")).agg(F.count_if(F.col("event_type") == "error").alias("underruns"), F.count(F.lit(1)).alias("n"))
    return windows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "underruns", "n", (F.col("underruns") < 1).alias("meets"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS copies FROM events GROUP BY user_id, event_type")
def dedupe_chunks(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("copies"))


def _hour():
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)


@query("SELECT event_id, sum(CASE WHEN event_type IN ('click', 'view') THEN 5 ELSE -3 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS current FROM events")
def one_buffer_occupancy(spark, sf_dir):
    """One buffer for all events, in blocks of an hour."""
    delta = F.when(F.col("event_type").isin("click", "view"), 5).otherwise(-3)
    return T.occupancy(table(spark, sf_dir, "events"), [], ["ts", "event_id"], delta, 100, 48000, _hour()).select("event_id", "current")


@query("""WITH m AS (SELECT *, CASE WHEN value >= 80 THEN 1 WHEN value <= 20 THEN 0 END AS mark FROM events), o AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS s FROM m),
p AS (SELECT *, CASE WHEN s = 1 AND coalesce(lag(s) OVER (ORDER BY ts, event_id), 0) = 0 THEN 1 ELSE 0 END AS b FROM o), q AS (SELECT *, sum(b) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM p)
SELECT episode::BIGINT AS episode, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM q WHERE s = 1 GROUP BY episode""")
def one_buffer_episodes(spark, sf_dir):
    return T.backpressure_episodes(table(spark, sf_dir, "events"), [], ["ts", "event_id"], "value", 80, 20, _hour())
