"""Queries of registries, routes and message logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voicelake.operators import routing
from voicelake.plans.registry import query, table

#: A small registry: id, state, capabilities, pairs, stt and tts languages, commercial use.
ENGINES = [
    ("asr-1", "ready", ["stt"], [], ["en-US", "de-DE"], [], True),
    ("asr-2", "processing", ["stt"], [], ["fr", "es"], [], None),
    ("asr-3", "error", ["stt", "tts"], [], [], [], True),
    ("mt-1", "ready", ["translation"], [("en", "pt"), ("de-DE", "pt"), ("fr", "pt-PT")], [], [], False),
    ("mt-2", "starting", ["translation", "stt"], [], ["es-MX", "fr-FR"], [], None),
    ("st-1", "error", ["speech_translation"], [("es", "pt")], [], [], True),
    ("st-2", "starting", ["speech_translation"], [("en", "pt"), ("de", "pt-PT")], [], [], True),
    ("s2s-1", "ready", ["speech_to_speech", "tts"], [("es-ES", "en-GB"), ("fr", "en-GB")], [], ["ja"], True),
    ("tts-1", "ready", ["tts"], [], [], ["pt-BR", "de"], True),
]
CAPABILITIES = ["stt", "translation", "speech_translation", "tts", "speech_to_speech"]


def engines(spark):
    schema = "id string, state string, capabilities array<string>, pairs array<struct<source:string,target:string>>, stt_languages array<string>, tts_languages array<string>, commercial_use boolean"
    return spark.createDataFrame(ENGINES, schema)


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


E_SQL = "engines(id, state, capabilities, pairs, stt, tts, commercial_use) AS (VALUES " + ", ".join(
    f"('{i}', '{s}', {_sql_list(c)}, {_sql_list([a + '>' + b for a, b in p])}, {_sql_list(l)}, {_sql_list(t)}, {'NULL::BOOLEAN' if u is None else str(u).lower()})" for i, s, c, p, l, t, u in ENGINES
) + ")"
#: Languages come with and without a region, and some targets are not given.
L_SQL = "legs AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE lang || '-' || upper(lang) END AS src, CASE doc_id % 5 WHEN 0 THEN 'pt-PT' WHEN 1 THEN 'en-GB' WHEN 2 THEN NULL ELSE 'pt' END AS dst FROM documents)"
R_SQL = f"{L_SQL}, requests AS (SELECT doc_id AS request_id, ({_sql_list(CAPABILITIES)})[doc_id % 5 + 1] AS capability, src, dst FROM legs)"
#: What an engine must hold, written from the rule and not from the operator: checks that do not apply pass.
FITS = """list_contains(e.capabilities, r.capability)
 AND NOT (r.capability IN ('translation', 'speech_translation', 'speech_to_speech') AND r.src IS NOT NULL AND r.dst IS NOT NULL AND len(e.pairs) > 0 AND NOT list_contains(e.pairs, r.src || '>' || r.dst))
 AND NOT (r.capability = 'stt' AND r.src IS NOT NULL AND len(e.stt) > 0 AND len([x FOR x IN e.stt IF x = r.src OR starts_with(x, string_split(r.src, '-')[1] || '-')]) = 0)
 AND NOT (r.capability = 'tts' AND r.dst IS NOT NULL AND len(e.tts) > 0 AND len([x FOR x IN e.tts IF x = r.dst OR starts_with(x, string_split(r.dst, '-')[1] || '-')]) = 0)"""
M_SQL = f"""matches AS (SELECT r.*, e.id, e.state FROM requests r JOIN engines e ON {FITS}),
chosen AS (SELECT request_id, id AS engine_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY (state = 'ready')::INT DESC, id) AS k FROM matches WHERE state <> 'error') WHERE k = 1)"""


def legs(spark, sf_dir):
    d = F.col("doc_id")
    source = F.when(d % 2 == 0, F.col("lang")).otherwise(F.concat("lang", F.lit("-"), F.upper("lang")))
    target = F.when(d % 5 == 0, "pt-PT").when(d % 5 == 1, "en-GB").when(d % 5 > 2, "pt")
    return table(spark, sf_dir, "documents").select("doc_id", source.alias("source_lang"), target.alias("target_lang"))


def requests(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, CAPABILITIES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return legs(spark, sf_dir).select(F.col("doc_id").alias("request_id"), F.array(kind).alias("asked"), "source_lang", "target_lang")


ASKED = f"asked AS (SELECT doc_id AS request_id, CASE doc_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['stt', 'tts'] WHEN 2 THEN ['stt', 'translation'] ELSE ['tts'] END AS asked FROM documents)"


def _asked(spark, sf_dir):
    d, pair = F.col("doc_id"), lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    asked = F.when(d % 4 == 0, pair()).when(d % 4 == 1, pair("stt", "tts")).when(d % 4 == 2, pair("stt", "translation")).otherwise(pair("tts"))
    return table(spark, sf_dir, "documents").select(d.alias("request_id"), asked.alias("asked"))


@query(f"WITH {E_SQL}, {ASKED} SELECT request_id, id AS engine_id FROM asked, engines WHERE list_has_all(capabilities, asked)")
def find_by_capability(spark, sf_dir):
    return routing.find_by_capability(_asked(spark, sf_dir), engines(spark)).select("request_id", F.col("id").alias("engine_id"))


@query(f"WITH {E_SQL}, {ASKED} SELECT request_id, id AS engine_id FROM asked, engines WHERE list_has_any(capabilities, asked)")
def find_by_any_capability(spark, sf_dir):
    return routing.find_by_capability(_asked(spark, sf_dir), engines(spark), "any").select("request_id", F.col("id").alias("engine_id"))


@query(f"WITH {E_SQL}, {R_SQL}, {M_SQL} SELECT request_id, id AS engine_id FROM matches")
def language_match(spark, sf_dir):
    return routing.language_match(requests(spark, sf_dir), engines(spark)).select("request_id", F.col("id").alias("engine_id"))


@query(f"WITH {E_SQL}, {R_SQL}, {M_SQL} SELECT r.request_id, c.engine_id, CASE WHEN c.engine_id IS NULL THEN 'no engine' END AS reason FROM requests r LEFT JOIN chosen c USING (request_id)")
def negotiate_engine(spark, sf_dir):
    return routing.negotiate_engine(requests(spark, sf_dir), engines(spark))


#: The stages of each leg, their engines, and the routes in order.
P_SQL = f"""{E_SQL}, {L_SQL}, requests AS (SELECT doc_id * 5 + k AS request_id, doc_id, ({_sql_list(CAPABILITIES)})[k + 1] AS capability, CASE WHEN k <> 3 THEN src END AS src, CASE WHEN k <> 0 THEN dst END AS dst FROM legs, range(5) t(k)), {M_SQL},
p AS (SELECT r.doc_id, max(engine_id) FILTER (capability = 'stt') AS stt, max(engine_id) FILTER (capability = 'translation') AS mt, max(engine_id) FILTER (capability = 'tts') AS tts,
 max(engine_id) FILTER (capability = 'speech_translation') AS st, max(engine_id) FILTER (capability = 'speech_to_speech') AS s2s FROM requests r LEFT JOIN chosen USING (request_id) GROUP BY r.doc_id),
auto AS (SELECT *, CASE WHEN st IS NOT NULL AND tts IS NOT NULL THEN 'direct' WHEN stt IS NOT NULL AND mt IS NOT NULL AND tts IS NOT NULL THEN 'cascade' WHEN s2s IS NOT NULL THEN 's2s' ELSE 'none' END AS route FROM p),
picked AS (SELECT doc_id, route, CASE WHEN route = 'cascade' THEN stt END AS stt, CASE WHEN route = 'cascade' THEN mt END AS mt, CASE WHEN route IN ('direct', 'cascade') THEN tts END AS tts,
 CASE WHEN route = 'direct' THEN st END AS st, CASE WHEN route = 's2s' THEN s2s END AS s2s FROM auto)"""


@query(f"WITH {P_SQL} SELECT * FROM picked")
def choose_route(spark, sf_dir):
    return routing.choose_route(legs(spark, sf_dir), ["doc_id"], engines(spark))


@query(f"""WITH {P_SQL}, fits AS (SELECT doc_id, dst IS NULL OR src || '>' || dst IN ('es-ES>en-GB', 'fr>en-GB') AS by_s2s, dst IS NULL OR src || '>' || dst IN ('en>pt', 'de>pt-PT') AS by_st FROM legs)
SELECT doc_id, CASE WHEN by_s2s THEN 's2s' WHEN by_st THEN 'direct' ELSE route END AS route, CASE WHEN NOT by_s2s AND NOT by_st THEN stt END AS stt, CASE WHEN NOT by_s2s AND NOT by_st THEN mt END AS mt,
 CASE WHEN by_s2s THEN NULL WHEN by_st THEN 'own-voice' ELSE tts END AS tts, CASE WHEN by_s2s THEN NULL WHEN by_st THEN 'st-2' ELSE st END AS st, CASE WHEN by_s2s THEN 's2s-1' WHEN by_st THEN NULL ELSE s2s END AS s2s FROM picked JOIN fits USING (doc_id)""")
def choose_named_route(spark, sf_dir):
    return routing.choose_route(legs(spark, sf_dir), ["doc_id"], engines(spark), {"speech_to_speech": "s2s-1", "speech_translation": "st-2", "tts": "own-voice"})


@query(f"WITH {E_SQL} SELECT d.doc_id, e.id AS engine_id, CASE WHEN commercial_use IS NULL THEN 'unknown' WHEN commercial_use THEN 'ok' ELSE 'non-commercial' END AS license_label, coalesce(commercial_use, false) AS allowed FROM documents d JOIN engines e ON e.id = CASE d.doc_id % 2 WHEN 0 THEN 'asr-2' ELSE 'mt-1' END")
def license_filter(spark, sf_dir):
    used = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "asr-2").otherwise("mt-1").alias("id"))
    return routing.license_labels(used.join(F.broadcast(engines(spark)), "id")).select("doc_id", F.col("id").alias("engine_id"), "license_label", "allowed")


@query("SELECT s_suppkey::VARCHAR AS id, ['ready', 'processing', 'stopped', 'error'][s_nationkey % 4 + 1] AS state, CASE WHEN s_acctbal > 0 THEN 'stt,tts' ELSE 'translation' END AS capabilities, s_nationkey % 4 = 0 AS available, s_nationkey % 4 < 2 AS running FROM supplier")
def list_engines(spark, sf_dir):
    """Suppliers stand for a registry."""
    state = F.element_at(F.array(*map(F.lit, ("ready", "processing", "stopped", "error"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    offers = F.when(F.col("s_acctbal") > 0, F.array(F.lit("tts"), F.lit("stt"))).otherwise(F.array(F.lit("translation")))
    return routing.list_engines(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), state.alias("state"), offers.alias("capabilities")))


@query(f"""WITH {R_SQL}, d AS (SELECT request_id, CASE WHEN capability = 'stt' AND request_id % 2 = 1 THEN 'streaming_stt' ELSE capability END AS required FROM requests)
SELECT request_id, required, required <> 'streaming_stt' AS supported FROM d""")
def required_capability(spark, sf_dir):
    asked = requests(spark, sf_dir).select("request_id", F.get("asked", F.lit(0)).alias("capability"), (F.col("request_id") % 2 == 0).alias("is_final"))
    return routing.required_capability(asked, engines(spark))


@query("""WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS k FROM lineitem) WHERE k = 1)
SELECT o_orderkey AS request_id, l_linenumber AS answer, CASE WHEN l_orderkey IS NULL THEN 'unanswered' ELSE 'ok' END AS status, date_diff('day', o_orderdate, l_shipdate) AS wait_days FROM orders LEFT JOIN first ON o_orderkey = l_orderkey""")
def correlate(spark, sf_dir):
    return routing.correlate(*_log(spark, sf_dir)).select("request_id", "answer", "status", F.datediff("answered", "sent").cast("long").alias("wait_days"))


def _log(spark, sf_dir):
    sent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("sent"))
    got = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_shipdate").alias("answered"), F.col("l_linenumber").alias("answer"))
    return sent, got


@query("""WITH sent AS (SELECT c_custkey AS request_id FROM customer WHERE c_custkey % 5 > 0), got AS (SELECT o_custkey AS request_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT request_id, 'orphan' AS kind FROM got WHERE request_id NOT IN (SELECT request_id FROM sent) UNION ALL SELECT request_id, 'unanswered' FROM sent WHERE request_id NOT IN (SELECT request_id FROM got)""")
def orphans_and_unanswered(spark, sf_dir):
    sent = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id")).filter("request_id % 5 > 0")
    got = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("request_id"))
    return routing.orphans_and_unanswered(sent, got, "request_id")


@query("""SELECT o_orderkey AS request_id, min(l_shipdate) IS NULL AS timed_out, count(l_shipdate) AS in_time FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey""")
def timeouts(spark, sf_dir):
    return routing.timeouts(*_log(spark, sf_dir), "INTERVAL 30 DAYS")


@query("""WITH c AS (SELECT *, max(CASE WHEN event_type = 'click' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS seen FROM events)
SELECT event_id, seen IS NOT NULL AS counts FROM c WHERE event_type = 'purchase'""")
def demand_gate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    of = lambda kind: events.filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    return routing.demand_gate(of("purchase"), of("click"), ["user_id"], "ts", 6 * 3600 * 1000).select("event_id", "counts")


@query("SELECT d.doc_id, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'no reference for ' || d.doc_id END AS error FROM documents d LEFT JOIN labels l USING (doc_id)")
def attach_references(spark, sf_dir):
    return routing.attach_references(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", strict=False)


@query("SELECT a.conv_id, a.turn, a.text AS expected, b.text AS heard FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role = 'assistant'")
def pair_expected_heard(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return routing.pair_expected_heard(turns.filter("role = 'user'"), turns.filter("role = 'assistant'").withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"])


@query("""SELECT event_id, event_id % 64 AS flags, (event_id & 1) = 1 AS has_pcm, (event_id & 2) = 2 AS speech_start, (event_id & 4) = 4 AS speech_end, (event_id & 8) = 8 AS end_of_utterance, (event_id & 16) = 16 AS end_of_stream, (event_id & 32) = 32 AS discontinuity FROM events""")
def decode_flags(spark, sf_dir):
    return routing.decode_flags(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 64).alias("flags")), "flags")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'transient' ELSE 'warning' END AS severity, true AS recoverable, event_type = 'error' AS restart FROM events""")
def classify_errors(spark, sf_dir):
    code = F.when(F.col("event_type") == "error", "crashed").when(F.col("event_type") == "view", "underrun").otherwise(F.col("event_type"))
    return routing.classify_errors(table(spark, sf_dir, "events").withColumn("code", code), "code").select("event_id", "severity", "recoverable", "restart")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS available, o_orderstatus IN ('F', 'P') AS running FROM orders")
def state_predicates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("available"), F.col("o_orderstatus").isin("F", "P").alias("running"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CASE WHEN CAST(props->>'$.k' AS BIGINT) >= 50 THEN 'failed' ELSE 'success' END AS status, CASE WHEN CAST(props->>'$.k' AS BIGINT) >= 50 THEN 'E' || (props->>'$.k') END AS code FROM events")
def parse_messages(spark, sf_dir):
    parsed = routing.parse_messages(table(spark, sf_dir, "events"), "props", "k bigint")
    failed = F.col("message.k") >= 50
    return parsed.select("event_id", F.col("message.k").alias("k"), F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, F.concat(F.lit("E"), F.col("message.k"))).alias("code"))


@query(r"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, count(CASE WHEN regexp_matches(line, '(?i)(panic|SIGSEGV|SIGABRT|fatal|moron)') THEN 1 END) AS crashes, count(CASE WHEN regexp_matches(line, '(overflow|dropped|trash)') THEN 1 END) AS overflows, count(CASE WHEN regexp_matches(line, 'underrun|scum') THEN 1 END) AS underruns FROM l GROUP BY source""")
def scan_log_faults(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return routing.scan_log_faults(lines, "line", ["source"], {"crashes": "(?i)(panic|SIGSEGV|SIGABRT|fatal|moron)", "overflows": "(overflow|dropped|trash)", "underruns": "underrun|scum"})


HEADERS = """h AS (SELECT event_id, CASE event_type WHEN 'click' THEN '{"type":"process_stt","request_id":' || event_id || ',"is_final":true}' WHEN 'view' THEN '{"type":"hello","request_id":1}' WHEN 'error' THEN '{"type":"error","code":"crashed"}'
 WHEN 'signup' THEN props ELSE '{"type"' END AS header FROM events)"""


def _headers(spark, sf_dir):
    kind = lambda k: F.col("event_type") == k
    header = F.when(kind("click"), F.concat(F.lit('{"type":"process_stt","request_id":'), "event_id", F.lit(',"is_final":true}'))).when(kind("view"), F.lit('{"type":"hello","request_id":1}'))
    header = header.when(kind("error"), F.lit('{"type":"error","code":"crashed"}')).when(kind("signup"), F.col("props")).otherwise(F.lit('{"type"'))
    return routing.tagged_messages(table(spark, sf_dir, "events").select("event_id", header.alias("header")), "header", "request_id bigint, is_final boolean, code string")


@query(f"WITH {HEADERS} SELECT event_id, header->>'$.type' AS type, CAST(header->>'$.request_id' AS BIGINT) AS request_id, CAST(header->>'$.is_final' AS BOOLEAN) AS is_final, header->>'$.code' AS code FROM h WHERE json_valid(header) AND header->>'$.type' IN ('process_stt', 'error')")
def tagged_messages(spark, sf_dir):
    return _headers(spark, sf_dir)[0].select("event_id", "message.type", "message.request_id", "message.is_final", "message.code")


@query(f"WITH {HEADERS} SELECT event_id, header, CASE WHEN NOT json_valid(header) THEN 'unparsed' WHEN header->>'$.type' IS NULL THEN 'untyped' ELSE 'unknown type' END AS reason FROM h WHERE CASE WHEN json_valid(header) THEN coalesce(header->>'$.type', '') NOT IN ('process_stt', 'error') ELSE true END")
def dead_letters(spark, sf_dir):
    return _headers(spark, sf_dir)[1]
