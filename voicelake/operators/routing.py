"""Engine registries, routes and message logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The wire's flag bits.
FLAGS = ("has_pcm", "speech_start", "speech_end", "end_of_utterance", "end_of_stream", "discontinuity")
#: Error codes by severity; all others are warnings.
TRANSIENT, CRITICAL, RESTARTED = ("overflow", "underrun", "timeout"), ("start_failed", "crashed", "access_denied", "internal"), ("crashed", "timeout")


_ANY = "*"


def _with_engines(requests: DataFrame, engines: DataFrame, first) -> DataFrame:
    """Requests with the engines that hold one capability, an equi join for registries of any size; no capability is held by all."""
    offers = engines.select("*", F.explode(F.array_union(F.array_distinct("capabilities"), F.array(F.lit(_ANY)))).alias("_offer"))
    return requests.withColumn("_first", F.coalesce(first, F.lit(_ANY))).join(offers, F.col("_first") == F.col("_offer")).drop("_offer")


def find_by_capability(requests: DataFrame, engines: DataFrame, mode: str = "all") -> DataFrame:
    """Requests (``asked`` capabilities) with the engines that have all, or any, of them. All of none holds, any of none does not."""
    if mode == "all":
        return _with_engines(requests, engines, F.get("asked", F.lit(0))).filter(F.size(F.array_except("asked", "capabilities")) == 0).drop("_first")
    each = _with_engines(requests.withColumn("_each", F.explode(F.array_distinct("asked"))), engines, F.col("_each"))
    return each.filter(F.get(F.array_intersect("asked", "capabilities"), F.lit(0)) == F.col("_each")).drop("_each", "_first")


def _speaks(tags: str, asked: str):
    """An empty list, the tag itself, or a registered tag of the asked one's primary language; no asked tag holds."""
    region = F.concat(F.split_part(F.col(asked), F.lit("-"), F.lit(1)), F.lit("-"))
    return F.col(asked).isNull() | (F.size(tags) == 0) | F.exists(tags, lambda x: (x == F.col(asked)) | x.startswith(region))


def _pairs_fit():
    exact = F.exists("pairs", lambda p: (p["source"] == F.col("source_lang")) & (p["target"] == F.col("target_lang")))
    return F.col("source_lang").isNull() | F.col("target_lang").isNull() | (F.size("pairs") == 0) | exact


def language_match(requests: DataFrame, engines: DataFrame) -> DataFrame:
    """Requests (``asked`` capabilities, source_lang, target_lang) with the engines that have them and fit their languages.

    Translating capabilities need the exact pair, recognition the source's language, synthesis the target's. Every check that applies must hold.
    """
    asks = lambda *names: F.arrays_overlap("asked", F.array(*map(F.lit, names)))
    translates = ~asks("translation", "speech_translation", "speech_to_speech") | _pairs_fit()
    hears, speaks = ~asks("stt", "streaming_stt") | _speaks("stt_languages", "source_lang"), ~asks("tts", "streaming_tts") | _speaks("tts_languages", "target_lang")
    return find_by_capability(requests, engines).filter(translates & hears & speaks)


def _best(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The first ready match by id, else the first that is not in error."""
    ranked = matches.filter("state <> 'error'").groupBy(*keys)
    return ranked.agg(F.min(F.struct((F.col("state") != "ready").alias("later"), "id"))["id"].alias("engine_id"))


def negotiate_engine(requests: DataFrame, engines: DataFrame) -> DataFrame:
    """One engine a request; requests without one stay, with a reason."""
    best = _best(language_match(requests, engines), ["request_id"])
    return requests.select("request_id").join(best, "request_id", "left").withColumn("reason", F.when(F.col("engine_id").isNull(), "no engine"))


#: Stages of the routes, in the order of preference where engines are named, and where they are negotiated.
ROUTES = {"s2s": ("speech_to_speech",), "direct": ("speech_translation", "tts"), "cascade": ("stt", "translation", "tts")}
NEGOTIATED = ("direct", "cascade", "s2s")
_STAGES = ("stt", "translation", "tts", "speech_translation", "speech_to_speech")


def choose_route(legs: DataFrame, keys: list[str], engines: DataFrame, prefs: dict[str, str] | None = None) -> DataFrame:
    """Legs (keys, source_lang, target_lang) -> route and the engine of each of its stages; ``none`` where no route is found.

    ``prefs`` names engines by stage. A named route holds if all its stages are named and its translating engine fits the
    pair, an engine that the registry does not know fitting all. Else stages are negotiated.
    """
    source, target, no = F.col("source_lang"), F.col("target_lang"), F.lit(None).cast("string")
    languages = {"stt": (source, no), "tts": (no, target)}
    ask = [F.struct(F.lit(s).alias("stage"), *(x.alias(n) for x, n in zip(languages.get(s, (source, target)), ("source_lang", "target_lang"), strict=True))) for s in _STAGES]
    asked = legs.select(*keys, F.explode(F.array(*ask)).alias("_ask")).select(*keys, "_ask.*").withColumn("asked", F.array("stage"))
    found = _best(language_match(asked, engines), [*keys, "stage"]).groupBy(*keys).pivot("stage", list(_STAGES)).agg(F.first("engine_id"))
    joined, named = legs.join(found, keys, "left"), {}
    for route, stages in ROUTES.items():
        if prefs and all(prefs.get(s) for s in stages):
            translating = next(s for s in ("speech_to_speech", "speech_translation", "translation") if s in stages)
            known = engines.filter(F.col("id") == prefs[translating]).limit(1).select("pairs", F.lit(True).alias("_known"))
            joined = joined.join(F.broadcast(known), F.lit(True), "left").withColumn(f"_{route}", F.col("_known").isNull() | _pairs_fit()).drop("pairs", "_known")
            named[route] = F.col(f"_{route}")
    route, engine = F.lit("none"), {s: no for s in _STAGES}
    for name in reversed(NEGOTIATED):
        holds = F.lit(True)
        for s in ROUTES[name]:
            holds = holds & F.col(s).isNotNull()
        route = F.when(holds, name).otherwise(route)
        engine = {s: F.when(holds, F.col(s) if s in ROUTES[name] else no).otherwise(e) for s, e in engine.items()}
    for name in reversed(named):
        route = F.when(named[name], name).otherwise(route)
        engine = {s: F.when(named[name], F.lit(prefs[s]) if s in ROUTES[name] else no).otherwise(e) for s, e in engine.items()}
    short = {"translation": "mt", "speech_translation": "st", "speech_to_speech": "s2s"}
    return joined.select(*keys, route.alias("route"), *[e.alias(short.get(s, s)) for s, e in engine.items()])


def list_engines(engines: DataFrame) -> DataFrame:
    """id, state, capabilities in order, available (ready) and running (ready or processing)."""
    return engines.select("id", "state", F.array_join(F.array_sort("capabilities"), ",").alias("capabilities"), (F.col("state") == "ready").alias("available"), F.col("state").isin("ready", "processing").alias("running"))


def license_labels(engines: DataFrame) -> DataFrame:
    label = F.when(F.col("commercial_use").isNull(), "unknown").when(F.col("commercial_use"), "ok").otherwise("non-commercial")
    return engines.withColumn("license_label", label).withColumn("allowed", F.coalesce("commercial_use", F.lit(False)))


def required_capability(requests: DataFrame, engines: DataFrame) -> DataFrame:
    needed = F.when((F.col("capability") == "stt") & ~F.col("is_final"), "streaming_stt").otherwise(F.col("capability"))
    offered = engines.select(F.explode("capabilities").alias("required")).distinct().withColumn("supported", F.lit(True))
    return requests.select("request_id", needed.alias("required")).join(offered, "required", "left").select("request_id", "required", F.coalesce("supported", F.lit(False)).alias("supported"))


def correlate(sent: DataFrame, got: DataFrame) -> DataFrame:
    """Every request with its first answer."""
    first = got.groupBy("request_id").agg(F.min(F.struct("answered", "answer")).alias("a"))
    joined = sent.join(first, "request_id", "left")
    return joined.select("request_id", "sent", F.col("a.answered").alias("answered"), F.col("a.answer").alias("answer"), F.when(F.col("a").isNull(), "unanswered").otherwise("ok").alias("status"))


def orphans_and_unanswered(sent: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """key and kind: answers without a request (orphan, one row an answer) and requests without an answer (unanswered)."""
    orphans = got.join(sent.select(key).distinct(), key, "left_anti").select(key, F.lit("orphan").alias("kind"))
    return orphans.unionByName(sent.join(got, key, "left_anti").select(key, F.lit("unanswered").alias("kind")))


def attach_references(samples: DataFrame, references: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Samples with their reference's columns. A missing one is an error: of the job, or if not ``strict`` of the row (``error``)."""
    joined = samples.join(references.withColumn("_known", F.lit(True)), key, "left")
    missing = F.concat(F.lit("no reference for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    error = F.when(F.col("_known").isNull(), F.raise_error(missing).cast("string") if strict else missing)
    return joined.filter(error.isNull()).drop("_known") if strict else joined.withColumn("error", error).drop("_known")


def pair_expected_heard(expected: DataFrame, heard: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, heard) of the cases that both sides have."""
    return expected.select(*keys, F.col("text").alias("expected")).join(heard.select(*keys, F.col("text").alias("heard")), keys)


def timeouts(sent: DataFrame, got: DataFrame, deadline: str) -> DataFrame:
    inside = (F.col("s.request_id") == F.col("g.request_id")) & F.expr(f"g.answered BETWEEN s.sent AND s.sent + {deadline}")
    return sent.alias("s").join(got.alias("g"), inside, "left").groupBy("s.request_id").agg(F.count("g.answered").alias("in_time")).select("request_id", (F.col("in_time") == 0).alias("timed_out"), "in_time")


def latest_before(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, within_us: int, out: str) -> DataFrame:
    """``rows`` with the time of the last mark of their key at or before them, at most ``within_us`` microseconds back, or null.

    An as-of join by spans of that length: the mark lies in the row's span or the one before. Inside a span a window over
    both tables finds it; of the span before only the last mark counts, one row a span. So a key of any size spreads over
    its spans.
    """
    span = lambda c: F.floor(F.unix_micros(c) / within_us)
    stamp = F.col(at).cast("timestamp")
    left = rows.withColumns({"_at": stamp, "_span": span(stamp), "_mark": F.lit(None).cast("timestamp")})
    right = marks.select(*keys, stamp.alias("_at"), span(stamp).alias("_span"), stamp.alias("_mark"))
    same = Window.partitionBy(*keys, "_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = left.withColumn("_row", F.lit(True)).unionByName(right.withColumn("_row", F.lit(False)), allowMissingColumns=True).withColumn("_near", F.max("_mark").over(same)).filter("_row")
    last = right.groupBy(*keys, (F.col("_span") + 1).alias("_span")).agg(F.max("_mark").alias("_far"))
    found = seen.join(last, [*keys, "_span"], "left").withColumn(out, F.coalesce("_near", "_far"))
    inside = F.unix_micros("_at") - F.unix_micros(out) <= within_us
    return found.withColumn(out, F.when(inside, F.col(out))).select(*rows.columns, out)


def demand_gate(transfers: DataFrame, callbacks: DataFrame, keys: list[str], at: str, within_ms: int = 250) -> DataFrame:
    """``transfers`` with ``counts``: whether their consumer called back at most so long before."""
    return latest_before(transfers, callbacks, keys, at, within_ms * 1000, "_seen").withColumn("counts", F.col("_seen").isNotNull()).drop("_seen")


def decode_flags(df: DataFrame, column: str) -> DataFrame:
    return df.select("*", *[(F.col(column).bitwiseAND(F.lit(1 << k)) == (1 << k)).alias(name) for k, name in enumerate(FLAGS)])


def classify_errors(df: DataFrame, code: str) -> DataFrame:
    severity = F.when(F.col(code).isin(*TRANSIENT), "transient").when(F.col(code).isin(*CRITICAL), "critical").otherwise("warning")
    return df.withColumn("severity", severity).withColumn("recoverable", F.lit(True)).withColumn("restart", F.col(code).isin(*RESTARTED))


#: The tags of the wire's requests and responses that carry work.
MESSAGE_TYPES = ("process_stt", "process_translation", "process_speech_translation", "process_tts", "process_s2s", "stt_result", "translation_result", "speech_translation_result", "tts_result", "s2s_result", "error")


def tagged_messages(df: DataFrame, column: str, fields: str, types: tuple[str, ...] = MESSAGE_TYPES) -> tuple[DataFrame, DataFrame]:
    """JSON headers with the discriminator ``type`` -> (rows with the typed struct ``message``, dead letters with ``reason``).

    Dead are texts that do not parse (unparsed), have no type (untyped) or one that is not known (unknown type).
    """
    parsed = parse_messages(df, column, f"type string, {fields}")
    tag = F.col("message.type")
    reason = F.when(F.col("message").isNull() | F.col("message._corrupt_record").isNotNull(), "unparsed").when(tag.isNull(), "untyped").when(~tag.isin(*types), "unknown type")
    marked = parsed.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").drop("message")


def parse_messages(df: DataFrame, column: str, fields: str) -> DataFrame:
    """JSON headers -> struct ``message``; what does not parse keeps its text in message._corrupt_record."""
    return df.withColumn("message", F.from_json(column, f"{fields}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))


def scan_log_faults(lines: DataFrame, line: str, by: list[str], classes: dict[str, str]) -> DataFrame:
    return lines.groupBy(*by).agg(*[F.count_if(F.col(line).rlike(p)).alias(name) for name, p in classes.items()])
