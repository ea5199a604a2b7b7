"""Latency, buffer and engine statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.operators.scan import running
from voicelake.workspace import fresh


#: Accuracy of the quantile sketch that brackets a rank, and values of a group up to which no bracket is needed.
ACCURACY, WHOLE = 10_000, 100_000


def ranked_value(df: DataFrame, by: list[str], value: str, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """by, n and the exact value at each 0-based rank, given as its share of the group and as an expression of ``n``.

    A first pass keeps a mergeable quantile sketch a group, whose error bounds between which values a rank lies. The
    second sorts the values inside those bounds alone, a few thousandths of a large group, and counts those below.
    """
    values, margin = df.filter(F.col(value).isNotNull()), 3 / ACCURACY
    marks = [F.lit(min(1.0, max(0.0, q + side * margin))) for q, _ in ranks.values() for side in (-1, 1)]
    sketched = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, F.array(*marks), ACCURACY).alias("_marks"))
    large = F.col("n") > WHOLE
    asked = [
        F.struct(F.lit(name).alias("name"), F.when(large & F.lit(q > margin), F.col("_marks")[2 * k]).alias("low"), F.when(large & F.lit(q < 1 - margin), F.col("_marks")[2 * k + 1]).alias("high"), rank.cast("long").alias("rank"))
        for k, (name, (q, rank)) in enumerate(ranks.items())
    ]
    bounds = sketched.select(*[F.col(c).alias(f"_by_{c}") for c in by], "n", F.array(*asked).alias("_asked"))
    place = fresh(df.sparkSession, "ranks")
    bounds.write.parquet(place)  # written, so that its true size decides how it is joined
    bounds = df.sparkSession.read.schema(bounds.schema).parquet(place)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rows = values.select(*by, value).join(bounds, same).select(*by, "n", F.col(value).alias("_v"), F.inline("_asked"))
    rows = rows.filter(F.col("high").isNull() | (F.col("_v") <= F.col("high")))
    inside = F.when(F.col("low").isNull() | (F.col("_v") >= F.col("low")), F.col("_v"))  # null: below
    counts = rows.groupBy(*by, "n", "name", "rank", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).filter(F.col("_v").isNotNull() & (F.col("_upto") > F.col("rank")))
    return found.groupBy(*by, "n").agg(*[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])


def medians(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """by and the exact median, the mean of both middle values where their number is even."""
    middle = {"_low": (0.5, F.floor((F.col("n") - 1) / 2)), "_high": (0.5, F.floor(F.col("n") / 2))}
    return ranked_value(df, by, value, middle).select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(out))


def latency_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, min, max, floored mean, p95 and p99 at rank floor(n q), at most n - 1; groups without a value are left out."""
    at = lambda q: (q, F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1))
    whole = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.floor(F.avg(value)).alias("avg"))
    ranks = ranked_value(df, by, value, {"p95": at(0.95), "p99": at(0.99)}).withColumnRenamed("n", "count")
    return join_groups(whole, ranks, by)


def join_groups(one: DataFrame, two: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Two tables of one row a group, null keys being a group."""
    two = two.select(*[F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in two.columns])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return one.join(two, same, how).drop(*[f"_by_{c}" for c in by])


def nearest_rank(df: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """The value at rank (n - 1) q, half to even."""
    return ranked_value(df, by, value, {"value": (q, F.bround((F.col("n") - 1) * F.lit(q)))}).drop("n")


def last_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    latest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_k", F.row_number().over(latest)).filter(F.col("_k") <= n).drop("_k")


def audio_counters(transfers: DataFrame, by: list[str], channels: int = 1) -> DataFrame:
    """requested, moved samples -> received, emitted, frames dropped (by transfer, whole frames), underruns (nothing moved), overruns (drop events)."""
    lost = F.floor((F.col("requested") - F.col("moved")) / channels)
    return transfers.groupBy(*by).agg(
        F.sum("requested").alias("received"), F.sum("moved").alias("emitted"), F.sum(lost).alias("dropped"), F.count_if(F.col("moved") == 0).alias("underruns"), F.count_if(lost > 0).alias("overruns")
    )


def playout_drops(transfers: DataFrame, by: list[str], room: int) -> DataFrame:
    """requested, moved -> written at once (up to ``room``), retried, dropped."""
    return transfers.groupBy(*by).agg(
        F.sum(F.least("moved", F.lit(room))).alias("written"), F.sum(F.greatest(F.col("moved") - room, F.lit(0))).alias("retried"), F.sum(F.col("requested") - F.col("moved")).alias("dropped")
    )


def rtf(records: DataFrame, by: list[str], seconds: Column, duration: Column) -> DataFrame:
    """Session real-time factor: seconds over duration, 3 digits, 0 without input."""
    return records.groupBy(*by).agg(F.round(F.coalesce(F.try_divide(F.sum(seconds), F.nullif(F.sum(duration), F.lit(0))), F.lit(0.0)), 3).alias("session_rtf"))


def engine_metrics(log: DataFrame, by: list[str], order: list[str], most: int = 3) -> DataFrame:
    """kind (request, failed, timeout, crash, ping) and value -> requests, failed, timeouts, restarts up to ``most`` and the last ping's value.

    failed and timeout count as requests as well.
    """
    kind = lambda *names: F.count_if(F.col("kind").isin(*names))
    last = F.max(F.when(F.col("kind") == "ping", F.struct(*order, "value")))["value"]
    return log.groupBy(*by).agg(
        kind("request", "failed", "timeout").alias("requests_total"), kind("failed", "timeout").alias("failed"), kind("timeout").alias("timeouts"), F.least(kind("crash"), F.lit(most)).alias("restarts"), last.alias("last_rtt")
    )


#: Stages whose last latency the pipeline reports.
STAGES = ("stt", "mt", "tts", "first_audio", "total")


def pipeline_metrics(utterances: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """outcome (processed, empty, failed), frames_out, frames_lost and the STAGES' ms -> three counts, two sums and the last latencies of processed utterances."""
    last = F.max(F.when(F.col("outcome") == "processed", F.struct(*order, *[f"{s}_ms" for s in STAGES])))
    return utterances.groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("processed", "empty", "failed")], F.sum("frames_out").alias("frames_emitted"), F.sum("frames_lost").alias("frames_dropped"),
        *[last[f"{s}_ms"].alias(f"last_{s}_ms") for s in STAGES],
    )


#: What a session says of itself, and the stages whose time a summary adds up.
SESSION = ("input_file", "output_file", "route", "source_language", "target_language", "input_duration_ms", "startup_ms", "total_turnaround_ms")
SUMMED = ("speech_stage_ms", "mt_stage_ms", "tts_stage_ms")


def session_summary(sessions: DataFrame, utterances: DataFrame, by: list[str], order: str, rate: int, include_text: bool = False) -> DataFrame:
    """Sessions (by, the SESSION columns) and their utterances -> the summary of each, those without utterances too.

    An utterance has ``translated`` (false where it was empty or failed), clauses_synthesized, the SUMMED columns,
    first_audio_ms, output_frames at ``rate``, and for ``include_text`` translated_text. Only translated ones count.
    First audio is that of the first of them, or the turnaround where that is 0 or none.
    """
    done = utterances.filter("translated")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "translated_text"))), lambda x: x["translated_text"]), " ")
    sums = done.groupBy(*by).agg(
        F.count(F.lit(1)).alias("utterances_translated"), F.sum("clauses_synthesized").alias("clauses_synthesized"), *[F.sum(c).alias(c) for c in SUMMED],
        F.min_by("first_audio_ms", order).alias("first"), F.sum("output_frames").alias("frames"), *([text.alias("translated_text")] if include_text else []),
    )
    detected = utterances.groupBy(*by).agg(F.count(F.lit(1)).alias("utterances_detected"))
    joined = sessions.join(detected, by, "left").join(sums, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    factor = F.coalesce(F.try_divide(F.col("total_turnaround_ms"), F.nullif("input_duration_ms", F.lit(0))), F.lit(0.0))
    return joined.select(
        *by, *SESSION, F.floor(F.coalesce("frames", F.lit(0)) * 1000 / max(rate, 1)).cast("long").alias("output_duration_ms"), zero("utterances_detected"), zero("utterances_translated"), zero("clauses_synthesized"),
        *map(zero, SUMMED), F.coalesce(F.nullif("first", F.lit(0)), "total_turnaround_ms").cast("long").alias("first_audio_ms"), F.round(factor, 3).alias("realtime_factor"), *(["translated_text"] if include_text else []),
    )


def process_tree_usage(samples: DataFrame, by: list[str], tick: str, rss: str, cpu: str) -> DataFrame:
    """Samples of processes, summed a tick -> peak memory, mean and peak CPU, ticks. A null sample counts 0."""
    ticks = samples.groupBy(*by, tick).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(f"_{n}") for n, c in (("rss", rss), ("cpu", cpu))])
    return ticks.groupBy(*by).agg(F.max("_rss").alias("peak_rss"), F.avg("_cpu").alias("cpu_avg"), F.max("_cpu").alias("cpu_peak"), F.count(F.lit(1)).alias("ticks"))


def occupancy(events: DataFrame, by: list[str], order: list[str], delta: Column, capacity: int, rate: int, block: Column | None = None) -> DataFrame:
    """Each event with the level after it; a ``block`` of the order (see ``scan.running``) spreads one long key over tasks."""
    if block is None:
        placed = events.withColumn("current", F.sum(delta).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        placed = running(events, by, order, block, {"current": ("sum", delta, False)})
    placed = placed.withColumn("fill", F.col("current") / capacity if capacity else F.lit(0.0))
    return placed.withColumn("low", F.col("fill") < 0.1).withColumn("high", F.col("fill") > 0.9).withColumn("latency_ms", F.lit(capacity / rate * 1000) * F.col("fill"))


def backpressure_episodes(levels: DataFrame, by: list[str], order: list[str], level: str, high: float, low: float, block: Column | None = None) -> DataFrame:
    """On at or above ``high``, off at or below ``low``, held between; one row a spell. For ``block`` see ``scan.running``.

    A spell starts with a mark on whose last mark was off, so marks alone number the spells.
    """
    mark = F.when(F.col(level) >= high, 1).when(F.col(level) <= low, 0)
    if block is None:
        series = Window.partitionBy(*by).orderBy(*order)
        upto, before = series.rowsBetween(Window.unboundedPreceding, 0), series.rowsBetween(Window.unboundedPreceding, -1)
        on = levels.withColumn("_on", F.last(mark, ignorenulls=True).over(upto)).withColumn("_was", F.last(mark, ignorenulls=True).over(before))
    else:
        on = running(levels, by, order, block, {"_on": ("last", mark, False), "_was": ("last", mark, True)})
    on = on.withColumn("_start", ((F.col("_on") == 1) & (F.coalesce("_was", F.lit(0)) == 0)).cast("int"))
    spells = on.withColumn("episode", F.sum("_start").over(upto)) if block is None else running(on.filter("_on = 1"), by, order, block, {"episode": ("sum", F.col("_start"), False)})
    return spells.filter("_on = 1").groupBy(*by, "episode").agg(F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count(F.lit(1)).alias("n"))


def in_flight(spans: DataFrame, by: list[str], key: str, start: str, end: str, limit: int, block: Column | None = None) -> DataFrame:
    """Each request with the number open when it is sent (itself included; ends come first at equal times, starts go by key) and whether the limit would reject it.

    A span without an end stays open. ``block`` is of the column ``at``, the time of a start or an end (see ``scan.running``).
    """
    begin = spans.select(*by, F.col(key), F.col(start).alias("at"), F.lit(1).alias("d"))
    both = begin.unionByName(spans.filter(F.col(end).isNotNull()).select(*by, F.col(key), F.col(end).alias("at"), F.lit(-1).alias("d")))
    order = ["at", "d", key]
    if block is None:
        both = both.withColumn("concurrency", F.sum("d").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        both = running(both, by, order, block, {"concurrency": ("sum", F.col("d"), False)})
    return both.filter("d = 1").select(*by, key, "at", "concurrency", (F.col("concurrency") > max(1, limit)).alias("would_reject"))


def restart_budget(crashes: DataFrame, by: list[str], order: list[str], most: int = 3, on_timeout: bool = True) -> DataFrame:
    """Each crash with its number among those that may restart and whether it does; timeouts (column ``timed_out``, if any) only where the policy says so."""
    may = ~F.col("timed_out") if not on_timeout and "timed_out" in crashes.columns else F.lit(True)
    n = F.sum(may.cast("long")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return crashes.withColumn("n", n).withColumn("restarted", may & (F.col("n") <= most))


def lifetimes(states: DataFrame, by: list[str], order: list[str], at: str, state: str) -> DataFrame:
    series = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(state).over(series)
    return states.withColumn("until", F.lead(at).over(series)).withColumn("legal_start", before.isNull() | before.isin("stopped", "error"))


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{b:g}") for b in bounds], F.count(F.lit(1)).alias("le_inf"))


def slo(value: Column, target: float, acceptable: float) -> Column:
    return F.when(value < target, "pass").when(value < acceptable, "acceptable").otherwise("fail")


#: Measure -> (below which it passes, below which it is acceptable); rates have one target.
TARGETS = {"drop_rate": (0.001, 0.001), "underruns_per_minute": (1, 1), "overruns_per_minute": (1, 1), "stt_ms": (500, 1000), "mt_ms": (100, 300), "tts_ms": (300, 500), "total_ms": (1000, 2000), "first_audio_ms": (500, 1000)}
GATE_MS = 3000


def slo_report(measures: DataFrame, by: list[str], p95_first_audio: str = "p95_first_audio_ms") -> DataFrame:
    """Any of the TARGETS' measures a group -> a verdict each, the band of the first audio and the gate of its 95th percentile, where the column of that name is given. Null measures have null verdicts."""
    ms = F.col("first_audio_ms")
    band = F.when(ms < 500, "excellent").when(ms <= 1500, "stretch").when(ms <= 3000, "MVP").when(ms.isNotNull(), "poor")
    verdict = lambda m: F.when(F.col(m).isNotNull(), slo(F.col(m), *TARGETS[m])).alias(m.removesuffix("_ms"))
    found = [verdict(m) for m in TARGETS if m in measures.columns]
    first = [band.alias("band")] if "first_audio_ms" in measures.columns else []
    first += [(F.col(p95_first_audio) <= GATE_MS).alias("passes_gate")] if p95_first_audio in measures.columns else []
    return measures.select(*by, *found, *first)
