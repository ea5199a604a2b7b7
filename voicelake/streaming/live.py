"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from voicelake.operators.segment import SegmentConfig, segment_stream


def slo_windows(events: DataFrame, at: str = "ts", width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Errors and events a window; what comes after the watermark is dropped and shows in the query's progress."""
    return events.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count_if(F.col("event_type") == "error").alias("underruns"), F.count(F.lit(1)).alias("n"))


def voiced_sessions(levels: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Silence gaps as sessions: an endpointing without hysteresis and pre-roll."""
    return levels.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("voiced"))


def dedupe_chunks(chunks: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    return chunks.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


#: Groups that requests are dealt to by default.
GROUPS = 512


def _deadlines(key: str, deadline: int, late: int):
    """The open requests of one group and the answers that wait for theirs; rows come when the watermark has passed their deadline.

    A batch is merged into both as a whole, so the number of calls and of state entries does not grow with that of requests.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if group[0] < 0:
            return  # ticks only move the watermark
        #: request -> (sent, first answer or None), request -> times of answers
        requests, early = (pickle.loads(x) for x in state.get) if state.exists else ({}, {})
        for batch in batches:
            for name, kind, at in zip(batch[key].tolist(), batch["kind"].tolist(), batch["at_ms"].tolist(), strict=True):
                if kind != "sent":
                    early.setdefault(name, []).append(at)
                elif name not in requests or at < requests[name][0]:
                    requests[name] = (at, requests[name][1] if name in requests else None)
        for name in [name for name in early if name in requests]:
            sent, answered = requests[name]
            answers = early.pop(name) if answered is None else [*early.pop(name), answered]
            requests[name] = (sent, min((a for a in answers if sent <= a <= sent + deadline), default=None))
        now = state.getCurrentWatermarkMs()
        done = [name for name, (sent, _) in requests.items() if sent + deadline < now]
        rows = [(name, *requests.pop(name)) for name in done]
        # an answer before its request waits for it as long as rows may be late
        early = {name: left for name, ats in early.items() if (left := [a for a in ats if a + late >= now])}
        if requests or early:
            state.update((pickle.dumps(requests), pickle.dumps(early)))
            due = min([*(sent + deadline for sent, _ in requests.values()), *(a + late for ats in early.values() for a in ats)])
            state.setTimeoutTimestamp(max(due, now) + 1)
        elif state.exists:
            state.remove()
        if rows:
            names, sent, answered = zip(*rows, strict=True)
            status = ["timeout" if a is None else "ok" for a in answered]
            yield pd.DataFrame({key: names, "sent": sent, "answered": pd.array(answered, "Int64"), "status": status})

    return step


def correlate_stream(messages: DataFrame, deadline_ms: int, late_ms: int, key: str = "request_id", groups: int = GROUPS) -> DataFrame:
    """(key, kind sent or answered, at) -> one row a request: sent, the first answer inside its deadline, ok or timeout.

    A row comes when the watermark, ``late_ms`` behind the newest row, has passed the deadline: no earlier answer can come
    then, later ones are ignored, and the state is gone. A row with a null key is a tick: it belongs to no request and only
    moves the watermark, so a source that ends closes its last requests by a tick. An answer without a request gives no row.
    Requests are dealt to ``groups`` by hash; a group's open requests are one state entry, held by a task while it is served.
    """
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    rows = messages.withWatermark("at", f"{late_ms} milliseconds").select(group.cast("long").alias("_group"), key, "kind", "at", F.unix_millis("at").alias("at_ms"))
    schema = f"{key} {dict(messages.dtypes)[key]}, sent long, answered long, status string"
    found = rows.groupBy("_group").applyInPandasWithState(_deadlines(key, deadline_ms, late_ms), schema, "requests binary, early binary", "append", "EventTimeTimeout")
    return found.select(key, F.timestamp_millis("sent").alias("sent"), F.timestamp_millis("answered").alias("answered"), "status")


def commit_partials(parts: DataFrame, key: str) -> DataFrame:
    """The latest text a key, a final one before any partial; complete or update mode."""
    newest = F.max(F.struct("is_final", "chunk_id", "text"))
    return parts.groupBy(key).agg(newest.alias("x")).select(key, F.col("x.text").alias("text"), F.when(F.col("x.is_final"), "committed").otherwise("provisional").alias("state"))


def live_metrics(transfers: DataFrame, by: list[str]) -> DataFrame:
    return transfers.groupBy(*by).agg(F.sum("requested").alias("received"), F.sum("moved").alias("emitted"), F.count_if(F.col("moved") == 0).alias("underruns"))


class RunCounters(StreamingQueryListener):
    """Adds up, over the life of a session's queries, the rows dropped as late and the counts that ``counted`` observes.

    A progress report is heard once, also where a query makes more of them than it keeps.
    """

    def __init__(self):
        self.late: dict[str, int] = {}
        self.counts: dict[str, dict[str, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.late.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        progress, run = event.progress, str(event.progress.runId)
        self.late[run] = self.late.get(run, 0) + sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        totals = self.counts.setdefault(run, {})
        for row in progress.observedMetrics.values():
            for name, value in row.asDict().items():
                totals[name] = totals.get(name, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query, seconds: float = 30) -> tuple[int, dict[str, int]]:
        """Late rows and counts of a query's run; of one that has ended, after its last report."""
        until = time.time() + seconds
        while not query.isActive and str(query.runId) not in self.ended and time.time() < until:
            time.sleep(0.05)
        return self.late.get(str(query.runId), 0), self.counts.get(str(query.runId), {})


def run_counters(spark: SparkSession) -> RunCounters:
    """A listener of the session's queries that start from now on; ``spark.streams.removeListener`` ends it."""
    found = RunCounters()
    spark.streams.addListener(found)
    return found


def counted(transfers: DataFrame, name: str = "transfers") -> DataFrame:
    """The transfers as they are, with received, emitted and underruns observed as they pass."""
    sums = [F.sum(c).alias(out) for c, out in (("requested", "received"), ("moved", "emitted"))]
    return transfers.observe(name, *sums, F.count_if(F.col("moved") == 0).alias("underruns"))


def stream_pipeline(chunks: DataFrame, cfg: SegmentConfig, direction: str | None = None, frame: int | None = None, order: str = "frame_idx", value: str = "rms", stage=None, idle_ms: int | None = None, first: int | str = 0) -> DataFrame:
    """A call's legs: levels or chunks of samples -> utterances -> an optional DataFrame stage (models), a leg's rows marked with its direction.

    Without ``direction`` the chunks carry it as a column, and each direction of a stream is a leg of its own. A stage that
    is made of ``apply_engine`` turns failures into error rows, so an utterance is skipped and the stream goes on.
    """
    keys = ["stream_id"] if direction else ["stream_id", "direction"]
    found = segment_stream(chunks, cfg, keys, order=order, value=value, frame=frame, idle_ms=idle_ms, first=first)
    found = found.withColumn("direction", F.lit(direction)) if direction else found
    return stage(found) if stage else found


def write_translations(found: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that commits each batch of both directions once below ``path``/batch_id=N/direction=D.

    A batch that was written but not committed to the checkpoint is replayed under its number and replaces its own files.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("direction").parquet(f"{path}/batch_id={batch_id}")

    return found.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_translations(spark: SparkSession, path: str, schema) -> DataFrame:
    """All committed rows, each once; the folders' batch number and direction are columns."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)
