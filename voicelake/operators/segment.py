"""Utterance segmentation of level series: hysteresis as windows, as a fold, and as a streaming state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from voicelake.operators.scan import block_key, running
from voicelake.workspace import fresh


@dataclass(frozen=True)
class SegmentConfig:
    start: float = 0.015
    keep: float = 0.008
    pre_roll: int = 5
    min_voiced: int = 8
    end_quiet: int = 18
    max_frames: int | None = 750


OUT = "utterance_id long, start_frame long, end_frame long, voiced_frames long, forced_cutoff boolean"


def _epochs(levels: DataFrame, keys: list[str], start: Column, keep: Column, end_quiet: Column) -> DataFrame:
    """Levels with the epoch that each frame lies in; an epoch ends with the frame that completes a quiet run."""
    series = Window.partitionBy(*keys).orderBy("frame_idx")
    upto, before = series.rowsBetween(Window.unboundedPreceding, 0), series.rowsBetween(Window.unboundedPreceding, -1)
    place = levels.withColumn("_n", F.row_number().over(series))
    loud = F.max(F.when(F.col("rms") >= keep, F.col("_n"))).over(upto)
    closer = (F.col("rms") < keep) & (F.col("_n") - F.coalesce(loud, F.lit(0)) == end_quiet)
    numbered = place.withColumn("_closer", closer.cast("int"))
    return numbered.withColumn("_epoch", F.coalesce(F.sum("_closer").over(before), F.lit(0))).withColumn(
        "_onset", F.min(F.when(F.col("rms") >= start, F.col("frame_idx"))).over(Window.partitionBy(*keys, "_epoch"))
    )


def segment_by(levels: DataFrame, keys: list[str], start: Column, keep: Column, end_quiet: Column, min_voiced: Column, pre_roll: Column, on_end: str = "emit") -> DataFrame:
    """Closed form, windows only, one exchange on the keys; parameters may be columns. Valid for start >= keep and no length cap."""
    spans = _epochs(levels, keys, start, keep, end_quiet).groupBy(*keys, "_epoch").agg(
        F.min("_onset").alias("onset"), F.max("frame_idx").alias("end_frame"), F.max("_closer").alias("closed"),
        F.count(F.when((F.col("frame_idx") >= F.col("_onset")) & (F.col("rms") >= keep), 1)).alias("voiced_frames"),
        F.first(min_voiced).alias("_m"), F.first(pre_roll).alias("_p"),
    )
    spans = spans.filter("onset IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy("_epoch")
    spans = spans.withColumn("reset", F.coalesce(F.lag("end_frame").over(order) + 1, F.lit(0)))
    kept = spans.filter("voiced_frames >= _m" + ("" if on_end == "emit" else " AND closed = 1"))
    start_frame = F.col("onset") - F.least(F.col("_p").cast("long"), F.col("onset") - F.col("reset"))
    return kept.select(
        *keys, F.row_number().over(order).cast("long").alias("utterance_id"), start_frame.cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"),
        "voiced_frames", (F.col("closed") == 0).alias("forced_cutoff"),
    )


def _blocked(levels: DataFrame, keys: list[str], cfg: SegmentConfig, span: int) -> tuple[DataFrame, DataFrame]:
    """Frames with their epochs, and the epochs that have an onset, where no task holds more than ``span`` frames of a stream.

    All that a block takes from its past is the length of the quiet run that it begins in, and how many epochs have ended.
    Both follow from one row a block: its rows, its last loud one, those before its first, and the runs it completes itself.
    An epoch's parts in several blocks are added up from the part on that has the onset.
    """
    inside = Window.partitionBy("_block").orderBy("frame_idx")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    loud, opens, zero = F.col("rms") >= cfg.keep, F.col("rms") >= cfg.start, F.lit(0)
    # both uses of these rows take the same columns, so that one exchange serves both
    placed = levels.select("frame_idx", "rms", block_key(keys, F.floor(F.col("frame_idx") / span)).alias("_block"))
    placed = placed.withColumn("_n", F.row_number().over(inside)).withColumn("_loud", F.max(F.when(loud, F.col("_n"))).over(upto))
    own = ~loud & (F.col("_n") - F.col("_loud") == cfg.end_quiet)
    ends = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("rows"), F.max("_loud").alias("loud"), F.count_if(F.col("_loud").isNull()).alias("lead"), F.count_if(own).alias("closers"))
    streams = [F.col(f"_block.k{n}") for n in range(len(keys))]
    past = Window.partitionBy(*streams).orderBy("_block.at").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_begun", F.coalesce(F.sum("rows").over(past), zero))
    quiet = F.col("_begun") - F.coalesce(F.max(F.col("_begun") + F.col("loud")).over(past), zero)
    ends = ends.withColumn("_due", cfg.end_quiet - quiet)  # the row of the block that completes the run it begins in
    completed = F.col("closers") + F.col("_due").between(F.lit(1), F.col("lead")).cast("int")
    carried = ends.select("_block", "_due", F.coalesce(F.sum(completed).over(past), zero).alias("_base"))

    closer = F.when(F.col("_loud").isNull(), F.col("_n") == F.col("_due")).otherwise(own)
    frames = placed.join(carried, "_block").withColumn("_closer", closer.cast("int")).withColumn("_epoch", F.col("_base") + F.coalesce(F.sum("_closer").over(before), zero))
    frames = frames.withColumn("_opened", F.max(F.when(opens, F.col("_epoch"))).over(upto))
    parts = frames.groupBy("_block", "_epoch").agg(
        F.min(F.when(opens, F.col("frame_idx"))).alias("onset"), F.max("frame_idx").alias("end_frame"), F.max("_closer").alias("closed"),
        F.count_if(loud).alias("loud"), F.count_if(loud & (F.col("_opened") == F.col("_epoch"))).alias("opened"),
    )
    own_keys = [s.alias(k) for s, k in zip(streams, keys, strict=True)]
    parts = parts.select(*own_keys, F.col("_block.at").alias("_at"), "_epoch", "onset", "end_frame", "closed", "loud", "opened")
    parts = parts.withColumn("_from", F.min(F.when(F.col("onset").isNotNull(), F.col("_at"))).over(Window.partitionBy(*keys, "_epoch")))
    voiced = F.when(F.col("_at") == F.col("_from"), F.col("opened")).when(F.col("_at") > F.col("_from"), F.col("loud")).otherwise(zero)
    spans = parts.groupBy(*keys, "_epoch").agg(F.min("onset").alias("onset"), F.max("end_frame").alias("end_frame"), F.max("closed").alias("closed"), F.sum(voiced).alias("voiced_frames"))
    return frames.select(*own_keys, "_epoch", "frame_idx", "rms"), spans.filter("onset IS NOT NULL")


def _segment_blocked(levels: DataFrame, keys: list[str], cfg: SegmentConfig, on_end: str, span: int) -> DataFrame:
    spans = _blocked(levels, keys, cfg, span)[1]
    place = fresh(levels.sparkSession, "spans")
    spans.write.parquet(place)  # a row an epoch, read twice below
    kept = (F.col("voiced_frames") >= cfg.min_voiced) & (F.lit(on_end == "emit") | (F.col("closed") == 1))
    spans = levels.sparkSession.read.schema(spans.schema).parquet(place).withColumn("_kept", kept)
    measures = {"_last": ("max", F.col("end_frame"), True), "utterance_id": ("count", F.when(F.col("_kept"), 1), False)}
    placed = running(spans, keys, ["_epoch"], F.floor(F.col("end_frame") / span), measures).filter("_kept")
    start = F.col("onset") - F.least(F.lit(cfg.pre_roll).cast("long"), F.col("onset") - F.coalesce(F.col("_last") + 1, F.lit(0)))
    return placed.select(*keys, F.col("utterance_id").cast("long").alias("utterance_id"), start.cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"), "voiced_frames", (F.col("closed") == 0).alias("forced_cutoff"))


class Machine:
    """The state of one stream between frames."""

    def __init__(self, cfg: SegmentConfig, state: tuple | None = None):
        self.cfg = cfg
        self.first, self.idle, self.voiced, self.quiet, self.count = state or (-1, 0, 0, 0, 0)

    def state(self) -> tuple:
        return self.first, self.idle, self.voiced, self.quiet, self.count

    def _reset(self) -> None:
        self.first, self.idle, self.voiced, self.quiet = -1, 0, 0, 0

    def _emit(self, end: int, forced: bool) -> tuple | None:
        out = None
        if self.voiced >= self.cfg.min_voiced:
            self.count += 1
            out = (self.count, self.first, end, self.voiced, forced)
        self._reset()
        return out

    def push(self, frame: int, rms: float) -> tuple | None:
        cfg = self.cfg
        if self.first < 0:
            if rms < cfg.start:
                self.idle += 1
                return None
            self.first = frame - min(cfg.pre_roll, self.idle)
        if rms >= cfg.keep:
            self.voiced, self.quiet = self.voiced + 1, 0
        else:
            self.quiet += 1
        if self.quiet >= cfg.end_quiet:
            return self._emit(frame, False)
        if cfg.max_frames and frame - self.first + 1 >= cfg.max_frames:
            return self._emit(frame, True)
        return None

    def flush(self, last: int) -> tuple | None:
        return self._emit(last, True) if self.first >= 0 else None


def _row_fields() -> list[str]:
    return [c.split(" ")[0] for c in OUT.split(", ")]


def segment_utterances(levels: DataFrame, cfg: SegmentConfig, keys: list[str], on_end: str = "emit", span: int | None = None) -> DataFrame:
    """keys, frame_idx, rms -> utterances. Epochs under the cap take the closed form; only those that may reach it are folded.

    Each epoch ends idle, so epochs meet in their pre-roll alone: successive long ones are folded together, and what
    follows them starts after their last cut. A null level is silence.

    Windows by stream are a task a stream. With ``span`` a task holds so many frames of a stream, whatever its length, and
    one row a block (with a cap also one an epoch) passes the windows by stream; where start < keep, it has no effect.
    """
    lit = F.lit
    levels = levels.withColumn("rms", F.coalesce("rms", F.lit(0.0)))
    if span and cfg.start >= cfg.keep and not cfg.max_frames:
        return _segment_blocked(levels, keys, cfg, on_end, span)
    if cfg.start >= cfg.keep and not cfg.max_frames:
        return segment_by(levels, keys, lit(cfg.start), lit(cfg.keep), lit(cfg.end_quiet), lit(cfg.min_voiced), lit(cfg.pre_roll), on_end)
    kinds = dict(levels.dtypes)
    of_keys = ", ".join(f"{k} {kinds[k]}" for k in keys)
    if cfg.start < cfg.keep:  # quiet runs no longer tell epochs apart

        def fold(group: pd.DataFrame) -> pd.DataFrame:
            machine, found = Machine(cfg), []
            group = group.sort_values("frame_idx")
            for frame, level in zip(group["frame_idx"], group["rms"], strict=True):
                found.append(machine.push(int(frame), float(level)))
            if len(group) and on_end == "emit":
                found.append(machine.flush(int(group["frame_idx"].iloc[-1])))
            return pd.DataFrame([[*(group[k].iloc[0] for k in keys), *x] for x in found if x], columns=[*keys, *_row_fields()])

        return levels.groupBy(*keys).applyInPandas(fold, f"{of_keys}, {OUT}")

    if span:
        frames, spans = _blocked(levels, keys, cfg, span)
        spans = spans.withColumn("_long", F.col("end_frame") - F.col("onset") + 1 + cfg.pre_roll >= cfg.max_frames)
    else:
        frames = _epochs(levels, keys, lit(cfg.start), lit(cfg.keep), lit(cfg.end_quiet)).withColumn("_last", F.max("frame_idx").over(Window.partitionBy(*keys, "_epoch")))
        frames = frames.withColumn("_long", F.coalesce(F.col("_last") - F.col("_onset") + 1 + cfg.pre_roll >= cfg.max_frames, F.lit(False)))
        spans = frames.groupBy(*keys, "_epoch").agg(
            F.min("_onset").alias("onset"), F.max("frame_idx").alias("end_frame"), F.max("_closer").alias("closed"), F.first("_long").alias("_long"),
            F.count(F.when((F.col("frame_idx") >= F.col("_onset")) & (F.col("rms") >= cfg.keep), 1)).alias("voiced_frames"),
        ).filter("onset IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy("_epoch")
    spans = spans.withColumn("_run", F.sum((~F.col("_long")).cast("int")).over(order)).withColumn("_reset", F.coalesce(F.lag("end_frame").over(order) + 1, F.lit(0)))

    plain, types = [f"k{n}" for n in range(len(keys))], dict(levels.dtypes)
    out_schema = f"{', '.join(f'{p} {types[k]}' for p, k in zip(plain, keys, strict=True))}, _epoch long, start_frame long, end_frame long, voiced_frames long, forced_cutoff boolean, _after long"

    def fold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The epochs of each run, frame by frame -> their utterances, and each epoch's next free frame; a run may go over batches."""
        run = epoch = own = machine = out_types = None
        last = reset = 0
        rows = []

        def closed() -> None:
            if machine.first >= 0 and on_end == "emit" and (found := machine.flush(last)):
                rows.append([*own, epoch, *found[1:], None])
            rows.append([*own, epoch, None, None, None, None, reset])

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(out_types)], names=[*plain, "_epoch", "start_frame", "end_frame", "voiced_frames", "forced_cutoff", "_after"])
            rows.clear()
            return made

        for batch in batches:
            out_types = out_types or [*(batch.column(p).type for p in plain), *[pa.int64()] * 4, pa.bool_(), pa.int64()]
            columns = [batch.column(c).to_pylist() for c in (*plain, "_run", "_epoch", "frame_idx", "rms", "_reset")]
            for *key, of_run, of_epoch, frame, level, begun in zip(*columns, strict=True):
                if key != own or of_run != run or of_epoch != epoch:
                    if own is not None:
                        closed()
                    if key != own or of_run != run:
                        own, run, machine, reset = key, of_run, Machine(cfg), begun
                    epoch, machine.idle = of_epoch, frame - reset
                speaking, found = machine.first >= 0, machine.push(frame, level)
                if found:
                    rows.append([*own, epoch, *found[1:], None])
                if machine.first < 0 and (speaking or found):
                    reset = frame + 1
                last = frame
            if rows:
                yield batch_of()
        if own is not None:
            closed()
            yield batch_of()

    long_spans = spans.filter("_long").select(*keys, "_epoch", "_run", "_reset")
    long_frames = (frames if span else frames.filter("_long")).select(*keys, "_epoch", "frame_idx", "rms").join(long_spans, [*keys, "_epoch"])
    # a run's frames come in order through one task, sorted by the exchange, so a task makes no table a run
    numbers = [F.col(c).cast("long").alias(c) for c in ("_run", "_epoch", "frame_idx")]
    dealt = long_frames.select(*[F.col(k).alias(p) for p, k in zip(plain, keys, strict=True)], *numbers, F.col("rms").cast("double").alias("rms"), F.col("_reset").cast("long").alias("_reset"))
    dealt = dealt.repartition(*plain, "_run").sortWithinPartitions(*plain, "_run", "_epoch", "frame_idx")
    folded = dealt.mapInArrow(fold_runs, out_schema).toDF(*keys, "_epoch", "start_frame", "end_frame", "voiced_frames", "forced_cutoff", "_after")
    cuts = folded.groupBy(*keys, "_epoch").agg(F.max("_after").alias("_after"))
    placed = spans.join(cuts, [*keys, "_epoch"], "left").withColumn("_reset", F.coalesce(F.lag(F.coalesce("_after", F.col("end_frame") + 1)).over(order), F.lit(0)))
    short = placed.filter(f"NOT _long AND voiced_frames >= {cfg.min_voiced}" + ("" if on_end == "emit" else " AND closed = 1"))
    start = F.col("onset") - F.least(F.lit(cfg.pre_roll), F.col("onset") - F.col("_reset"))
    columns = [*keys, "start_frame", "end_frame", "voiced_frames", "forced_cutoff"]
    both = short.select(*keys, start.cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"), "voiced_frames", (F.col("closed") == 0).alias("forced_cutoff"))
    both = both.unionByName(folded.filter("_after IS NULL").select(*columns))
    numbered = both.withColumn("utterance_id", F.row_number().over(Window.partitionBy(*keys).orderBy("start_frame")).cast("long"))
    return numbered.select(*keys, "utterance_id", *columns[len(keys) :])


def sweep_segmentation(levels: DataFrame, configs: dict[int, SegmentConfig], keys: list[str], on_end: str = "emit") -> DataFrame:
    """The utterances of every configuration: cfg_id, keys and the columns of ``segment_utterances``.

    Levels are exchanged and sorted once, whatever the number of configurations; one pass over a stream's frames moves the
    machines of all, whose states live on from batch to batch.
    """
    narrow = levels.select(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], F.col("frame_idx").cast("long").alias("frame_idx"), F.col("rms").cast("double").alias("rms"))
    plain, kinds = narrow.columns[: len(keys)], dict(levels.dtypes)
    names = ["cfg_id", *plain, *_row_fields()]
    schema = f"cfg_id int, {', '.join(f'{p} {kinds[k]}' for p, k in zip(plain, keys, strict=True))}, {OUT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, machines, last = None, {}, -1

        def flushed() -> list[list]:
            ends = [(cfg, m.flush(last)) for cfg, m in machines.items()] if on_end == "emit" else []
            return [[cfg, *own, *found] for cfg, found in ends if found]

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            types = [pa.int32(), *key_types, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        key_types = None
        for batch in batches:
            key_types = key_types or [batch.column(p).type for p in plain]
            rows, columns = [], [batch.column(p).to_pylist() for p in plain]
            for *key, frame, level in zip(*columns, batch.column("frame_idx").to_pylist(), batch.column("rms").to_pylist(), strict=True):
                if key != own:
                    rows += flushed() if own is not None else []
                    own, machines = key, {cfg_id: Machine(cfg) for cfg_id, cfg in configs.items()}
                last = frame
                for cfg_id, machine in machines.items():
                    if found := machine.push(frame, level):
                        rows.append([cfg_id, *own, *found])
            if rows:
                yield batch_of(rows)
        if own is not None and (rows := flushed()):
            yield batch_of(rows)

    dealt = narrow.repartition(*plain).sortWithinPartitions(*plain, "frame_idx")
    return dealt.mapInArrow(run, schema).toDF("cfg_id", *keys, *_row_fields())


#: Groups that streams are dealt to; early rows that a stream keeps beside its machine; numbers whose early rows are one entry of the map.
GROUPS, NEAR, HELD = 512, 256, 4096
#: Rows of a stream that are Python values at a time.
SLICE = 1 << 16


class _Segmenter(StatefulProcessor):
    """The machines of one group of streams, and a map of the rows that came before their turn.

    All machines of a group are one state entry, with up to NEAR early rows each. Where a stream has more, they are entries
    of a map, HELD numbers each, so a batch touches the blocks that it brings rows of and those that it sets free, however
    many are held.
    """

    def __init__(self, cfg: SegmentConfig, keys: list[str], order: str, value: str, frame: int | None, idle_ms: int | None, first: int | str):
        self.cfg, self.keys, self.order, self.value, self.frame, self.idle_ms, self.first = cfg, keys, order, value, frame, idle_ms, first

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machines", "streams binary, timer long")
        self.held = handle.getMapState("held", "stream binary, block long", "rows binary")

    def _load(self) -> tuple[dict, int | None]:
        """stream -> machine, at, due, late, residual, early rows by number, blocks that hold the others, silent from; and the group's timer."""
        if not self.state.exists():
            return {}, None
        streams, timer = self.state.get()
        return pickle.loads(streams), timer

    def _rows(self, stream: tuple, block: int) -> dict:
        """number -> item of a block that holds rows."""
        numbers, items = pickle.loads(self.held.getValue((pickle.dumps(stream), block))[0])
        return dict(zip(numbers.tolist(), items.tolist() if self.frame is None else items, strict=True))

    def _hold(self, stream: tuple, block: int, known: set, rows: dict) -> None:
        if rows:
            packed = np.array(list(rows), np.int64), np.array(list(rows.values()), float) if self.frame is None else list(rows.values())
            self.held.updateValue((pickle.dumps(stream), block), (pickle.dumps(packed),))
            known.add(block)
        elif block in known:
            self.held.removeKey((pickle.dumps(stream), block))
            known.discard(block)

    def _take(self, machine: Machine, at: int, residual: list, items: list, found: list) -> tuple[int, list]:
        """Items in their order through the machine."""
        levels = items if self.frame is None else []
        if self.frame is not None and items:
            samples = np.concatenate((residual, *items))
            whole = len(samples) // self.frame
            levels = np.sqrt(np.mean(samples[: whole * self.frame].reshape(whole, self.frame) ** 2, axis=1)).tolist() if whole else []
            residual = samples[whole * self.frame :].tolist()
        for level in levels:
            if utterance := machine.push(at, level):
                found.append(utterance)
            at += 1
        return at, residual

    def _pass(self, stream: tuple, kept: tuple | None, first: int, numbers: list, items: list) -> tuple[tuple, list]:
        """One stream's new rows, by number: takes what is due, holds what is early; what has passed or is held counts as late."""
        state, at, due, late, residual, near, known, _ = kept or (None, first if self.frame is None else 0, first, 0, [], {}, set(), 0)
        machine, found = Machine(self.cfg, state), []
        for number, item in zip(numbers, items, strict=True):
            if number < due or number in near:
                late += 1
            else:
                near[number] = item
        if not known:
            ready = []
            while due in near:
                ready.append(near.pop(due))
                due += 1
            at, residual = self._take(machine, at, residual, ready, found)
        if known or len(near) > NEAR:
            touched, done = {}, set()
            for number in sorted(near):
                touched.setdefault(number // HELD, []).append(number)
            todo = list(reversed(touched))
            while todo or due // HELD in known - done:
                block = due // HELD if due // HELD in known - done else todo.pop()
                if block in done:
                    continue
                done.add(block)
                rows = self._rows(stream, block) if block in known else {}
                for number in touched.get(block, ()):
                    if number in rows:
                        late += 1
                    else:
                        rows[number] = near[number]
                ready = []
                while due in rows:
                    ready.append(rows.pop(due))
                    due += 1
                at, residual = self._take(machine, at, residual, ready, found)
                self._hold(stream, block, known, rows)
            near = {}
        return (machine.state(), at, due, late, residual, near, known, 0), found

    def _frame_of(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keys, *_row_fields(), "late"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = [batch for batch in rows if len(batch)]
        if not batches:
            return
        (streams, timer), out, new = self._load(), [], pd.concat(batches, ignore_index=True)
        numbers, items, codes = new[self.order].to_numpy(np.int64), new[self.value].to_numpy(float if self.frame is None else object), np.zeros(len(new), np.int64)
        for c in self.keys:
            ranks, names = pd.factorize(new[c])
            codes = pd.factorize(codes * (len(names) + 1) + ranks)[0]
        order = np.lexsort((numbers, codes))
        ends = [*(np.flatnonzero(np.diff(codes[order])) + 1).tolist(), len(order)]
        silent, start = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms if self.idle_ms else 0, 0
        starts = np.minimum.reduceat(order, [0, *ends[:-1]])  # the row of each stream that came first
        own_keys = [[None] * len(ends) if key[0] // GROUPS >> n & 1 else new[c].iloc[starts].tolist() for n, c in enumerate(self.keys)]
        firsts = new[self.first].iloc[starts].tolist() if isinstance(self.first, str) else [self.first] * len(ends)
        for end, first, *stream in zip(ends, firsts, *own_keys, strict=True):
            stream, kept, ended = tuple(stream), None, []
            for at in range(start, end, SLICE):  # by number, so parts give what the whole does
                own = order[at : min(at + SLICE, end)]
                values = items[own].tolist() if self.frame is None else [np.asarray(x, float) for x in items[own]]
                kept, found = self._pass(stream, kept or streams.get(stream), int(first), numbers[own].tolist(), values)
                ended += found
            start, streams[stream] = end, (*kept[:-1], silent)
            out += [[*stream, *utterance, kept[3]] for utterance in ended]
        self._keep(streams, timer)
        yield self._frame_of(out)

    def _keep(self, streams: dict, timer: int | None) -> None:
        """Stores the group's streams; the timer is that of the stream that has been silent longest."""
        wait = min((kept[-1] for kept in streams.values() if kept[-1]), default=None)
        if wait != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wait is not None:
                self.handle.registerTimer(wait)
        self.state.update((pickle.dumps(streams), wait))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Some streams are silent: what they hold follows without the missing rows, and the open utterance ends."""
        (streams, _), out, now = self._load(), [], expiredTimerInfo.getExpiryTimeInMs()
        for stream, (state, at, due, late, residual, near, known, silent) in streams.items():
            if not silent or silent > now:
                continue
            machine, found = Machine(self.cfg, state), []
            for block in [None, *sorted(known)]:
                rows = dict(near) if block is None else self._rows(stream, block)
                at, residual = self._take(machine, at, residual, [rows[k] for k in sorted(rows)], found)
                due = max(rows, default=due - 1) + 1
                if block is not None:
                    self._hold(stream, block, known, {})
            found.append(machine.flush(at - 1))
            streams[stream] = (machine.state(), at, due, late, residual, {}, known, 0)
            out += [[*stream, *x, late] for x in found if x]
        self._keep(streams, None)
        yield self._frame_of(out)

    def close(self) -> None:
        pass


def keyed_states(spark: SparkSession) -> None:
    """Keyed state with maps and timers needs the RocksDB store, which is set where no other than Spark's default is."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(name, "HDFSBackedStateStoreProvider"):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def segment_stream(rows: DataFrame, cfg: SegmentConfig, key: str | list[str] = "stream_id", order: str = "frame_idx", value: str = "rms", frame: int | None = None, idle_ms: int | None = None, first: int | str = 0):
    """The machine over a stream of (key, order, value), in the order of its numbers, whatever batch a row comes in.

    A value is a frame's level, or with ``frame`` a chunk of samples of any length, whose rest waits for the next chunk.
    Numbers begin with ``first``, or with what the column of that name says. Early rows are held, as many as there are; a
    number that has passed, or is held, is late or a copy and dropped (``late`` counts those so far). A missing row holds
    back all that follow: for ever, or with ``idle_ms`` until its stream has been silent so long, when all held rows are
    taken and the tail is flushed. Streams are dealt to GROUPS by hash; a group's machines are one state entry.
    """
    keyed_states(rows.sparkSession)
    keys, kinds = [key] if isinstance(key, str) else list(key), dict(rows.dtypes)
    processor = _Segmenter(cfg, keys, order, value, frame, idle_ms, first)
    schema = f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, {OUT}, late long"
    nulls = sum((F.col(k).isNull().cast("int") * 2**n for n, k in enumerate(keys)), F.lit(0))  # nulls would change the type of a column in pandas
    group = (nulls * GROUPS + F.pmod(F.xxhash64(*keys), F.lit(GROUPS))).cast("long")
    return rows.withColumn("_group", group).groupBy("_group").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if idle_ms else "None")


def gather(utterances: DataFrame, chunks: DataFrame, key: str, block: int = 256) -> DataFrame:
    """Rows of ``chunks`` (key, frame_idx, ...) inside each utterance: an equi join on key and block of frames, then the exact bounds."""
    touched = F.explode(F.sequence(F.floor(F.col("start_frame") / block), F.floor(F.col("end_frame") / block)))
    spans = utterances.select(F.col(key), "utterance_id", "start_frame", "end_frame", touched.alias("_block"))
    return spans.join(chunks.withColumn("_block", F.floor(F.col("frame_idx") / block)), [key, "_block"]).filter("frame_idx BETWEEN start_frame AND end_frame").drop("_block")


def segment_facts(utterances: DataFrame, frame_samples: int, rate: int) -> DataFrame:
    samples = (F.col("end_frame") - F.col("start_frame") + 1) * frame_samples
    return utterances.withColumn("n_samples", samples).withColumn("duration_ms", F.floor(samples * 1000 / rate).cast("long") if rate else F.lit(0).cast("long"))
