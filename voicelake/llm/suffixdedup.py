"""Removal of long repeated byte strings by distributed prefix doubling.

Prefix doubling names the string of growing length at each position, and goes
on only where a name is not unique. Here a name is a fingerprint in
place of a dense rank, so that a longer name needs no exchange of its own, and
positions move in runs. Names that say which strings are equal have 128 bits;
cores, which only tell what may be equal, have 64. Two names belong to a run of 200-byte windows: that of
a core, which all its windows contain, and that of the whole string which they
cover. A run with a unique core is past; one whose whole string is not unique
repeats entirely; of the rest, one run for each different string goes on to
the next length, split finer:

1. cores of ``ANCHOR`` bytes: the smallest fingerprint inside each window.
   Windows next to each other mostly share it and form a run; equal windows
   have equal anchors at equal offsets.
2. cores of 193 bytes: runs are split into cells of 8 windows, by their
   distance from the anchor.
3. single windows, named by the pair of the names of their two halves.

So the rows that move are runs and open positions, never all positions: naming
every byte would move 16 bytes and more for each byte of text and round.

Defined results: a null text is empty; texts under 200 bytes lose nothing;
rows equal in id and text are different places, so they repeat each other;
null ids pass through; an empty table gives an empty result. Where a cut text
is wanted as a string, bytes that are no longer whole characters are left out,
and all columns of the input stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.llm.hashing import Ranges, mix
from voicelake.llm.scratch import Scratch, matching
from voicelake.llm.text import all_columns

WINDOW, ANCHOR, CELL = 200, 50, 8
#: Windows that are worked on at once; bounds a task's memory for texts of any length.
BLOCK = 1 << 20
_MASK = np.uint64((1 << 28) - 1)


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int, tuple[Ranges, Ranges]]]:
    """(first window, windows, both hashes of their bytes)."""
    for first in range(0, len(data) - WINDOW + 1, BLOCK):
        count = min(BLOCK, len(data) - WINDOW + 1 - first)
        yield first, count, _both(data[first : first + count + WINDOW - 1])


def _both(data: np.ndarray) -> tuple[Ranges, Ranges]:
    return Ranges(data), Ranges(data, 1)


def _names(ranges: tuple[Ranges, Ranges], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(r.hashes(start, end).view(np.int64) for r in ranges)


#: Core name, both halves of the whole string's name, first window, end.
Parts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs(data: np.ndarray) -> Parts:
    """Runs of windows with one anchor."""
    found = []
    for first, count, ranges in _blocks(data):
        names, reach = ranges[0].fixed(ANCHOR), WINDOW - ANCHOR + 1
        packed = (names & ~_MASK) | np.arange(len(names), dtype=np.uint64)
        rows = -(-len(packed) // reach)
        grid = np.full(rows * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[: len(packed)] = packed
        grid = grid.reshape(rows, reach)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count]) & _MASK).astype(np.int64)
        start = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        end = np.append(start[1:], count)
        found.append((names[anchor[start]].view(np.int64), *_names(ranges, start, end + (WINDOW - 1)), start + first, end + first))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5


def cells(data: np.ndarray, start: int, end: int) -> Parts:
    """A run split by distance from its anchor."""
    ranges = _both(data[start : end + WINDOW - 1])
    anchor = int(np.argmin(ranges[0].fixed(ANCHOR)[: WINDOW - ANCHOR + 1] & ~_MASK))
    cell = (anchor - np.arange(end - start)) // CELL
    first = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1))
    last = np.append(first[1:], end - start)
    core = anchor - CELL * cell[first]
    return ranges[0].hashes(core, core + (WINDOW - CELL + 1)).view(np.int64), *_names(ranges, first, last + (WINDOW - 1)), first + start, last + start


def windows(data: np.ndarray, start: int, end: int) -> Parts:
    """The single windows of a run; core and whole string are the window."""
    names = []
    for ranges in _both(data[start : end + WINDOW - 1]):
        half = ranges.fixed(WINDOW // 2)
        names.append(mix(half[: end - start] * np.uint64(5) + half[WINDOW // 2 : WINDOW // 2 + end - start]).view(np.int64))
    place = np.arange(start, end)
    return names[0], *names, place, place + 1


def removed(n_bytes: int, starts: list[int], ends: list[int]) -> np.ndarray:
    """Whether each byte is covered, from runs [start, end) of repeated windows."""
    edge = np.zeros(n_bytes + 1, np.int32)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(ends, np.int64) + (WINDOW - 1), -1)
    return np.cumsum(edge[:-1]) > 0


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("s", pa.int32()), ("e", pa.int32())]))


def _name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        sizes, hashes, packed, lengths, parts = [], [], [], [], []
        for text in batch.column(2):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            sizes.append(len(data))
            hashes.append(hashlib.sha256(data).hexdigest())
            packed.append(packer.compress(data) if len(data) >= WINDOW else None)
            own = runs(np.frombuffer(data, np.uint8))
            lengths.append(len(own[0]))
            parts.append(own)
        flat = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(5)]
        rows = pa.StructArray.from_arrays([*map(pa.array, flat[:3]), *(pa.array(x.astype(np.int32)) for x in flat[3:])], names=["a", "u", "v", "s", "e"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(packed, pa.binary()), lists], names=["uid", "doc_id", "n_bytes", "whole_sha256", "packed", "runs"])


def _unpacked(packed) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _splitter(split):
    def name_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, packed, open_runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(_unpacked(packed), np.uint8)
                a, u, v, s, e = (np.concatenate(x) for x in zip(*(split(data, r["s"], r["e"]) for r in open_runs), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), uid, np.int64)), *map(pa.array, (a, u, v)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["uid", "a", "u", "v", "s", "e"])

    return name_parts


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for uid, packed, covered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = np.frombuffer(_unpacked(packed), np.uint8)
            gone = removed(len(data), covered.values.field("s").to_numpy(), covered.values.field("e").to_numpy())
            kept = data[~gone].tobytes()
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            out.append((uid, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["uid", "n_removed", "n_spans", "sha256", "cut_text"])


def _named(docs: DataFrame, uid: Column, scratch: Scratch) -> DataFrame:
    """One row a document: a number of its own, size, digest, packed text and runs."""
    columns = docs.select(uid.alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "uid long, doc_id long, n_bytes long, whole_sha256 string, packed binary, runs array<struct<a:long,u:long,v:long,s:int,e:int>>"
    return scratch.table(columns.mapInArrow(_name_runs, schema), "named")


def _level(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(uid, core a, whole u v, s, e) -> runs that repeat entirely (uid, s, e); runs to be split (uid, open)."""
    twice = scratch.table(rows.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"), f"twice-{name}")
    alive = scratch.table(rows.join(twice, "a"), f"alive-{name}")
    strings = scratch.table(alive.groupBy("u", "v").agg(F.min("a").alias("a"), F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "s", "e")).alias("first")), f"strings-{name}")
    full = alive.join(scratch.table(strings.filter("n > 1").select("u", "v"), f"full-{name}"), ["u", "v"]).select("uid", "s", "e")
    several = scratch.table(strings.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("a"), f"several-{name}")
    asked = strings.join(several, "a").select("first.*").groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("open"))
    return full, scratch.table(asked, f"asked-{name}")


def _cuts(named: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, n_removed, n_spans, sha256 and text of the documents that lose bytes."""
    schema = "uid long, a long, u long, v long, s int, e int"
    texts = named.select("uid", "packed")
    long_runs, asked = _level(named.select("uid", F.inline("runs")), scratch, "runs")
    parts = matching(texts, asked, "uid", scratch).select("uid", "packed", "open").mapInArrow(_splitter(cells), schema)
    some_cells, asked = _level(scratch.table(parts, "cells"), scratch, "cells")
    parts = scratch.table(matching(texts, asked, "uid", scratch).select("uid", "packed", "open").mapInArrow(_splitter(windows), schema), "windows")
    again = scratch.table(parts.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u", "v"), "again")
    single = parts.join(again, ["u", "v"]).select("uid", "s", "e")
    covered = long_runs.unionByName(some_cells).unionByName(single).groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("covered"))
    covered = scratch.table(covered, "covered")
    for name in ("cells", "windows", "again", *(f"{kind}-{level}" for kind in ("twice", "alive", "strings", "full", "several", "asked") for level in ("runs", "cells"))):
        scratch.drop(name)
    return matching(texts, covered, "uid", scratch).select("uid", "packed", "covered").mapInArrow(_cut, "uid long, n_removed long, n_spans long, sha256 string, cut_text string")


def repeat_report(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "suffixdedup")
    named = _named(docs, F.monotonically_increasing_id(), scratch)
    cuts = scratch.table(_cuts(named, scratch).drop("cut_text"), "cuts")
    joined = named.select("uid", "doc_id", "n_bytes", "whole_sha256").join(cuts, "uid", "left")
    none = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("sha256", "whole_sha256").alias("kept_sha256"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, with their own columns (n_chars follows the text); those with nothing left go."""
    scratch = Scratch(docs.sparkSession, "suffixdedup")
    named = _named(docs, F.monotonically_increasing_id(), scratch)
    cuts = scratch.table(_cuts(named, scratch).select("uid", F.col("cut_text").alias("_cut_text")), "cuts")
    # rows that are equal in id and text are cut alike, so these two say which text is meant
    marks = named.select("uid", F.col("doc_id").alias("_cut_id"), F.col("whole_sha256").alias("_cut_sha"))
    cut = scratch.table(marks.join(cuts, "uid").select("_cut_id", "_cut_sha", "_cut_text").dropDuplicates(["_cut_id", "_cut_sha"]), "cut")
    for name in ("named", "covered", "cuts"):
        scratch.drop(name)
    packed = docs.select(F.struct(*all_columns(docs)).alias("_row"))
    same = F.col("_row.doc_id").cast("bigint").eqNullSafe(F.col("_cut_id")) & (F.sha2(F.coalesce(F.col("_row.text").cast("string"), F.lit("")), 256) == F.col("_cut_sha"))
    joined = packed.join(cut, same, "left").filter("_cut_text IS NULL OR _cut_text <> ''")
    own = {c: F.col("_row").getField(c) for c in docs.columns}
    own["text"] = F.coalesce("_cut_text", own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_cut_text").isNotNull(), F.char_length("_cut_text")).otherwise(own["n_chars"]).cast("long")
    return joined.select(*[value.alias(name) for name, value in own.items()])


def op7_repeats(spark, sf_dir):
    return repeat_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
