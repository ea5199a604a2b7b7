"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` cells each. Two multinomials
over those cells are counted: one from all documents, one from trusted
documents (labels with quality 1), smoothed towards the first. A document's score is the sum
of log(trusted / raw) over its words and pairs, divided by their number; it is
kept when the base rule holds and the score reaches a threshold, which is at most
fixed and lower where the trusted documents, each scored without its own
features, would lose more than FALSE_REJECT. All trusted documents are counted
and scored.

Defined results: a null or blank text has no words, fails the base rule and is
not kept; repeated rows get equal verdicts; null ids are scored like others; an
empty table gives an empty result; without trusted documents both multinomials
are taken as equal and the base rule decides alone; columns of the input that
clash with computed names are not carried by the report.
"""

from __future__ import annotations

from math import log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.llm.scratch import BROADCAST_KEYS, Scratch
from voicelake.llm.text import BLANKS, all_columns, table_column, whole, words
from voicelake.operators.telemetry import ranked_value

#: Cells of each multinomial, enough that junk words seldom share one with common clean words.
BUCKETS = 1 << 16
#: Features of the raw multinomial mixed into the trusted one, at least, so that few trusted documents give mild ratios.
PRIOR = 32768
#: The same as a share of the trusted features, so that ratios do not drift as these grow in number.
PRIOR_SHARE = 1 / 3
#: Nats a feature below which a text looks unlike the trusted ones, at most.
THRESHOLD = -0.1
#: Share of the trusted documents that may fall below the threshold.
FALSE_REJECT = 0.01


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the hashes of words and of pairs, ``_h`` and ``_pairs``."""
    text = whole(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_h"), lines.alias("_lines"),
        F.char_length(F.regexp_replace(text, "[" + BLANKS + "]+", "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    second = first.select(
        *keep, "_h", "word_chars", "n_symbols", F.size("_h").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), pair_hashes(F.col("_h")).alias("_pairs"),
    )
    # a window of five words is two pairs and a word; equal ones have equal pairs, so where all exclusive ors of two pairs differ there are none
    starts = F.slice("_pairs", 1, F.greatest(F.size("_h") - 4, F.lit(0)))
    some = F.size(F.array_distinct(F.transform(starts, lambda p, i: p.bitwiseXOR(F.get("_pairs", i + 2))))) < F.size("_h") - 4
    windows = F.when(some, F.transform(starts, lambda p, i: F.xxhash64(p, F.get("_pairs", i + 2), F.get("_h", i + 4))))
    third = second.withColumn("_g", windows).withColumn(
        "_s", F.when(F.size("_g") > F.size(F.array_distinct("_g")), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    )
    same = lambda s, j: F.coalesce(F.get("_s", j)["g"] == s["g"], F.lit(False))
    fourth = third.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda s, j: same(s, j - 1) | same(s, j + 1)), lambda s: s["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("_p", j + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_g", "_s", "_p")


def pair_hashes(hashes: Column) -> Column:
    """A hash of every two words in a row, one less than words."""
    two = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))
    return F.slice(two, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))


def cell(h: Column) -> Column:
    """The place of a hash in the cells of its kind; BUCKETS is a power of two."""
    return h.bitwiseAND(F.lit(BUCKETS - 1))


def features(hashes: Column) -> Column:
    """Cells of the words, then of the word pairs, of a hashed word sequence."""
    return F.concat(F.transform(hashes, cell), F.transform(pair_hashes(hashes), lambda h: F.lit(BUCKETS) + cell(h)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all trusted documents; up to BROADCAST_KEYS of them are broadcast, more take part in a plain join."""
    chosen = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_trusted")).distinct()
    return F.broadcast(chosen) if chosen.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else chosen


def cell_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, raw, mine): features of all documents and of the trusted ones, counted in one pass; at most 2 * BUCKETS rows, written.

    The words of a text, each with its next one, become rows before they are hashed: rows pass through generated code, functions on array elements do not.
    """
    flagged = docs.select("doc_id", "text").join(trusted_ids(labels), F.col("doc_id") == F.col("_trusted"), "left")
    parted = flagged.select(F.col("_trusted").isNotNull().alias("mine"), words(F.col("text")).alias("_w"))
    # the running number keeps the optimiser from copying the above into a filter on its size
    zipped = parted.select("mine", F.arrays_zip(F.col("_w").alias("w"), F.slice("_w", F.lit(2), F.size("_w")).alias("next")).alias("_z"), F.monotonically_increasing_id().alias("_row"))
    hashed = zipped.filter("_row >= 0").select("mine", F.explode("_z").alias("_z")).select("mine", F.xxhash64("_z.w").alias("_h"), F.when(F.col("_z.next").isNotNull(), F.xxhash64("_z.next")).alias("_next"))
    pair = F.when(F.col("_next").isNotNull(), F.lit(BUCKETS) + cell(F.xxhash64("_h", "_next")))
    cells = hashed.select("mine", F.explode(F.array(cell(F.col("_h")), pair)).alias("cell")).filter("cell IS NOT NULL")
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.count_if("mine").alias("mine"))
    return Scratch(docs.sparkSession, "quality").table(counts, "cells")


def _listed(cells: DataFrame) -> tuple[list[int], list[int]]:
    raw, mine = [0] * (2 * BUCKETS), [0] * (2 * BUCKETS)
    for r in cells.toLocalIterator():
        raw[r["cell"]], mine[r["cell"]] = r["raw"], r["mine"]
    return raw, mine


def _kinds(raw: list[int], mine: list[int]) -> list[tuple[range, int, int, float]]:
    """Cells, raw and trusted features and prior of the two multinomials, words and pairs."""
    ranges = (range(BUCKETS), range(BUCKETS, 2 * BUCKETS))
    totals = [(cells, sum(raw[c] for c in cells), sum(mine[c] for c in cells)) for cells in ranges]
    return [(*x, max(PRIOR, PRIOR_SHARE * x[2])) for x in totals]


def ratios_of(raw: list[int], mine: list[int]) -> list[float]:
    """log(trusted / raw) a cell."""
    out = [0.0] * (2 * BUCKETS)
    for cells, all_raw, all_mine, prior in _kinds(raw, mine):
        for c in cells if all_mine else ():
            if raw[c]:  # a cell that no document has is never looked up
                common = raw[c] / all_raw
                out[c] = log((mine[c] + prior * common) / (all_mine + prior) / common)
    return out


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    return ratios_of(*_listed(cell_counts(docs, labels)))


def calibrated(docs: DataFrame, labels: DataFrame, mine: list[int], raw: list[int]) -> float:
    """THRESHOLD, or less where more than FALSE_REJECT of the trusted documents score below it once their own features are not counted as trusted.

    A trusted document outscores an equal one without a label by its own features, the more so the fewer are counted.
    Each is scored where it lies: a cell that it has once is looked up, those that it has more often are passed once, sorted, a run of equal ones being its own count.
    """
    kinds = _kinds(raw, mine)
    smooth = [prior * raw[c] / max(all_raw, 1) for cells, all_raw, _, prior in kinds for c in cells]
    own = docs.select("doc_id", "text").join(trusted_ids(labels), F.col("doc_id") == F.col("_trusted"))
    # the running number keeps the optimiser from copying the hashing into every step behind it
    hashed = own.select(F.monotonically_increasing_id().alias("_row"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_h"))
    sized = hashed.filter((F.size("_h") > 0) & (F.col("_row") >= 0)).select(F.size("_h").alias("_n"), F.sort_array(features(F.col("_h"))).alias("_f"))
    again = F.filter("_f", lambda c, i: (c == F.get("_f", i - 1)) | (c == F.get("_f", i + 1)))
    parted = sized.withColumn("_again", again).select("_n", F.array_except("_f", "_again").alias("_once"), "_again", F.monotonically_increasing_id().alias("_place"))
    # each table is named once below: the optimiser puts it there in place of a copy a row
    single = [log1p(max(m - 1, 0) / x) if x else 0.0 for m, x in zip(mine, smooth, strict=True)]
    tables = {"_single": table_column(docs.sparkSession, single), "_counted": table_column(docs.sparkSession, mine, "bigint"), "_common": table_column(docs.sparkSession, smooth)}
    tabled = parted.select("*", *[table.alias(name) for name, table in tables.items()])
    # of a cell, (trusted features of others + smoothing) / smoothing; what is equal for all cells of a kind follows below
    alone = F.aggregate("_once", F.lit(0.0), lambda a, cell: a + F.get("_single", cell))
    ended = lambda a: a["sum"] + F.when(a["n"] > 0, a["n"] * F.log1p(F.greatest(F.get("_counted", a["cell"]) - a["n"], F.lit(0)) / F.get("_common", a["cell"]))).otherwise(0.0)
    run = lambda cell, n, total: F.struct(cell.alias("cell"), n.alias("n"), total.alias("sum"))
    step = lambda a, cell: F.when(a["cell"] == cell, run(cell, a["n"] + 1, a["sum"])).otherwise(run(cell, F.lit(1), ended(a)))
    # the cell at the end ends the last run
    gain = alone + F.aggregate(F.concat("_again", F.array(F.lit(-1).cast("long"))), run(F.lit(-2).cast("long"), F.lit(0), F.lit(0.0)), step, lambda a: a["sum"])
    rest = lambda kind, n: n * (F.lit(log(kind[3])) - F.log(kind[2] + kind[3] - n))
    pairs = F.col("_n") - 1
    score = (gain + rest(kinds[0], F.col("_n")) + rest(kinds[1], pairs)) / (F.col("_n") + pairs)
    scores = tabled.select(F.when(F.col("_place") >= 0, score).alias("score"))
    scores = Scratch(docs.sparkSession, "quality").table(scores, "scores")
    place = (F.col("n") - 1) * F.lit(FALSE_REJECT)
    found = ranked_value(scores, [], "score", {"low": (FALSE_REJECT, F.floor(place)), "high": (FALSE_REJECT, F.ceil(place))}).withColumn("part", place - F.floor(place)).first()
    return THRESHOLD if found is None else min(THRESHOLD, found["low"] + found["part"] * (found["high"] - found["low"]))


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float | None = None) -> DataFrame:
    """keep, the base counts, base_failed, score and kept of every row."""
    cells = cell_counts(docs, labels)
    raw, mine = _listed(cells)
    threshold = calibrated(docs, labels, mine, raw) if threshold is None else threshold
    counted = base_counts(docs, keep).withColumn("_row_id", F.monotonically_increasing_id())
    ratios = ratios_of(raw, mine)
    # each named once, behind the running number, the tables are put where they are read in place of a copy a row
    tabled = counted.withColumn("_table", table_column(docs.sparkSession, ratios[:BUCKETS])).withColumn("_pair_table", table_column(docs.sparkSession, ratios[BUCKETS:]))
    by_word = F.aggregate("_h", F.lit(0.0), lambda a, h: a + F.get("_table", cell(h)))
    total, n = F.aggregate("_pairs", by_word, lambda a, h: a + F.get("_pair_table", cell(h))), F.size("_h") + F.size("_pairs")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = tabled.withColumn("score", F.when((n > 0) & (F.col("_row_id") >= 0), total / n).otherwise(0.0)).drop("_table", "_pair_table").withColumn("base_failed", failed)
    # the running number keeps the optimiser from copying all of the above into every step below a filter on the verdict
    scored = scored.withColumn("_place", F.monotonically_increasing_id())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & (F.col("_place") >= 0)).drop("_h", "_pairs", "_row_id", "_place")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    packed = docs.select(F.struct(*all_columns(docs)).alias("_row"), "doc_id", "text")
    return judged(packed, labels, ["_row"]).filter("kept").select("_row.*")


def op6_quality(spark, sf_dir):
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
