"""Collocations from sorted count streams.

Counting goes by length. Every task turns blocks of text into word numbers of
its own and counts phrases of one length exactly, by those numbers; Spark adds
the counts up. A phrase is counted only where the two phrases of one word less
inside it are frequent, which a Bloom filter of at most ``MOST_BITS`` bits
tells without misses: false hits cost a row, and the exact sums decide.

The frequent phrases make one count stream, laid out twice: sorted by words,
where a phrase follows its own beginnings, and by words read backwards, where
it follows its own ends. A pass in step over such a stream knows the counts of
the last phrase of each length, which are the parts left or right of a cut;
and it gives a phrase the largest count among its extensions by one word. Each
range of a stream is a task; what a range's first rows need from earlier ones
is at most three counts, looked up afterwards.

A longer phrase holds an extension by one word that is as frequent at least,
so the extensions by one word decide whether a longer phrase covers one.

Defined results: null text is empty, null lang is ``und``; repeated rows count
again; a text's words outside pieces do not exist; an empty table gives no
rows; only text and lang are read. A piece is held in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voicelake.llm.hashing import mix
from voicelake.llm.scratch import Scratch

LONGEST, LEAST, TOP, SCALE, COVERED = 4, 30, 2000, 2_000_000, 80
#: Bytes of text that a task numbers at once.
BLOCK = 3 << 20
#: Bits of a Bloom filter at least and at most (16 MB), bits a phrase, and probes.
LEAST_BITS, MOST_BITS, BITS_EACH, PROBES = 1 << 16, 1 << 27, 16, 3

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True
_IN_WORD = ~_IS_BREAK
_IN_WORD[[9, 32]] = False


def _string_hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(values.to_pylist(), dtype=object), categorize=False)


def _follow(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mix(h * np.uint64(3) + mix(word))


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield mix(h + np.uint64(k)) & np.uint64(bits - 1)


def _seen(filter_bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    held = np.ones(len(h), bool)
    for p in _probes(h, 64 * len(filter_bits)):
        held &= (filter_bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return held


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end with a piece."""
    while len(text) > BLOCK:
        at = max(text.rfind(x, 0, BLOCK) for x in (bytes([b]) for b in _BREAKS))
        if at < 0:
            later = [p for p in (text.find(bytes([b]), BLOCK) for b in _BREAKS) if p >= 0]
            at = min(later, default=len(text) - 1)
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Langs and texts of about BLOCK bytes together."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            for part in _cut(text.as_py().encode("utf-8", "surrogatepass")):
                if size + len(part) > BLOCK and texts:
                    yield langs, texts
                    langs, texts, size = [], [], 0
                langs.append(lang.as_py())
                texts.append(part)
                size += len(part) + 1
    if texts:
        yield langs, texts


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    found, inverse = np.unique(keys, return_inverse=True)
    return inverse.astype(np.int64), len(found)


def _counted(langs: list[str], texts: list[bytes], width: int, filter_bits: np.ndarray | None) -> Iterator[tuple]:
    """lang, phrase and count arrays of one block."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    within = _IN_WORD[data]
    step = np.empty(len(data) + 2, np.int8)
    step[0] = step[-1] = 0
    step[1:-1] = within
    edges = np.flatnonzero(np.diff(step))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    known = pa.array(langs).dictionary_encode()
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    of_doc = known.indices.to_numpy()
    lang = np.repeat(of_doc, np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[within]))).dictionary_encode()
    word, vocabulary = words.indices.to_numpy().astype(np.int64), words.dictionary
    key = lang * len(vocabulary) + word
    if width == 1:
        yield known.dictionary, pa.array([""] * len(known.dictionary)), np.bincount(lang, minlength=len(known.dictionary))
    else:
        piece = np.searchsorted(np.flatnonzero(_IS_BREAK[data]), starts)
        h = mix(_string_hashes(vocabulary)[word] + mix(_string_hashes(known.dictionary))[lang])
        phrase = h
        for k in range(1, width - 1):
            phrase = _follow(phrase[:-1], h[k:])
        frequent = _seen(filter_bits, phrase)
        places = len(starts) - width + 1
        if places <= 0:
            return
        at = np.flatnonzero(frequent[:places] & frequent[1 : places + 1] & (piece[:places] == piece[width - 1 :]))
        own, dense = (key, len(known.dictionary) * len(vocabulary)) if len(known.dictionary) * len(vocabulary) < 1 << 31 else _dense(key)
        key = own[at]
        for k in range(1, width):
            key = (key if k == 1 else _dense(key)[0]) * dense + own[at + k]
    found, first, n = np.unique(key, return_index=True, return_counts=True)
    if width > 1:
        first = at[first]
    if len(found):
        parts = [vocabulary.take(pa.array(word[first + k])) for k in range(width)]
        yield known.dictionary.take(pa.array(lang[first])), parts[0] if width == 1 else pc.binary_join_element_wise(*parts, " "), n


def _phrases(docs: DataFrame, width: int, filter_bits: np.ndarray | None) -> DataFrame:
    """lang, phrase and n of every phrase of ``width`` words that the filter leaves; of width 1 also each lang's words, as the empty phrase."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_bits)  # at most MOST_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _blocks(batches):
            for lang, phrase, n in _counted(langs, texts, width, sent.value):
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    return docs.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _filter_bits(frequent: DataFrame) -> np.ndarray:
    """The Bloom filter of all phrases, of one length, in a table."""
    bits = LEAST_BITS
    wanted = min(BITS_EACH * frequent.count(), MOST_BITS)
    while bits < wanted:
        bits *= 2

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(batch.column("phrase"), " ")
            h = _string_hashes(lists.flatten()).reshape(batch.num_rows, -1)
            h = mix(h + mix(_string_hashes(batch.column("lang")))[:, None])
            phrase = h[:, 0]
            for k in range(1, h.shape[1]):
                phrase = _follow(phrase, h[:, k])
            p = np.concatenate(list(_probes(phrase, bits)))
            slots, group = np.unique(p >> np.uint64(6), return_inverse=True)
            held = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(held, group, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(held.view(np.int64))], names=["slot", "held"])

    merged = frequent.mapInArrow(probe, "slot long, held long").groupBy("slot").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[merged.column("slot").to_numpy()] = merged.column("held").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, d, n) of all phrases up to ``longest`` words with n >= least, and (lang, n) of all words."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = scratch.table(_phrases(docs, 1, None).filter((F.col("n") >= least) | (F.col("phrase") == "")), "counts-1")
    levels = [first.filter("phrase <> ''").withColumn("d", F.lit(1))]
    for width in range(2, longest + 1):
        found = _phrases(docs, width, _filter_bits(levels[-1])).filter(F.col("n") >= least).withColumn("d", F.lit(width))
        levels.append(scratch.table(found, f"counts-{width}"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every, first.filter("phrase = ''").select("lang", "n")


_STEP = "kind int, range int, lang string, phrase string, d int, n long, c1 long, c2 long, c3 long, extended long"


def _in_step(batches: Iterator[pa.RecordBatch], backwards: bool) -> Iterator[pa.RecordBatch]:
    """One range of a sorted stream: each phrase (kind 0) with the counts of the parts before it and its largest extension.

    Kind 1 adds an extension to a phrase of an earlier batch or range; kind 2 asks for the count of a part that an
    earlier range holds.
    """
    place, carried, asked = TaskContext.get().partitionId(), dict.fromkeys(range(1, LONGEST)), set()
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        d, n = batch.column("d").to_numpy(), batch.column("n").to_numpy()
        lang, phrase = batch.column("lang"), batch.column("phrase")
        at = np.arange(rows)
        last = {k: np.maximum.accumulate(np.where(d == k, at, -1)) for k in range(1, LONGEST)}

        def part(row: int, size: int, phrase=phrase) -> str:
            words = phrase[row].as_py().split(" ")
            return " ".join(words[-size:] if backwards else words[:size])

        extended, extra, counts = np.zeros(rows, np.int64), [], []
        for k in range(1, LONGEST):
            child = np.flatnonzero(d == k + 1)
            parent = last[k][child]
            np.maximum.at(extended, parent[parent >= 0], n[child[parent >= 0]])
            early = child[parent < 0]
            if len(early):
                extra.append((1, lang[early[0]].as_py(), part(early[0], k), k, int(n[early].max())))
            above = last[k] < 0
            value = np.where(above, carried[k] or 0, n[last[k]])
            unknown = (d <= k) | (above & (carried[k] is None))
            counts.append(pa.array(value, pa.int64(), mask=unknown))
            open_rows = np.flatnonzero((d > k) & above) if carried[k] is None else []
            if len(open_rows) and k not in asked:
                asked.add(k)
                extra.append((2, lang[open_rows[0]].as_py(), part(open_rows[0], k), k, None))
            if last[k][-1] >= 0:
                carried[k] = int(n[last[k][-1]])
        fixed = lambda v, size: pa.array(np.full(size, v, np.int32))
        out = [fixed(0, rows), fixed(place, rows), lang, phrase, pa.array(d.astype(np.int32)), pa.array(n), *counts, pa.array(extended, mask=extended == 0)]
        names = [x.split(" ")[0] for x in _STEP.split(", ")]
        yield pa.RecordBatch.from_arrays(out, names=names)
        if extra:
            none = pa.nulls(len(extra), pa.int64())
            columns = [pa.array([x[0] for x in extra], pa.int32()), fixed(place, len(extra)), pa.array([x[1] for x in extra]), pa.array([x[2] for x in extra]), pa.array([x[3] for x in extra], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, none, none, none, none, pa.array([x[4] for x in extra], pa.int64())], names=names)


def _parts(counts: DataFrame, backwards: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n, c1, c2, c3, extended) of all phrases in one order, and further extensions (lang, phrase, extended)."""
    words = F.split("phrase", " ")
    order = [F.col("lang"), F.reverse(words) if backwards else words]
    laid = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    done = scratch.table(laid.mapInArrow(lambda batches: _in_step(batches, backwards), _STEP), "suffix-order" if backwards else "prefix-order")
    # three rows a range at most
    asked = F.broadcast(done.filter("kind = 2").select("range", F.col("d").alias("k"), "lang", "phrase"))
    seeds = counts.join(asked, ["lang", "phrase"]).groupBy("range").agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(f"s{k}") for k in range(1, LONGEST)])
    known = done.filter("kind = 0").join(F.broadcast(seeds), "range", "left")
    filled = [F.coalesce(f"c{k}", F.when(F.col("d") > k, F.col(f"s{k}"))).alias(f"c{k}") for k in range(1, LONGEST)]
    return known.select("lang", "phrase", "d", "n", *filled, "extended"), done.filter("kind = 1").select("lang", "phrase", "extended")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best phrases that no longer phrase covers."""
    scratch = Scratch(docs.sparkSession, "phrases")
    counts, totals = frequent_phrases(docs, scratch, least)
    ahead, more_ahead = _parts(counts, False, scratch)
    behind, more_behind = _parts(counts, True, scratch)
    sides = [("l", ahead), ("r", behind)]
    columns = ["n", *[f"{s}{k}" for s, _ in sides for k in range(1, LONGEST)], "extended"]
    rows = [side.select("lang", "phrase", "n", *[F.col(f"c{k}").alias(f"{s}{k}") for k in range(1, LONGEST)], "extended") for s, side in sides]
    merged = rows[0].unionByName(rows[1], allowMissingColumns=True)
    for more in (more_ahead, more_behind):
        merged = merged.unionByName(more, allowMissingColumns=True)
    merged = merged.groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in columns])
    wide = lambda c: F.col(c).cast("decimal(28,0)")  # noqa: E731  scaled counts may pass 64 bits
    size = F.size(F.split("phrase", " "))
    open_ = merged.filter((size > 1) & ~F.coalesce(100 * wide("extended") >= COVERED * wide("n"), F.lit(False)))

    def cut(k: int, d: int):
        left, right = f"l{k}", f"r{d - k}"
        score = F.floor(F.expr(f"(CAST({SCALE} AS DECIMAL(9,0)) * CAST(n AS DECIMAL(20,0))) div (CAST({left} AS DECIMAL(20,0)) + CAST({right} AS DECIMAL(20,0)))")).cast("long")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    best = F.lit(None)
    for d in range(2, LONGEST + 1):
        best = F.when(size == d, cut(1, d) if d == 2 else F.least(*[cut(k, d) for k in range(1, d)])).otherwise(best)
    scored = open_.withColumn("cut", best).select("lang", "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = Window.partitionBy("lang", "_part").orderBy(*order)  # a lang's phrases are ranked in parts first
    few = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    out = scratch.table(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "best")
    scratch.drop_all(keep="best")
    return out


def op11_phrases(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CUTS = " UNION ALL ".join(
    f"SELECT c.lang, c.phrase, c.f AS a, {k} AS k, x.f AS l, y.f AS r FROM grams c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:{k}], ' ')"
    f" JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[{k + 1}:], ' ') WHERE len(c.w) > {k}"
    for k in range(1, LONGEST)
)
OP11_SQL = rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM said GROUP BY lang),
starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM said WHERE len(w) > 0),
grams AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, count(*)::BIGINT AS f FROM (
    SELECT lang, array_to_string(w[i:i + d - 1], ' ') AS phrase FROM starts, generate_series(1, {LONGEST}) AS t(d) WHERE i + d - 1 <= len(w)) GROUP BY lang, phrase HAVING count(*) >= {LEAST}),
longer AS (SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(w[1:len(w) - 1], ' ') AS phrase, f FROM grams WHERE len(w) > 2 UNION ALL SELECT lang, array_to_string(w[2:], ' '), f FROM grams WHERE len(w) > 2
    UNION ALL SELECT lang, array_to_string(w[1:2], ' '), f FROM grams WHERE len(w) = 4 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM grams WHERE len(w) = 4
    UNION ALL SELECT lang, array_to_string(w[3:4], ' '), f FROM grams WHERE len(w) = 4) GROUP BY lang, phrase),
cuts AS ({_CUTS}),
scored AS (SELECT lang, phrase, a, k, l, r, ({SCALE}::HUGEINT * a // (l::HUGEINT + r))::BIGINT AS score FROM cuts),
chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank, c.phrase, c.a, c.l, c.r, t.n, c.score
FROM chosen c JOIN totals t ON t.lang = c.lang LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase
WHERE NOT coalesce(100::HUGEINT * g.f >= {COVERED}::HUGEINT * c.a, false)
QUALIFY rank <= {TOP}"""
