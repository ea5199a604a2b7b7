"""Mixing, fingerprints, shards and quality rules against plain versions."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voicelake.llm import fingerprint, mixing, quality, sharding, successor
from voicelake.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_targets_and_determinism(edge):
    rows = mixing.mix_report(edge).collect()
    assert len(rows) == edge.count()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(edge.repartition(7)).collect()))
    by = defaultdict(list)
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(g[0]["target"] for g in by.values()) - total) < 1e-6 * total
    sizes = {s: sum(r["size"] for r in g) for s, g in by.items()}
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, open_, left = {}, set(by), float(total)
    while True:  # the contract's resharing, round by round
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            want |= {s: share * weight[s] for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    for s, g in by.items():
        assert g[0]["source_size"] == sizes[s] and abs(g[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in g) - want[s]) <= max(r["size"] for r in g) / 2 + 1


def test_mix_rows(edge, none):
    report = Counter()
    for r in mixing.mix_report(edge).collect():
        report[r["doc_id"]] += r["copies"]
    assert {r["_times"] for r in mixing.mix(edge.withColumns({"_times": F.lit(77), "_copy": F.lit("c"), "_plan": F.lit(1), "whole": F.lit(2)})).collect()} == {77}
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +report
    assert mixing.mix(none).count() == mixing.mix_report(none).count() == 0


def test_mix_of_equal_rows(spark):
    """The budget runs out among rows equal in id and text: the nearest number of them is taken, in the report, the mix and the SQL twin."""
    import duckdb

    rows = [(1, "one two three", "a", 0.5)] * 100 + [(2, "x " * 10, "b", 0.5)] * 33 + [(3, "y", "b", 0.5), (4, None, None, 0.5), (4, None, None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` double").repartition(7)
    got = mixing.mix_report(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(r["size"] for r in group) / 2 + 1e-6
        assert max(r["copies"] for r in group) - min(r["copies"] for r in group) <= 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == sum((Counter({r["doc_id"]: r["copies"]}) for r in got), Counter())
    db = duckdb.connect()
    documents = docs.drop("a.b").toPandas()  # noqa: F841
    want = db.sql(mixing.OP1_SQL).fetchall()
    assert Counter((r["doc_id"], r["size"], round(r["target"], 6), r["taken"]) for r in got) == Counter((w[0], w[1], round(w[3], 6), w[4]) for w in want)
    # a single source whose only text cannot be taken in whole multiples of all
    single = mixing.thresholds(mixing.measure(docs.filter("source = 'a'"), Scratch(spark, "t")), Scratch(spark, "t"), [1], share=2 / 3).first()
    assert (single["whole"], single["some"]) == (0, 67)


def test_columns_with_dots(spark, labels):
    rows = [(i, f"word{i % 7} of the text number {i} " * 40, "s", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int")
    from voicelake.llm import suffixdedup

    for out in (mixing.mix(docs), quality.quality_filter(docs, labels), suffixdedup.cut_repeats(docs)):
        assert out.columns == docs.columns and {r["a.b"] == r["doc_id"] for r in out.collect()} <= {True}


@pytest.mark.parametrize("n_shards", [4, 16])
def test_shards(edge, none, n_shards):
    rows = sharding.shard_report(edge, n_shards).collect()
    texts = [r["text"] for r in edge.collect()]
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())
    assert set(by) <= set(range(n_shards)) and {r["law"] for r in rows} == {"bytes"}
    share, largest = sum(r["size"] for r in rows) / n_shards, max(r["size"] for r in rows)
    for j in range(n_shards):
        assert abs(sum(r["size"] for r in by[j]) - share) <= 0.1 * share + largest
    assert sharding.shard_report(none, n_shards).count() == 0


def test_hot_text_is_split_and_small_groups_are_not(spark):
    df = spark.createDataFrame([(i, "hot text " * 5 if i % 2 else f"own text {i // 4}") for i in range(4000)], "doc_id long, text string")
    rows = sharding.shard_report(df, 8).collect()
    sizes, shards = Counter(), defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        if r["size"] < 40:
            shards[r["text_crc32"]].add(r["shard"])
    assert max(sizes.values()) / min(sizes.values()) < 1.05
    assert all(len(s) == 1 for s in shards.values())


def test_equal_rows_are_cut(spark):
    """3000 rows equal in id and text fill all shards, and their slots are dealt in parts."""
    rows = [(1, "same text")] * 3000 + [(i, f"own {i}") for i in range(48)]
    cell, sharding.ROWS_PER_CELL = sharding.ROWS_PER_CELL, 100
    try:
        got = sharding.shard_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        sharding.ROWS_PER_CELL = cell
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and len(sizes) == 16 and max(sizes.values()) / min(sizes.values()) < 1.3
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_written_shards(spark, edge, tmp_path):
    sharding.write_shards(edge.withColumn("k1", F.lit("own")), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*edge.columns, "k1", "shard_of_input"}
    kept = edge.columns[:-2] + ["mark"]
    assert Counter(map(tuple, back.select(*kept).collect())) == Counter(map(tuple, edge.select(*kept).collect()))
    assert {r[0] for r in back.select("shard").distinct().collect()} <= set(range(4))


def test_quality_counts(edge, none, labels):
    texts = defaultdict(list)
    for r in edge.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    got = defaultdict(list)
    for r in quality.quality_report(edge, labels).collect():
        got[r["doc_id"]].append(tuple(r)[1:7])
        assert not (r["kept"] and r["base_failed"])
    for i, mine in texts.items():
        want = []
        for text in mine:
            w = WORD.findall(text)
            seen, windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
            repeat = len({k + d for k, x in enumerate(windows) if seen[x] > 1 for d in range(5)})
            lines = [x for x in text.split("\n") if WORD.search(x)]
            want.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)))
        assert sorted(got[i]) == sorted(want)
    kept = quality.quality_filter(edge, labels)
    assert kept.columns == edge.columns and kept.count() == quality.quality_report(edge, labels).filter("kept").count()
    assert quality.quality_report(none, labels).count() == 0


def test_quality_scores(spark, edge, labels):
    """The score against counting in plain Python, on the same cells."""
    from voicelake.llm.text import words

    h = quality.features(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    cells = [(r[0], r[1]) for r in edge.select("doc_id", h).collect()]
    trusted = {r["doc_id"] for r in labels.filter("quality = 1 AND doc_id IS NOT NULL").collect()}
    table = quality.log_ratios(edge, labels)
    for kind in (0, 1):
        raw, mine = Counter(), Counter()
        for i, c in cells:
            own = [x for x in c if x // quality.BUCKETS == kind]
            raw.update(own)
            if i in trusted:
                mine.update(own)
        from math import log

        for cell, n in raw.items():
            p = n / sum(raw.values())
            assert abs(table[cell] - log((mine[cell] + quality.PRIOR * p) / (sum(mine.values()) + quality.PRIOR) / p)) < 1e-9


def test_quality_verdicts(edge, labels):
    """Score and verdict of every document, and the threshold, in plain Python on the same cells."""
    from math import log

    from voicelake.llm.text import words

    h = quality.features(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    rows = [(r[0], r[1] or "", r[2]) for r in edge.select("doc_id", "text", h).collect()]
    trusted = {r["doc_id"] for r in labels.filter("quality = 1 AND doc_id IS NOT NULL").collect()}
    kind = lambda c: c // quality.BUCKETS
    raw, mine, totals, own_totals = Counter(), Counter(), Counter(), Counter()
    for i, _, cells in rows:
        for c in cells:
            raw[c] += 1
            totals[kind(c)] += 1
            if i in trusted:
                mine[c] += 1
                own_totals[kind(c)] += 1
    prior = {k: max(quality.PRIOR, quality.PRIOR_SHARE * own_totals[k]) for k in (0, 1)}

    def score(cells, without=False):
        less, sums = (Counter(cells), Counter(map(kind, cells))) if without else (Counter(), Counter())
        parts = []
        for c in cells:
            k, p = kind(c), raw[c] / totals[kind(c)]
            parts.append(log((mine[c] - less[c] + prior[k] * p) / (own_totals[k] - sums[k] + prior[k]) / p))
        return sum(parts) / len(parts) if parts else 0.0

    left_out = [score(c, True) for i, _, c in rows if i in trusted and c]
    threshold = min(quality.THRESHOLD, float(np.quantile(left_out, quality.FALSE_REJECT)))
    want = defaultdict(list)
    for i, text, cells in rows:
        w = WORD.findall(text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(windows)
        repeat = len({k + d for k, x in enumerate(windows) if seen[x] > 1 for d in range(5)})
        s = score(cells)
        want[i].append((s, not (len(w) < 10 or 100 * repeat > 20 * len(w)) and s >= threshold))
    got = defaultdict(list)
    for r in quality.quality_report(edge, labels).collect():
        got[r["doc_id"]].append((r["score"], r["kept"]))
    assert set(got) == set(want)
    for i in want:
        for (a, keep), (b, kept) in zip(sorted(want[i]), sorted(got[i]), strict=True):
            assert abs(a - b) < 1e-4 and (keep == kept or abs(a - threshold) < 1e-4)
    assert len({k for g in got.values() for _, k in g}) == 2


def test_junk_is_rejected(spark):
    import random

    rng = random.Random(1)
    good, junk = [f"w{i}" for i in range(200)], [f"j{i}%%%" for i in range(200)]
    rows = [(i, " ".join(rng.choice(good if i % 5 else junk) for _ in range(300)), i % 5) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(k > 0)) for i, _, k in rows if i % 2], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.quality_report(docs, marks).filter("kept").collect()}
    assert kept == {i for i, _, k in rows if k}


def plain_mark(text):
    """Order MinHash in plain Python, with the same 64-bit hashes."""
    hash_of = lambda value, seed=42: xxhash.xxh64_intdigest(value if isinstance(value, bytes) else struct.pack("<Q", value), seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    high = lambda x: x & ~((1 << fingerprint.LOW) - 1) & ((1 << 64) - 1)
    pieces = [hash_of(w.encode()) for w in re.findall(rf"[^\x20\x09-\x0D]{{1,{fingerprint.PIECE}}}", text)]
    if not pieces:
        return [0] * fingerprint.M
    pairs = [hash_of(b, hash_of(a)) for a, b in zip(pieces, pieces[1:], strict=False)] or [hash_of(pieces[0])]
    seen, numbered = Counter(), []
    for place, pair in enumerate(map(high, pairs)):
        # an occurrence number is a Spark int, hashed as such
        numbered.append((signed(high(xxhash.xxh64_intdigest(struct.pack("<I", seen[pair]), hash_of(pair)))), place))
        seen[pair] += 1
    numbered.sort()
    out = []
    for b in range(fingerprint.M):
        mark = (b << 58) - (1 << 63)
        at = next((k for k, x in enumerate(numbered) if x[0] >= mark), 0)
        chosen = [numbered[(at + k) % len(numbered)] for k in range(fingerprint.L)]
        chosen.sort(key=lambda x: x[1])
        one, two = (x[0] & ((1 << 64) - 1) for x in chosen)
        out.append(hash_of(two, hash_of(one)) & 0x7FFFFFFF)
    return out


def plain_report(rows):
    """(doc_id, text) rows, equal ids by the order of the texts' hashes, so here only rows whose neighbours are plain."""
    ordered = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = []
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        marks = [plain_mark(x) for x in (text, edited, following)]
        like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / fingerprint.M
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *("".join(f"{x:08x}" for x in m) for m in marks[:2]), like(marks[0], marks[1]), like(marks[0], marks[2])))
    return Counter(out)


def test_fingerprints(spark, edge, none):
    rows = {}
    for r in edge.select("doc_id", "text").collect():
        rows.setdefault(r["doc_id"], r["text"] or "")
    single = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert Counter(map(tuple, fingerprint.fingerprint_report(single).collect())) == plain_report(list(rows.items()))
    assert fingerprint.fingerprint_report(edge).count() == edge.count()
    assert fingerprint.fingerprint_report(none).count() == 0


@pytest.mark.parametrize("ids", [[2**60 - 1, 5, 0, None], [-(2**62), 2**62, 2**63 - 1, -(2**63), 0], [7]])
def test_fingerprints_of_far_ids(spark, ids):
    rows = [(i, f"the text of {k} " * (3 + k)) for k, i in enumerate(ids)]
    got = fingerprint.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == plain_report(rows)


def test_fingerprints_of_repeats(spark):
    """All but the last of equal rows are followed by their own text; several null ids go by the texts' hashes."""
    rows, chunk = [(9, "one two three four five six")] * 7 + [(4, "other words are in here")] + [(None, f"null {k} id text") for k in range(5)], fingerprint.CHUNK
    fingerprint.CHUNK = 3
    try:
        got = fingerprint.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        fingerprint.CHUNK = chunk
    assert len(got) == len(rows)
    next_text, own = [tuple(r) for r in got if r["doc_id"] == 9], dict(rows)[9]
    want = plain_report([(9, own), (4, dict(rows)[4])])
    last = next(x for x in want if x[0] == 9)
    edited = own[: len(own) - len(own) // 3] + own[: len(own) // 3]
    assert Counter(next_text)[last] == 1 and sum(r[2] == hashlib.sha256(edited.encode()).hexdigest() and r[6] == 1.0 for r in next_text) == 6
    nulls = [r for r in got if r["doc_id"] is None]
    texts = [t for i, t in rows if i is None]
    edits = {a: {hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest() for b in [*texts, own] if b != a} for a in texts}
    assert all(any(r["edited_sha256"] in e for e in edits.values()) for r in nulls)


def test_ranges_are_even(spark):
    """Clustered ids do not meet in one range."""
    rows = spark.createDataFrame([(i,) for i in range(20_000)] + [(2**50,)], "id long")
    scratch = Scratch(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it joins small ranges
    chained = successor.with_next(rows, [F.col("id").desc()], ["id"], scratch)
    assert {(r["id"], r["next"]["id"]) for r in chained.collect()} == {(i, i - 1) for i in range(1, 20_000)} | {(2**50, 19_999), (0, 2**50)}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(f"{scratch.root}/ranged").groupBy("_range").count().collect()]
    assert max(sizes) <= 2 * 20_001 / 4


def test_fingerprint_sees_order_and_counts(spark):
    """Moves and repeats lower the likeness."""
    base = " ".join(f"t{i}" for i in range(60))
    swapped = " ".join(f"t{i}" for i in [*range(30, 60), *range(30)])
    df = fingerprint.with_fingerprint(spark.createDataFrame([(base, swapped, base + " " + base)], "a string, b string, c string"), "a", "fa")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "b", "fb"), "c", "fc")
    same, moved, doubled = df.select(fingerprint.likeness("fa", "fa"), fingerprint.likeness("fa", "fb"), fingerprint.likeness("fa", "fc")).first()
    assert same == 1.0 and 0.2 < moved < 0.8 and doubled < 0.5
