"""MinHash near-duplicates with odd sketches.

Texts become sets of hashed shingles, of two words in op9_neardup and of five
in the pipeline. Equal sets are one class, whose smallest id represents it. MinHash samples of a class are grouped into bands;
classes that share a band are candidates. The same samples are folded into a
parity bitmap (odd sketch): the number of bits in which two bitmaps differ
estimates how many samples differ, and with it the similarity, most precisely
where that is high. Candidates that pass the estimate with a wide margin are
confirmed on their full sets.

A band's members are not paired with each other. First each is held against
the band's smallest id, and links make components. Bands that still hold
several components tie their members into families. Of a family, the members
outside its largest component are the queries, held against all its members of
a size that a link allows, in blocks of so many shingles a side (``BLOCK``); a
block counts intersections over its inverted sets and returns one link for a
query and component. So every pair of one band is tested unless both sides are
linked already. This work grows with queries times members of a family: what
is not linked has to be compared.

With 32 bands of 5 samples a pair at similarity 0.8 shares no band with
probability 3e-6, one at 0.9 with 1e-12. The sketch decides alone where a band
has two members; at ``LEAST_ESTIMATE`` it lost none of 300,000 simulated pairs
at similarity 0.8 (at 0.64, six).

Defined results: empty sets link with nothing; a null id links with nothing,
has no component and is kept; rows with one id are one node, whatever their
texts; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.llm.components import components
from voicelake.llm.hashing import mix, word_hashes
from voicelake.llm.scratch import Scratch, hot_keys, look_up, matching

BANDS, ROWS, BITS = 32, 5, 512
SAMPLES = BANDS * ROWS
#: Shingles a side of a block, at least and at most; between, blocks are a few for each shuffle partition.
BLOCK = (10_000, 2_000_000)
#: Parts that the partners of one head are dealt to.
PARTS = 32
#: Estimated similarity that a candidate must reach: seven standard deviations below 0.8.
LEAST_ESTIMATE = 0.55
#: Sets that are linked differ by at most one class of this ratio, a little over 1 / 0.8.
SIZE_RATIO = 1.26

_rng = np.random.RandomState(7)
_FACTORS = (_rng.randint(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[None, :]
_OFFSETS = _rng.randint(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[None, :]
_PLACE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_set(text: str, width: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words, a shorter text being one; A-Z are lower-cased, other letters stay."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    long = min(width, len(words))
    places = len(words) - long + 1
    found = words[:places]
    for k in range(1, long):
        found = mix(found * np.uint64(3) + mix(words[k : k + places]))
    return np.unique(found if long == width else mix(found ^ np.uint64(0x5851F42D4C957F2D)))


def samples(shingles: np.ndarray) -> np.ndarray:
    short, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    keys, parts = _BAND.copy(), least.astype(np.uint64).reshape(BANDS, ROWS)
    for k in range(ROWS):
        keys = mix(keys + parts[:, k])
    return keys.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """A bitmap of BITS bits, as longs; a bit is the parity of the samples that fall on it."""
    fallen = np.bincount((mix(_PLACE | least.astype(np.uint64)) % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((fallen & 1).astype(np.uint8)).view(np.int64)


def most_bits(similarity: float) -> int:
    """Differing bits expected at a similarity: two sample sets differ in 2 * SAMPLES * (1 - similarity) members."""
    return round(BITS / 2 * (1 - exp(-4 * SAMPLES * (1 - similarity) / BITS)))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, prints, keys, maps = batch.column(0), [], [], [], []
        for text in batch.column(1):
            found = shingle_set(text.as_py() or "", width)
            sizes.append(len(found))
            if len(found):
                least = samples(found)
                prints.append(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64))
                keys.append(bands(least))
                maps.append(odd_sketch(least))
            else:
                prints.append((None, None))
                keys.append(None)
                maps.append(None)
        columns = [ids, pa.array(sizes, pa.int64()), pa.array([None if p[0] is None else int(p[0]) for p in prints], pa.int64()), pa.array([None if p[1] is None else int(p[1]) for p in prints], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))], schema=_SIGNED)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(text.as_py() or "", width).view(np.int64) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "members"])


def _held_to_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (one, part, role): a head's sets, then those of its partners; gives the pairs whose sets are linked."""
    at, heads = None, []
    for batch in batches:
        one, two = [], []
        for head, part, role, node, members in zip(*(batch.column(c) for c in ("one", "part", "role", "id", "members")), strict=True):
            key, own = (head.as_py(), part.as_py()), members.values.to_numpy()
            if key != at:
                at, heads = key, []
            if role.as_py() == 0:
                heads.append(own)
                continue
            for other in heads:
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared >= 80 * (len(own) + len(other) - shared):
                    one.append(key[0])
                    two.append(node.as_py())
                    break
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["one", "two"])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, name: str, width: int) -> DataFrame:
    """The candidate pairs (one, two) of class ids that are links."""
    sides = [classes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "sketch")]) for side in ("one", "two")]
    paired = pairs.join(sides[0], F.col("one") == F.col("one_id")).join(sides[1], F.col("two") == F.col("two_id"))
    small, large = F.least("one_n", "two_n"), F.greatest("one_n", "two_n")
    likely = paired.filter((100 * small >= 80 * large) & (_differing("one_sketch", "two_sketch") <= most_bits(LEAST_ESTIMATE))).select("one", "two")
    likely = scratch.table(likely.distinct(), f"likely-{name}")
    ids = scratch.table(likely.select(F.explode(F.array("one", "two")).alias("id")).distinct(), f"ids-{name}")
    texts = matching(_narrow(docs).withColumnRenamed("doc_id", "id"), ids, "id", scratch).select("id", "text")
    sets = scratch.table(texts.mapInArrow(lambda batches: _sets(batches, width), "id long, members array<bigint>"), f"sets-{name}")
    # a head's sets go once to each part that its partners are dealt to
    dealt = likely.withColumn("part", F.pmod(F.xxhash64("two"), F.lit(PARTS)))
    rows = dealt.select("one", "part").distinct().select("one", "part", F.lit(0).alias("role"), F.col("one").alias("id")).unionByName(dealt.select("one", "part", F.lit(1).alias("role"), F.col("two").alias("id")))
    laid = rows.join(sets, "id").repartition("one", "part").sortWithinPartitions("one", "part", "role")
    return scratch.table(laid.mapInArrow(_held_to_heads, "one long, two long").distinct(), f"links-{name}")


def _differing(a: str, b: str) -> Column:
    bits = F.lit(0)
    for k in range(BITS // 64):
        bits = bits + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return bits


def _held_against(table: pa.Table) -> pa.Table:
    """Links between the queries and the members of one block: one a query and component of members."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    sets = [x.values.to_numpy() for x in table.column("members")]
    members = np.flatnonzero(~asks)
    sizes = np.array([len(sets[k]) for k in members], np.int64)
    values, owners = np.concatenate([sets[k] for k in members] or [np.zeros(0, np.int64)]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    one, two = [], []
    for q in np.flatnonzero(asks):
        low, high = np.searchsorted(values, sets[q], "left"), np.searchsorted(values, sets[q], "right")
        length = high - low
        at = np.arange(length.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        shared = np.bincount(owners[at], minlength=len(members))
        linked = members[(100 * shared >= 80 * (len(sets[q]) + sizes - shared)) & (labels[members] != labels[q])]
        for k in linked[np.unique(labels[linked], return_index=True)[1]]:
            one.append(ids[q])
            two.append(ids[k])
    return pa.table({"one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64())})


def _between_components(shared: DataFrame, found: DataFrame, docs: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """Links between different components inside a band, found family by family."""
    labelled = shared.join(found, F.col("id") == F.col("node"), "left").select("key", "head", "id", "n", F.coalesce("component", "id").alias("label"))
    labelled = scratch.table(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high AND n > 2").select("key")
    open_bands = scratch.table(labelled.join(scratch.table(mixed, "mixed"), "key"), "open")
    ties = open_bands.filter("id <> head").select(F.col("head").alias("one"), F.col("id").alias("two")).distinct()
    family = components(ties, scratch, "families").withColumnRenamed("component", "family")
    sized = F.floor(F.log("n") / F.log(F.lit(SIZE_RATIO))).cast("int")
    nodes = scratch.table(open_bands.select("id", "label", "n").distinct().join(family, F.col("id") == F.col("node")).select("id", "label", "n", "family", sized.alias("class")), "nodes")
    counted = nodes.groupBy("family", "label").agg(F.count(F.lit(1)).alias("k"))
    mains = scratch.table(counted.groupBy("family").agg(F.max(F.struct("k", "label"))["label"].alias("main")), "mains")
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    queries = nodes.join(mains, "family").filter("label <> main").withColumn("class", near)
    spread_over = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = min(max((nodes.agg(F.sum("n")).first()[0] or 0) // spread_over, BLOCK[0]), BLOCK[1])
    cut = lambda df, name: df.groupBy("family", "class").agg(F.ceil(F.sum("n") / block).cast("int").alias(name))
    grid = scratch.table(cut(nodes, "columns").join(cut(queries, "rows"), ["family", "class"]), "grid")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = nodes.join(grid, ["family", "class"]).withColumn("row", all_of(F.col("rows"))).withColumn("column", spread(F.col("columns"), 1)).withColumn("asks", F.lit(False))
    queries = queries.join(grid, ["family", "class"]).withColumn("column", all_of(F.col("columns"))).withColumn("row", spread(F.col("rows"), 2)).withColumn("asks", F.lit(True))
    where = ["family", "class", "row", "column"]
    dealt = members.select(*where, "asks", "id", "label").unionByName(queries.select(*where, "asks", "id", "label"))
    sets = matching(_narrow(docs).withColumnRenamed("doc_id", "id"), nodes.select("id"), "id", scratch).select("id", "text").mapInArrow(lambda batches: _sets(batches, width), "id long, members array<bigint>")
    full = dealt.join(scratch.table(sets, "family-sets"), "id").select(*where, "asks", "id", "label", "members")
    return scratch.table(full.groupBy(*where).applyInArrow(_held_against, "one long, two long"), "links-second")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    signed = scratch.table(_narrow(docs).mapInArrow(lambda batches: _sign(batches, width), "doc_id long, n_shingles long, f1 long, f2 long, bands array<bigint>, sketch array<bigint>"), "signed")
    some = signed.filter("doc_id IS NOT NULL AND f1 IS NOT NULL")
    owners = scratch.table(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "owners")
    copied, owners = hot_keys(owners, "copies", signed.count()).select("f1", "f2"), owners.drop("copies")
    own = some.join(owners.withColumnRenamed("id", "doc_id"), ["f1", "f2", "doc_id"], "left_semi")
    classes = scratch.table(own.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", "bands"), "classes")

    members = classes.select("id", "n", F.explode("bands").alias("key"))
    heads = members.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count(F.lit(1)).alias("k")).filter("head < last")
    heads = scratch.table(heads.select("key", "head", "k"), "heads")
    crowded = hot_keys(heads, "k", BANDS * classes.count())
    shared = scratch.table(look_up(members, heads.drop("k"), ["key"], crowded).filter("head IS NOT NULL").select("key", "id", "n", "head"), "shared")
    first = shared.filter("id <> head").select(F.col("head").alias("one"), F.col("id").alias("two")).distinct()
    links = _confirmed(first, docs, classes, scratch, "first", width)
    # an id with several texts ties their classes
    of_id = F.struct("f1", "f2")
    several = some.groupBy("doc_id").agg(F.min(of_id).alias("low"), F.max(of_id).alias("high")).filter("low <> high").select("doc_id")
    ties = some.select("doc_id", "f1", "f2").join(scratch.table(several, "several"), "doc_id").join(owners, ["f1", "f2"]).select(F.col("doc_id").alias("one"), F.col("id").alias("two"))
    links = scratch.table(links.unionByName(ties.filter("one <> two")), "all-links")
    found = components(links, scratch, "first")

    more = _between_components(shared, found, docs, scratch, width)
    if not more.isEmpty():
        found = components(links.unionByName(more), scratch, "all")

    labels = scratch.table(owners.join(found, F.col("id") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "id").alias("component")), "labels")
    rows = signed.filter("f1 IS NOT NULL").select("doc_id", "n_shingles", "f1", "f2")
    of_class = look_up(rows, labels, ["f1", "f2"], copied).select("doc_id", "n_shingles", "component")
    # kept out of the join, where they were one key; an id with another text has that text's component
    empty = signed.filter("f1 IS NULL").select("doc_id", "n_shingles")
    elsewhere = of_class.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("component"))
    empty = empty.join(elsewhere, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return of_class.unionByName(empty).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """The documents that are kept, one of each component, with their own columns."""
    scratch = Scratch(docs.sparkSession, "neardup")
    verdicts = scratch.table(near_duplicates(docs, scratch, width).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    scratch.drop_all(keep="gone")
    return docs.join(verdicts, docs["doc_id"] == verdicts["_gone"], "left_anti")


def op9_neardup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
