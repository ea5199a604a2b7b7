"""Byte-balanced shards by histogram sort.

Rows are ordered by a hash of their text, then by a hash of id and text, so
equal texts lie together, then by a hash of their place, which tells rows equal
in id and text apart. The splitters are found before any row moves: each
round counts the exact bytes below evenly spaced candidate boundaries over all
partitions, keeps the cell around each target, and probes inside it 4096 times
finer, until the cell is a single text. The rows are then exchanged once.

Law ``bytes``: a splitter never cuts through a group of equal texts, unless
the group holds more than ``group_share`` of a shard; such a group is cut at
the row nearest to the target. So shard sizes differ by at most that share of
a shard and one document.

Defined results: a null text has no bytes, size 1, CRC 0, and is grouped with
empty texts; rows equal in id and text get slots of their own and are cut like
other rows where they hold too much; null ids are hashed as empty; an empty
table gives an empty result; a written column named ``shard`` is kept as
``shard_of_input``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.llm.scratch import Scratch
from voicelake.llm.text import all_columns, whole

DIGIT, BITS = 12, 60
ROWS_PER_CELL = 500_000


def keys(doc_id: Column, text: Column) -> dict[str, Column]:
    """The three parts of a row's key, BITS bits each."""
    hashes = {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), doc_id, text), "k3": F.xxhash64(F.monotonically_increasing_id())}
    return {name: F.shiftrightunsigned(value, 64 - BITS) for name, value in hashes.items()}


def keyed(docs: DataFrame) -> DataFrame:
    text = whole(F.col("text"))
    made = [value.alias(name) for name, value in keys(F.col("doc_id"), text).items()]
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *made)


def _cells(rows: DataFrame, key: str, left: int, within: list[int]) -> dict[int, list[tuple]]:
    """Cells of the next digit inside the prefixes ``within``: at most len(within) * 4096 small rows."""
    if left + DIGIT < BITS:
        rows = rows.filter(F.shiftright(key, left + DIGIT).isin(within))
    got = rows.groupBy(F.shiftright(key, left).alias("cell")).agg(F.sum("size").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
    by: dict[int, list[tuple]] = {}
    for r in sorted(got):
        by.setdefault(r["cell"] >> DIGIT, []).append(tuple(r))
    return by


def _locate(rows: DataFrame, key: str, asked: dict[int, float], below: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For each target (bytes below it), the key whose rows hold it: (key, bytes below the key, bytes of the key).

    asked and below have an entry a splitter; a round reads only the cells that hold targets.
    """
    found: dict[int, tuple[int, int, int]] = {}
    state = {j: (0, below[j]) for j in asked}
    for left in range(BITS - DIGIT, -1, -DIGIT):
        if not state:
            break
        cells = _cells(rows, key, left, sorted({p for p, _ in state.values()}))
        following = {}
        for j, (prefix, under) in state.items():
            chosen = None
            for cell, size, low, high in cells.get(prefix, []):
                chosen = (cell, under, size, low, high)
                if under + size > asked[j]:
                    break
                under += size
            if chosen is None:
                continue
            cell, under, size, low, high = chosen
            if low == high:
                found[j] = (low, under, size)
            else:
                following[j] = (cell, under)
        state = following
    return found


def splitters(rows: DataFrame, n_shards: int, group_share: float) -> list[tuple[int, int, int]]:
    """The n_shards - 1 first keys (k1, k2, k3) of the shards after the first, ascending."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    targets = {j: total * j / n_shards for j in range(1, n_shards)}
    cuts: dict[int, tuple[int, int, int]] = {}

    def cut(own: DataFrame, level: int, asked: dict[int, float], below: dict[int, int], prefix: tuple[int, ...]) -> None:
        heavy: dict[int, list[int]] = {}
        found = _locate(own, f"k{level}", asked, below)
        for j, (key, under, size) in found.items():
            if level < 3 and size > group_share * total / n_shards:
                heavy.setdefault(key, []).append(j)
            else:
                nearest = key if targets[j] - under <= under + size - targets[j] else key + 1
                cuts[j] = (*prefix, nearest, *(-1,) * (3 - level))
        for key, inside in heavy.items():  # at most n_shards / group_share groups are so large
            cut(own.filter(F.col(f"k{level}") == key), level + 1, {j: asked[j] for j in inside}, {j: found[j][1] for j in inside}, (*prefix, key))

    cut(rows, 1, targets, dict.fromkeys(targets, 0), ())
    return [cuts[j] for j in sorted(cuts)]


def shard_column(cuts: list[tuple[int, int, int]], keys: dict[str, Column] | None = None) -> Column:
    """The number of splitters at or below the row's key."""
    k1, k2, k3 = (keys or {k: F.col(k) for k in ("k1", "k2", "k3")}).values()
    shard = F.lit(0)
    for a, b, c in cuts:
        shard = shard + ((k1 > a) | ((k1 == a) & ((k2 > b) | ((k2 == b) & (k3 >= c))))).cast("int")
    return shard.cast("int")


def _cell_bits(n_rows: int, n_shards: int) -> int:
    return max(5, (n_rows // (n_shards * ROWS_PER_CELL)).bit_length())


def _with_cells(placed: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """``placed`` with the cell of each row: a range of k2, and for a k2 of too many rows ranges of its k3.

    At most one such k2 for ROWS_PER_CELL rows exists; mostly there is none, which the cells' counts tell.
    """
    placed = placed.withColumn("cell", F.shiftright("k2", BITS - bits).cast("int"))
    crowded = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * ROWS_PER_CELL).select("cell")
    crowded = [r["cell"] for r in crowded.collect()]  # at most 2 ** bits
    counts = placed.filter(F.col("cell").isin(crowded)).groupBy("k2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS_PER_CELL)
    hot = scratch.table(counts, "hot") if crowded else None
    most = hot.agg(F.max("n")).first()[0] if hot is not None else None
    if most is None:
        return placed.withColumns({"own": F.lit(-1).cast("long"), "part": F.lit(0)})
    parts = (most // ROWS_PER_CELL).bit_length()
    found = placed.join(F.broadcast(hot.select(F.col("k2").alias("own"))), F.col("k2") == F.col("own"), "left")
    return found.withColumns({"own": F.coalesce("own", F.lit(-1).cast("long")), "part": F.when(F.col("own").isNotNull(), F.shiftright("k3", BITS - parts).cast("int")).otherwise(0)})


def shard_report(docs: DataFrame, n_shards: int = 16, group_share: float = 0.1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots follow the second hash, a random order inside the shard. A shard is
    numbered in cells of that hash, so no task holds a whole shard; the cells'
    starts come from their counts.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.table(keyed(docs), "keyed")
    placed = rows.withColumn("shard", shard_column(splitters(rows, n_shards, group_share)))
    placed, cell = _with_cells(placed, _cell_bits(rows.count(), n_shards), scratch), ["cell", "own", "part"]
    counts = placed.groupBy("shard", *cell).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.table(counts.select("shard", *cell, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start")), "starts")
    inside = Window.partitionBy("shard", *cell).orderBy("k2", "k1", "doc_id", "k3")
    joined = placed.join(starts, ["shard", *cell])
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, group_share: float = 0.1) -> None:
    """Writes whole documents below ``path``/shard=N, one exchange by shard and ranges of the second and third hash."""
    rows = Scratch(docs.sparkSession, "sharding").table(keyed(docs), "keyed")
    bits = _cell_bits(rows.count(), n_shards)
    cuts = splitters(rows, n_shards, group_share)
    docs = docs.withColumnRenamed("shard", "shard_of_input")
    packed = docs.select(F.struct(*all_columns(docs)).alias("_row"), F.struct(*[v.alias(k) for k, v in keys(F.col("doc_id"), whole(F.col("text"))).items()]).alias("_key"))
    placed = packed.withColumn("shard", shard_column(cuts, {k: F.col(f"_key.{k}") for k in ("k1", "k2", "k3")}))
    dealt = placed.repartition("shard", F.shiftright("_key.k2", BITS - bits), F.shiftright("_key.k3", BITS - 3)).sortWithinPartitions("shard", "_key.k2")
    dealt.select("_row.*", "shard").write.partitionBy("shard").parquet(path)


def op5_shards(spark, sf_dir):
    return shard_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
