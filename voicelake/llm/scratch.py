"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voicelake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Writes named tables below a fresh folder of the shared one and reads them back.

    A table written here survives the loss of any executor. ``drop`` removes
    one that no later plan reads.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop_all(self, keep: str) -> None:
        for name in self.names - {keep}:
            self.drop(name)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that are broadcast at most, some 50 MB in memory; beyond that both sides are exchanged.
BROADCAST_KEYS = 1_000_000


def matching(wide: DataFrame, few: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``wide`` joined to ``few`` on a key, moving only the wide rows that have a partner where those keys are few.

    The count decides: up to BROADCAST_KEYS keys are broadcast to drop the
    other rows before the exchange; more take part in the plain join alone.
    """
    keys = few.select(F.col(key).alias("_key")).distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        wide = wide.join(F.broadcast(keys), F.col(key) == F.col("_key"), "left_semi")
    return wide.join(few, key)


#: Keys with more than one in so many rows are hot; fewer than that many keys can be.
HOT_PARTS, HOT_LEAST = 100_000, 1000


def hot_keys(counts: DataFrame, n: str, rows: int) -> DataFrame:
    """The keys of ``counts`` with so many of ``rows`` rows that under HOT_PARTS keys can have as many."""
    return counts.filter(F.col(n) > max(HOT_LEAST, rows // HOT_PARTS))


def look_up(many: DataFrame, few: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """``many`` with the columns of ``few`` (a row a key) or nulls; hot keys are answered by broadcast, so that none meets in one task."""
    keys = [c for c in few.columns if c not in on]
    answered = few.join(F.broadcast(hot.select(*on)), on, "left_semi").select(*on, F.struct(*keys).alias("_found"))
    marked = many.join(F.broadcast(answered), on, "left")
    rest = marked.filter("_found IS NULL").drop("_found").join(few, on, "left")
    return rest.unionByName(marked.filter("_found IS NOT NULL").select(*many.columns, "_found.*").select(*rest.columns))
