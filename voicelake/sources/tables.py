"""Readers and writers of record files; each is what Spark has built in, with this library's rules on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The columns of a public speech dataset.
SPEECH_COLUMNS = ("id", "num_samples", "audio", "transcription", "raw_transcription", "gender")
SENSITIVE = ("audio", "samples", "text", "output_text", "transcription", "raw_transcription")


def read_bench_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSONL with differing keys; blank lines are skipped and the columns are the union of the keys."""
    return spark.read.json(paths)


def write_bench_csv(df: DataFrame, path: str) -> None:
    """CSV with sorted columns; missing values are empty."""
    df.select(*sorted(df.columns)).write.option("header", True).csv(path)


def read_speech_parquet(spark: SparkSession, path: str, audio: bool = False) -> DataFrame:
    """The six speech columns; the audio is read only where it is asked for."""
    return spark.read.parquet(path).select(*[c for c in SPEECH_COLUMNS if audio or c != "audio"])


def manifest(samples: DataFrame, dataset: str, order: str = "sample_id") -> DataFrame:
    """One JSON document: the dataset's name and its ordered samples, durations rounded to six places. For selected corpora (tens of rows)."""
    rounded = samples.withColumn("duration_s", F.round("duration_s", 6))
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in rounded.columns if c != order])))
    return rounded.agg(F.to_json(F.struct(F.lit(dataset).alias("dataset"), rows.alias("samples"))).alias("value"))


def write_manifest(samples: DataFrame, dataset: str, path: str) -> None:
    manifest(samples, dataset).write.text(path)


def write_metrics_jsonl(df: DataFrame, path: str) -> None:
    """Metric events without audio or text."""
    df.drop(*SENSITIVE).write.json(path)


def read_chunk_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 8) -> DataFrame:
    """Live chunks as a stream of files; a broker source takes the same place in production."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Appends rows as they come; a failed utterance is a row with its error, so it never stops the stream."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
