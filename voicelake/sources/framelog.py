"""Captured message-frame logs: validation and splitting."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voicelake.sources.files import located

#: Layout of the 16-byte prefix (magic, version, flags, header length, payload length) and its limits.
MAGIC, VERSION, MAX_HEADER, MAX_PAYLOAD = b"OSBP", 1, 64 * 1024, 4 * 1024 * 1024
PREFIX, PREFIX_BYTES = "<4sHHII", 16
SCHEMA = "path string, offset long, flags int, header string, payload_len long, reject_reason string"


def reject_reason(magic: bytes, version: int, header: int, payload: int, max_header: int, max_payload: int) -> str | None:
    """The first rule that a prefix breaks."""
    rules = ((magic != MAGIC, "magic"), (version != VERSION, "version"), (header > max_header, "header"), (payload > max_payload, "payload"), (payload % 4 != 0, "alignment"))
    return next((name for broken, name in rules if broken), None)


def frames(file, size: int, max_header: int, max_payload: int) -> Iterator[tuple]:
    """(offset, flags, header, payload length, reason) of each frame of an open file; payloads are passed over, not read."""
    at = 0
    while at < size:
        file.seek(at)
        prefix = file.read(PREFIX_BYTES)
        if len(prefix) < PREFIX_BYTES:
            yield at, 0, None, 0, "truncated"
            return
        magic, version, flags, header, payload = struct.unpack(PREFIX, prefix)
        why = reject_reason(magic, version, header, payload, max_header, max_payload)
        if why is None and at + PREFIX_BYTES + header + payload > size:
            why = "truncated"
        yield at, flags, None if why else file.read(header).decode("utf-8", "replace"), payload, why
        if why:
            return
        at += PREFIX_BYTES + header + payload


def read_frame_log(spark: SparkSession, path: str, max_header: int = MAX_HEADER, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """One row a frame; a rejected prefix ends its file, since what follows cannot be located.

    A frame's place follows from the one before, so a file is one task's; of it only prefixes and headers are read, by
    seeking, whatever its size.
    """
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, place = located(name)
                with system.open_input_file(place) as file:
                    rows = []
                    for frame in frames(file, file.size(), max_header, max_payload):
                        rows.append((name, *frame))
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # names alone, no contents
    return files.repartition("path").select("path").mapInArrow(split, SCHEMA)
