"""RIFF/WAVE corpora in and out, by ranges of frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voicelake.sources.files import located, write_files

CHUNKS = "path string, chunk_id long, start_frame long, rate int, channels int, samples array<float>, error string"
#: Sizes in a RIFF header end here; longer files are RF64, whose ds64 chunk has the sizes.
MOST_RIFF = 0xFFFFFFFF


@dataclass(frozen=True)
class WavHeader:
    kind: int
    bits: int
    rate: int
    channels: int
    at: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.bits // 8 * self.channels


def read_header(file, size: int) -> WavHeader:
    """The header of an open file of ``size`` bytes, of whose data nothing is read; ValueError names what is wrong."""
    file.seek(0)
    head = file.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    spec, body, at, long_size = None, None, 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"data" and length == MOST_RIFF and long_size is not None:
            length = long_size
        if at + 8 + length > size:
            raise ValueError("truncated chunk")
        if name == b"ds64":
            if length < 24:
                raise ValueError("short ds64 chunk")
            long_size = struct.unpack("<8xQ", file.read(16))[0]
        elif name == b"fmt ":
            if length < 16:
                raise ValueError("short fmt chunk")
            part = file.read(min(length, 40))
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", part)
            if kind == 0xFFFE and length >= 26:
                kind = struct.unpack_from("<H", part, 24)[0]
            spec = (kind, bits, rate, channels)
        elif name == b"data":
            body = (at + 8, length)
        at += 8 + length + (length & 1)
    if spec is None or body is None:
        raise ValueError("no fmt or data chunk")
    kind, bits, rate, channels = spec
    if channels not in (1, 2):
        raise ValueError(f"{channels} channels")
    if (kind, bits) not in ((1, 16), (1, 24), (1, 32), (3, 32)):
        raise ValueError(f"format {kind} with {bits} bits")
    return WavHeader(kind, bits, rate, channels, body[0], body[1] // (bits // 8 * channels))


def decode(header: WavHeader, data: bytes) -> np.ndarray:
    """Interleaved samples in [-1, 1] of whole frames."""
    if header.kind == 3:
        return np.frombuffer(data, "<f4")
    if header.bits == 16:
        return (np.frombuffer(data, "<i2") / 32768.0).astype(np.float32)
    if header.bits == 32:
        return (np.frombuffer(data, "<i4") / 2147483648.0).astype(np.float32)
    three = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
    whole = three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16
    return ((whole - ((whole & 0x800000) << 1)) / 8388608.0).astype(np.float32)


@dataclass
class _Range(InputPartition):
    """Whole files, or a range of the frames of one."""

    files: list
    first: int = 0
    last: int | None = None


def _ranges(files: list[tuple[str, int]], range_bytes: int) -> Iterator[_Range]:
    """Small files together, large ones cut; a range is turned into frames by its task, which reads the header."""
    held, size = [], 0
    for name, length in files:
        if length > range_bytes:
            for first in range(0, length, range_bytes):
                yield _Range([name], first, first + range_bytes)
            continue
        if held and size + length > range_bytes:
            yield _Range(held)
            held, size = [], 0
        held, size = [*held, name], size + length
    if held:
        yield _Range(held)


def wav_chunks(system: fs.FileSystem, name: str, first: int, last: int | None, chunk_frames: int) -> Iterator[tuple]:
    """The chunks whose first byte lies in [first, last) of the file; a bad file gives one row with its error, in its first range."""
    with system.open_input_file(name) as file:
        try:
            header = read_header(file, file.size())
        except (ValueError, struct.error) as wrong:
            if first == 0:
                yield name, 0, 0, 0, 0, None, str(wrong)
            return
        step = chunk_frames * header.frame_bytes
        low = 0 if first == 0 else max(0, -(-(first - header.at) // step))
        total = max(1, -(-header.frames // chunk_frames))
        high = total if last is None else min(total, max(0, -(-(last - header.at) // step)))
        for k in range(low, high):
            file.seek(header.at + k * step)
            frames = max(0, min(chunk_frames, header.frames - k * chunk_frames))
            data = file.read(frames * header.frame_bytes)
            yield name, k, k * chunk_frames, header.rate, header.channels, decode(header, data), None


_ARROW = pa.schema([("path", pa.string()), ("chunk_id", pa.int64()), ("start_frame", pa.int64()), ("rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(_ARROW)], schema=_ARROW)


class WavSource(DataSource):
    """Options: path, chunk_frames, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "wav_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return _WavReader(self.options["path"], int(self.options["chunk_frames"]), int(self.options["range_bytes"]))


class _WavReader(DataSourceReader):
    def __init__(self, path: str, chunk_frames: int, range_bytes: int):
        self.path, self.chunk_frames, self.range_bytes = path, chunk_frames, range_bytes

    def partitions(self) -> list[_Range]:
        """The driver lists files and sizes, and reads none."""
        system, root = located(self.path)
        info = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        files = sorted((x.path, x.size) for x in info if x.type == fs.FileType.File and x.base_name.lower().endswith(".wav"))
        return list(_ranges(files, self.range_bytes)) or [_Range([])]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, held, size = located(self.path)[0], [], 0
        for name in partition.files:
            for row in wav_chunks(system, name, partition.first, partition.last, self.chunk_frames):
                held.append(row)
                size += 0 if row[5] is None else row[5].nbytes
                if size > 16 << 20:
                    yield _as_batch(held)
                    held, size = [], 0
        if held:
            yield _as_batch(held)


def read_audio_corpus(spark: SparkSession, path: str, chunk_frames: int = 16000, range_bytes: int = 128 << 20) -> DataFrame:
    """PCM chunks of every .wav below a folder (or of one file); a bad file gives one row with its error.

    A file is read by as many tasks as it has ranges of ``range_bytes``, each of which parses the header and seeks to its
    frames, so a file may be of any size. ``path`` may be on any file system that pyarrow opens by its URI.
    """
    spark.dataSource.register(WavSource)
    return spark.read.format("wav_chunks").option("path", path).option("chunk_frames", chunk_frames).option("range_bytes", range_bytes).load()


def pcm16(samples: np.ndarray) -> bytes:
    """Clamps to [-1, 1], times 32767, halves away from zero."""
    scaled = np.clip(np.asarray(samples, np.float64), -1, 1) * 32767
    return (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype("<i2").tobytes()


def wav_header(frames: int, rate: int, channels: int) -> bytes:
    """A PCM16 header for so many frames; from 4 GB on that of RF64."""
    size = frames * channels * 2
    spec = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16)
    if 36 + size <= MOST_RIFF:
        return struct.pack("<4sI4s", b"RIFF", 36 + size, b"WAVE") + spec + struct.pack("<4sI", b"data", size)
    sizes = struct.pack("<4sIQQQI", b"ds64", 28, 72 + size, size, frames, 0)
    return struct.pack("<4sI4s", b"RF64", MOST_RIFF, b"WAVE") + sizes + spec + struct.pack("<4sI", b"data", MOST_RIFF)


def write_audio_corpus(chunks: DataFrame, key: str, path: str) -> None:
    """(key, start_frame, rate, channels, samples) -> one PCM16 file a recording, below ``path``/part-N, named by its key.

    Recordings are dealt to tasks and sorted by frame, and stream through: a task holds a batch of chunks, whatever a
    recording's length. The header's length comes from a sum before. Chunks of one recording that leave gaps are put side
    by side. Letters of a key that names cannot hold are written as %XX.
    """
    named = chunks.select(F.col(key).cast("string").alias("k"), "start_frame", "rate", "channels", "samples").filter("k IS NOT NULL")
    totals = named.groupBy("k").agg((F.sum(F.size("samples").cast("long")) / F.max("channels")).cast("long").alias("frames"))
    dealt = named.join(totals, "k").repartition("k").sortWithinPartitions("k", "start_frame")
    write_files(dealt.select("k", "rate", "channels", "frames", "samples"), path, _write_recordings)


def _write_recordings(batches: Iterator[pa.RecordBatch], create) -> None:
    from urllib.parse import quote

    current, file = None, None
    for batch in batches:
        for k, rate, channels, frames, samples in zip(*(batch.column(c) for c in ("k", "rate", "channels", "frames", "samples")), strict=True):
            if k.as_py() != current:
                if file:
                    file.close()
                current, file = k.as_py(), create(quote(k.as_py(), safe=" ") + ".wav")
                file.write(wav_header(frames.as_py(), rate.as_py(), channels.as_py()))
            if samples.is_valid:
                file.write(pcm16(samples.values.to_numpy(zero_copy_only=False)))
    if file:
        file.close()


def concat_with_gap(clips: DataFrame, key: str, order: str, gap: int) -> DataFrame:
    """(key, order, samples) -> (key, start_sample, samples): the clips of a key one after the other, ``gap`` zeros after each."""
    after = Window.partitionBy(key).orderBy(order)
    whole = F.concat(F.coalesce("samples", F.array().cast("array<float>")), F.array_repeat(F.lit(0.0).cast("float"), gap))
    padded = clips.select(key, order, whole.alias("samples"))
    n = F.size("samples").cast("long")
    return padded.select(key, (F.sum(n).over(after) - n).alias("start_sample"), "samples")
