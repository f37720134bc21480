"""Readers and writer of recordings as DataFrames.

Files are listed by Spark, without their content. A file is read in parts of about SPLIT_BYTES: each task opens it, reads its header by seeking,
and then only the samples of its part. Stores that Arrow's file systems don't know are read through Spark's binary file source instead,
each file whole by one task (2 GB at most, Spark's limit). Rows are chunks of at most CHUNK samples of one channel; a recording without
samples has a chunk of none for each channel, and one without channels a row without a channel.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from myospark.functions.columns import FILE_TYPES
from myospark.session import ensure_workers
from myospark.sources import mat, otb, otb4, stores
from myospark.sources.recording import logger_of
from myospark.sources.stores import open_file

#: Samples of a chunk; values that go to the JVM in one batch, about; bytes of a file that one task reads, about; tasks, at most.
CHUNK, BATCH_VALUES, SPLIT_BYTES, MOST_TASKS = 1 << 16, 1 << 20, 1 << 27, 100_000
DECODERS = {"mat": mat.decode, "otb": otb.decode, "otb4": otb4.decode}
#: warnings: what is odd about the recording, in words.
HEAD = "file_id string, file_name string, file_type string, file_size long, sampling_frequency double, n_samples long, channel_count int, single boolean, time_aligned boolean, warnings array<string>, channel_idx int, description string"
#: time: as the file stores it, null where it is the axis of the sampling frequency. One that isn't aligned with the samples
#: (time_aligned) stands whole in the first chunk.
SIGNALS = HEAD + ", chunk_idx int, start_sample long, samples array<double>, time array<double>"
PARTS = "path string, length long, part int, parts int"


def type_of(path: str) -> str:
    """mat, otb or otb4, by the suffix in any case."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FILE_TYPES:
        raise ValueError(f"no reader for files that end in {suffix!r}")
    return FILE_TYPES[suffix]


def read_recordings(spark: SparkSession, path: str | list[str], file_type: str | None = None, header_only: bool = False, channels: list[int] | None = None, recursive: bool = False, seconds: tuple[float, float] | None = None) -> DataFrame:
    """A row for each chunk of each channel (SIGNALS), or with header_only for each channel (HEAD).

    path: a file, folder or pattern, or several. channels: only these. seconds: only chunks with samples from the first time to before
    the second. With header_only, and outside of these seconds, samples aren't read from files whose ranges can be read.
    """
    reader = ensure_workers(spark).read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(path)
    listed = found.select("path", "length")
    size, schemes = listed.agg(F.sum("length"), F.collect_set(F.regexp_extract("path", "^([^:/]*):", 1))).first()
    if not set(schemes) <= stores.SCHEMES.keys():
        return decode_files(found, file_type, header_only, channels, seconds)
    if header_only:
        return decode_parts(listed.withColumns({"part": F.lit(0), "parts": F.lit(1)}), file_type, True, channels, seconds)
    parts = F.ceil(F.greatest(F.col("length"), F.lit(1)) / SPLIT_BYTES).cast("int")
    rows = listed.withColumn("parts", parts).select("path", "length", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    tasks = min(MOST_TASKS, -(-(size or 0) // SPLIT_BYTES))
    return decode_parts(rows.repartition(tasks) if tasks > 1 else rows, file_type, False, channels, seconds)


def decode_parts(parts: DataFrame, file_type: str | None = None, header_only: bool = False, channels: list[int] | None = None, seconds: tuple[float, float] | None = None) -> DataFrame:
    """The rows of parts of files (PARTS). A part's task opens the file itself."""
    schema = HEAD if header_only else SIGNALS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, part, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open_file(path) as file:
                    yield from as_batches(decoded_rows(path, size, file, file_type, header_only, channels, part, of, seconds), schema)

    return parts.select("path", "length", "part", "parts").mapInArrow(run, schema)


def decode_files(files: DataFrame, file_type: str | None = None, header_only: bool = False, channels: list[int] | None = None, seconds: tuple[float, float] | None = None) -> DataFrame:
    """The same for rows of Spark's binary file source (path, length, content), also of a stream of them."""
    schema = HEAD if header_only else SIGNALS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path, size, content in zip(*(files.column(c) for c in ("path", "length", "content")), strict=True):
                file = io.BytesIO(content.as_py())
                yield from as_batches(decoded_rows(path.as_py(), size.as_py(), file, file_type, header_only, channels, 0, 1, seconds), schema)

    return files.select("path", "length", "content").mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def as_batches(rows: Iterator[list], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_VALUES values."""
    types, some, held = arrow_schema(schema), [], 0
    for row in rows:
        some.append(row)
        held += 1 if schema == HEAD else 1 + len(row[-2])
        if held >= BATCH_VALUES:
            yield as_batch(some, types)
            some, held = [], 0
    yield as_batch(some, types)


def as_batch(rows: list[list], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(types)], schema=types)


def parts_of(size: int) -> int:
    """Parts of a file of so many bytes."""
    return max(1, -(-size // SPLIT_BYTES))


def chunk_at(sample: int) -> int:
    return sample // CHUNK


def chunks_of(n_samples: int, part: int, parts: int, rate: float, seconds: tuple[float, float] | None, bounds: tuple[int, int] | None = None) -> range:
    """The chunks that a part of a recording consists of, without those outside of the seconds or of the numbers asked for."""
    total = -(-max(n_samples, 1) // CHUNK)
    low, high = part * total // parts, (part + 1) * total // parts
    if seconds is not None:
        first, last = (int(np.ceil(s * rate)) for s in seconds)
        low, high = max(low, first // CHUNK), min(high, -(-last // CHUNK))
    if bounds is not None:
        low, high = max(low, bounds[0]), min(high, bounds[1])
    return range(low, high)


def decoded_rows(path: str, size: int, file: BinaryIO, file_type: str | None, header_only: bool, channels: list[int] | None, part: int = 0, parts: int = 1, seconds: tuple[float, float] | None = None, bounds: tuple[int, int] | None = None) -> Iterator[list]:
    """The rows of a part of one file. Where ranges can't be read by themselves, the first part has all rows and the others none."""
    kind = file_type or type_of(path)
    if kind == "mat" and part:
        return
    d = DECODERS[kind](file, header_only)
    if not d.ranged:
        if part:
            return
        parts = 1
    logger_of(__name__).debug("%s: %s samples of %s channels at %s", path, d.n_samples, d.n_channels, d.rate)
    head = [path, path.rsplit("/", 1)[-1], kind, size, d.rate, d.n_samples, d.n_channels, d.single, d.time_aligned, d.warnings]
    stored = None if d.time is None or d.time_aligned and np.array_equal(d.time, np.arange(d.n_samples) / d.rate) else d.time
    listed = range(d.n_channels) if channels is None else [c for c in channels if 0 <= c < d.n_channels]
    described = lambda c: d.descriptions[c] if c is not None and d.descriptions and c < len(d.descriptions) else None
    if header_only:
        yield from ([*head, c, described(c)] for c in (listed if d.n_channels else [None]))
        return
    for k in chunks_of(d.n_samples, part, parts, d.rate, seconds, bounds):
        s = k * CHUNK
        data = d.read(s, max(0, min(CHUNK, d.n_samples - s))) if d.n_channels else None
        time = None if stored is None else stored[s : s + CHUNK] if d.time_aligned else stored if k == 0 else None
        for c in listed if d.n_channels else [None]:
            yield [*head, c, described(c), k, s, np.zeros(0) if data is None else data[c], time]


def mat_path(path: str) -> str:
    """The path with the suffix .mat in place of its own."""
    return str(PurePosixPath(path).with_suffix(".mat")) if "://" not in path else path.rsplit(".", 1)[0] + ".mat" if "." in path.rsplit("/", 1)[-1] else path + ".mat"


def recordings(signals: DataFrame) -> DataFrame:
    """One row for each file."""
    keys = ["file_id", "file_name", "file_type", "file_size", "sampling_frequency", "n_samples", "channel_count"]
    return signals.select(*keys).distinct()


def channels(signals: DataFrame) -> DataFrame:
    return signals.where("channel_idx is not null").select("file_id", "channel_idx", "description").distinct()


def warnings(signals: DataFrame) -> DataFrame:
    """(file_id, warning): what readers found odd about files."""
    return signals.select("file_id", F.explode("warnings").alias("warning")).distinct()
