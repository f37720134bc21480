"""Recordings as a Spark data source, "recording": for SQL, for filters that reach into files, and for streams of recordings that grow.

    register(spark)
    spark.read.format("recording").load("/data/*.otb+").where("channel_idx = 3 and start_sample >= 65536")

Filters on file_name, file_type, channel_idx, chunk_idx and start_sample are pushed: files, parts and chunks that can't match aren't
opened, planned or read. Files are listed by Arrow's file systems; for other stores use `files.read_recordings`, which lists them by Spark.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from myospark.functions.columns import FILE_TYPES
from myospark.session import ensure_workers
from myospark.sources.files import HEAD, SIGNALS, SPLIT_BYTES, as_batches, chunk_at, decoded_rows, parts_of, type_of
from myospark.sources.otb import Header, counts, millivolts, parse_header, width
from myospark.sources.stores import open_file, scheme_of, system_of

#: Columns whose filters choose files, channels and chunks.
EXACT, ORDERED = ("file_name", "file_type", "channel_idx"), ("chunk_idx", "start_sample")
#: What opening a file costs, in bytes that could be read meanwhile, about; tasks that a read is shared out to, if it has so many files.
OPEN_BYTES, LEAST_TASKS = 1 << 20, 64
#: Chunks of a growing recording that one task gives, at most.
TOGETHER = 64
GROWING = "file_id string, channel_idx int, description string, chunk_idx long, start_sample long, sampling_frequency double, samples array<double>"


@dataclass
class Parts(InputPartition):
    """What one task reads, in turn: (path, size, part, parts) of parts of files."""

    parts: list[tuple[str, int, int, int]]

    @property
    def path(self) -> str:
        """The first file."""
        return self.parts[0][0] if self.parts else ""

    @property
    def size(self) -> int:
        """Bytes of the files, as often as parts of them are read."""
        return sum(p[1] for p in self.parts)


def shared_out(parts: list[tuple[str, int, int, int]], header_only: bool) -> list[Parts]:
    """Parts of large files by themselves, small files together: a task for each SPLIT_BYTES, where opening a file counts as OPEN_BYTES.

    Where that makes less than LEAST_TASKS tasks, there are about as many, or one for each part.
    """
    costs = [OPEN_BYTES + (0 if header_only else size // of) for _, size, _, of in parts]
    most, out, held = min(SPLIT_BYTES, sum(costs) // LEAST_TASKS), [], 0
    for part, cost in zip(parts, costs, strict=True):
        if not out or held + cost > most:
            out.append(Parts([]))
            held = 0
        out[-1].parts.append(part)
        held += cost
    return out


def listed(path: str, recursive: bool) -> list[tuple[str, int]]:
    """(path, size) of a file, of the recordings in a folder, or of those that a pattern in the last part of the path matches."""
    system, at = system_of(path)
    folder, pattern = at.rsplit("/", 1)
    if any(c in pattern for c in "*?["):
        found = [f for f in system.get_file_info(pyarrow.fs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, pattern)]
    else:
        info = system.get_file_info(at)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(pyarrow.fs.FileSelector(at, recursive=recursive))
    scheme = scheme_of(path)
    prefix = "file:" if scheme in ("", "file") else f"{scheme}://"
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and PurePosixPath(f.path).suffix.lower() in FILE_TYPES)


class RecordingReader(DataSourceReader):
    """exact: the values that a column may have. bounds: the chunks from a number to before another."""

    def __init__(self, path: str, recursive: bool, header_only: bool):
        self.path, self.recursive, self.header_only = path, recursive, header_only
        self.exact: dict[str, set] = {}
        self.bounds, self.some_channel = (0, 1 << 62), False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.takes(f):
                yield f

    def takes(self, f: Filter) -> bool:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        if isinstance(f, IsNotNull) and column in (*EXACT, *ORDERED):
            self.some_channel |= column == "channel_idx"  # recordings without channels have a row without one; nothing else is null
            return True
        if column in EXACT and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.exact[column] = self.exact.get(column, values) & values
            return True
        if column in ORDERED and not self.header_only and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            at = chunk_at if column == "start_sample" else int  # the chunk that a number lies in; the next one if it isn't a chunk's start
            up = lambda value: -at(-value)
            low, high = self.bounds
            if isinstance(f, EqualTo | GreaterThanOrEqual):
                low = max(low, up(f.value))
            if isinstance(f, GreaterThan):
                low = max(low, at(f.value) + 1)
            if isinstance(f, EqualTo | LessThanOrEqual):
                high = min(high, at(f.value) + 1)
            if isinstance(f, LessThan):
                high = min(high, up(f.value))
            self.bounds = (low, high)
            return True
        return False

    def wanted(self, column: str, value: object) -> bool:
        return column not in self.exact or value in self.exact[column]

    def partitions(self) -> list[Parts]:
        out = []
        for path, size in listed(self.path, self.recursive):
            if self.wanted("file_name", path.rsplit("/", 1)[-1]) and self.wanted("file_type", type_of(path)) and self.bounds[0] < self.bounds[1]:
                parts = 1 if self.header_only else parts_of(size)
                out += [(path, size, k, parts) for k in range(parts)]
        return shared_out(out, self.header_only) or [Parts([])]

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        schema = HEAD if self.header_only else SIGNALS
        channels = sorted(c for c in self.exact["channel_idx"] if c is not None) if "channel_idx" in self.exact else None
        at = [c.split()[0] for c in schema.split(", ")].index("channel_idx")

        def rows() -> Iterator[list]:
            for path, size, part, of in partition.parts:
                with open_file(path) as file:
                    found = decoded_rows(path, size, file, None, self.header_only, channels, part, of, None, self.bounds)
                    yield from (r for r in found if r[at] is not None or channels is None and not self.some_channel)

        yield from as_batches(rows(), schema)


@dataclass
class Grown(InputPartition):
    path: str
    first: int
    last: int


class GrowingReader(DataSourceStreamReader):
    """A stream of chunks of signal files that are still being written, `x.sig` beside their header `x.xml`.

    An offset says how many samples of each file have been given. A chunk is given once it is whole, and the rest once there is a file `x.done`.
    So chunks are numbered by where they stand in their file, and a restart from a checkpoint gives each of them once.
    """

    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, at = system_of(self.path)
        found = {f.path: f.size for f in system.get_file_info(pyarrow.fs.FileSelector(at)) if f.is_file}
        out = {}
        for path, size in sorted(found.items()):
            stem = path[: -len(".sig")]
            if path.lower().endswith(".sig") and f"{stem}.xml" in found:
                h = self.header(stem)
                samples = size // (h.channels * width(h.bits))
                out[path] = samples if f"{stem}.done" in found else samples // self.chunk * self.chunk
        return out

    def header(self, stem: str) -> Header:
        system, _ = system_of(self.path)
        with system.open_input_stream(f"{stem}.xml") as f:
            return parse_header(f.read())

    def partitions(self, start: dict, end: dict) -> list[Grown]:
        found = [Grown(path, start.get(path, 0), samples) for path, samples in end.items() if samples > start.get(path, 0)]
        step = TOGETHER * self.chunk
        return [Grown(g.path, s, min(g.last, s + step)) for g in found for s in range(g.first, g.last, step)]

    def read(self, partition: Grown) -> Iterator[pa.RecordBatch]:
        h, rows = self.header(partition.path[: -len(".sig")]), []
        step = h.channels * width(h.bits)
        system, _ = system_of(self.path)
        with system.open_input_file(partition.path) as f:
            for s in range(partition.first, partition.last, self.chunk):
                f.seek(s * step)
                raw = f.read((min(partition.last, s + self.chunk) - s) * step)
                data = millivolts(counts(raw, h.channels, h.bits), h.gains, h.bits)
                rows += [(partition.path, c, h.descriptions[c], s // self.chunk, s, h.rate, data[c]) for c in range(h.channels)]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in GROWING.split(", ")])

    def commit(self, end: dict) -> None:
        pass


class RecordingSource(DataSource):
    """Options: path; recursive; header_only (a row for each channel, without samples). As a stream: path (a folder), chunk (samples)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def flag(self, name: str) -> bool:
        return str(self.options.get(name, "false")).lower() == "true"

    @property
    def growing(self) -> bool:
        return self.flag("growing")

    def schema(self) -> str:
        return GROWING if self.growing else HEAD if self.flag("header_only") else SIGNALS

    def reader(self, schema: object) -> RecordingReader:
        return RecordingReader(self.options["path"], self.flag("recursive"), self.flag("header_only"))

    def streamReader(self, schema: object) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("chunk", 4096)))


def register(spark: SparkSession) -> None:
    """Make format("recording") known to a session, and let its filters be pushed."""
    ensure_workers(spark).dataSource.register(RecordingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
