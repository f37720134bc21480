"""Recordings as they arrive in a folder: a stream of files becomes a stream of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from myospark.session import ensure_workers
from myospark.sources.files import decode_files

#: Schema of Spark's binary file source.
FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_recordings(spark: SparkSession, folder: str, header_only: bool = False, files_per_batch: int = 64) -> DataFrame:
    """New files of the folder, decoded like files.read_recordings; any sink will do, as no state is kept."""
    reader = ensure_workers(spark).readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch)
    return decode_files(reader.load(folder), header_only=header_only)
