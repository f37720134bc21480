"""One recording, as an object over DataFrames: load, grids, get_grid, save, copy."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Row, SparkSession

from myospark.operators.grids import GridCatalog, extract_grids, get_grid
from myospark.session import cut
from myospark.sources import files, mat_sink


@dataclass
class Recording:
    """signals: the chunked samples of one file or of many. header: a row for each channel, read without the samples."""

    signals: DataFrame
    catalog: GridCatalog = field(default_factory=GridCatalog)
    header: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, catalog: GridCatalog | None = None) -> Recording:
        """Read a file by its suffix; others are a ValueError."""
        kind = files.type_of(path)
        return cls(files.read_recordings(spark, path, kind), catalog or GridCatalog(), files.read_recordings(spark, path, kind, header_only=True))

    @property
    def described(self) -> DataFrame:
        return self.signals if self.header is None else self.header

    @property
    def channels(self) -> DataFrame:
        return files.channels(self.described)

    @property
    def recordings(self) -> DataFrame:
        return files.recordings(self.described)

    @property
    def warnings(self) -> DataFrame:
        """(file_id, warning): what is odd about the files, as their readers found."""
        return files.warnings(self.described)

    @property
    def grids(self) -> DataFrame:
        """The grids; their uids are the same each time."""
        return extract_grids(self.channels, self.catalog.frame(self.signals.sparkSession))

    def get_grid(self, *, grid_key: str | None = None, grid_uid: str | None = None) -> Row | None:
        """The first grid with this key, or else with this uid."""
        if grid_key is None and grid_uid is None:
            return None
        return get_grid(self.grids, grid_key, grid_uid).first()

    def save(self, target: str, suffix: str | None = None) -> list[str]:
        """Write to the file `target` if it ends in .mat, or each recording to a file in the folder `target`.

        Only .mat is known; other suffixes are a ValueError, and so are several recordings for one file. The paths written.
        """
        named = target.endswith(".mat") and suffix is None
        ending = suffix if suffix is not None else PurePosixPath(target).suffix
        if ending not in ("", ".mat"):
            raise ValueError(f"no writer for files that end in {ending!r}")
        found = mat_sink.write_mat_files(self.signals, target=target) if named else mat_sink.write_mat_files(self.signals, target)
        return [r["path"] for r in found.collect()]

    def copy(self) -> Recording:
        """The same rows, cut off from the files they were read from."""
        return Recording(cut(self.signals), self.catalog, None if self.header is None else cut(self.header))
