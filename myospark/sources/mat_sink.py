"""MATLAB files written under a commit protocol: all files of a job appear, or none.

A task writes its recordings, each whole, into a folder of the job beside the targets, under names of its own. When all tasks are done, the driver
moves the files of the attempts that count to their places; files of failed and of speculative attempts go with the job's folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from myospark.session import ensure_workers
from myospark.sources import mat
from myospark.sources.files import mat_path
from myospark.sources.recording import logger_of
from myospark.sources.stores import scheme_of, system_of

NAMED = ["file_id", "target", "single", "sampling_frequency", "channel_idx", "description", "chunk_idx", "samples", "time"]


@dataclass
class Written(WriterCommitMessage):
    """Where files are, and where they belong."""

    files: list[tuple[str, str]]


def variables_of(group: pd.DataFrame) -> dict[str, object]:
    """What a recording's file holds. group: its chunks, by channel and chunk."""
    first = group.iloc[0]
    joined = lambda parts: np.concatenate([np.zeros(0), *(x for x in parts if x is not None)])
    channels = [g for _, g in group.groupby("channel_idx")]
    data = np.stack([joined(g["samples"]) for g in channels], axis=1) if channels else np.zeros((0, 0))
    if first["single"]:
        data = data.astype(np.float32)
    stored = (channels[0] if channels else group)["time"]
    time = joined(stored) if stored.notna().any() else np.arange(len(data)) / first["sampling_frequency"]
    described = group.drop_duplicates("channel_idx")["description"]
    out = {"Data": data, "Time": time[:, None], "SamplingFrequency": np.array([[first["sampling_frequency"]]])}
    if described.notna().all():
        out["Description"] = described.tolist()
    return out


class MatWriter(DataSourceArrowWriter):
    def __init__(self, level: int, job: str):
        self.level, self.job = level, job

    def folder(self, target: str) -> str:
        """The job's folder beside a target."""
        return f"{target.rsplit('/', 1)[0] if '/' in target else '.'}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come by target, channel and chunk."""
        files, held = [], []
        for b in iterator:
            rows = b.to_pandas()
            for target, group in rows.groupby("target", sort=False):
                if held and held[0]["target"].iloc[0] != target:
                    files.append(self.save(held))
                    held = []
                held.append(group)
        if held:
            files.append(self.save(held))
        return Written(files)

    def save(self, groups: list[pd.DataFrame]) -> tuple[str, str]:
        group = pd.concat(groups)
        target = group["target"].iloc[0]
        if group["file_id"].nunique() > 1:
            raise ValueError(f"several recordings would be written to {target}: {', '.join(sorted(group['file_id'].unique())[:3])}")
        variables = variables_of(group)
        content = mat.write_mat4(variables) if self.level == 4 else mat.write_mat(variables)
        part = f"{self.folder(target)}/{uuid.uuid4()}"
        system, at = system_of(part)
        system.create_dir(at.rsplit("/", 1)[0])
        with system.open_output_stream(at) as out:
            out.write(content)
        return part, target

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        for part, target in files:
            system, at = system_of(target)
            system.move(system_of(part)[1], at)
            logger_of(__name__).info("saved %s", target)
        self.clean(files)

    def abort(self, messages: list[Written | None]) -> None:
        """Spark names the files of tasks that had ended; `write_mat_files` removes the rest."""
        self.clean([f for m in messages if m is not None for f in m.files])

    def clean(self, files: list[tuple[str, str]]) -> None:
        for folder in {self.folder(target) for _, target in files}:
            remove(folder)


def remove(folder: str) -> None:
    system, at = system_of(folder)
    if system.get_file_info(at).type != pyarrow.fs.FileType.NotFound:
        system.delete_dir(at)


class MatSink(DataSource):
    """format("recording_mat"): rows of NAMED, those of a target in one partition, by channel and chunk. Options: level, job."""

    @classmethod
    def name(cls) -> str:
        return "recording_mat"

    def writer(self, schema: StructType, overwrite: bool) -> MatWriter:
        return MatWriter(int(self.options.get("level", 5)), self.options.get("job") or uuid.uuid4().hex)


def write_mat_files(signals: DataFrame, path: str | None = None, target: str | None = None, level: int = 5) -> DataFrame:
    """Write each recording to a file of its own, and give (file_id, path) of all.

    path: the folder; the files keep their names, with the suffix .mat. target: the file itself, for a single recording;
    another suffix than .mat is replaced. If recordings would be written to one file, or anything else fails, no file is written.
    The folder may be any URI that Arrow's file systems know; it must be shared by the executors. A recording is written by one task. level: 4 or 5.
    """
    if level not in (4, 5):
        raise ValueError(f"MATLAB files are of level 4 or 5, not {level}")
    spark, job = ensure_workers(signals.sparkSession), uuid.uuid4().hex
    spark.dataSource.register(MatSink)
    path, target = (os.path.abspath(p) if p is not None and not scheme_of(p) else p for p in (path, target))
    stem = F.regexp_replace("file_name", r"^(.+)\.[^.]+$", "$1")
    named = F.lit(target if target.lower().endswith(".mat") else mat_path(target)) if target is not None else F.concat(F.lit(f"{path}/"), stem, F.lit(".mat"))
    rows = signals.withColumn("target", named)
    folder = MatWriter(level, job).folder(target if target is not None else f"{path}/x")
    try:
        rows.select(*NAMED).repartition("target").sortWithinPartitions("target", "channel_idx", "chunk_idx").write.format("recording_mat").options(level=level, job=job).mode("append").save()
    except Exception:
        remove(folder)
        raise
    return rows.select("file_id", F.col("target").alias("path")).distinct()


