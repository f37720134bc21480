"""Files in stores that Arrow's file systems know, by the paths that Spark gives them."""

from __future__ import annotations

import os
from typing import BinaryIO

import pyarrow.fs

#: Schemes of stores that tasks open by Arrow, in Arrow's spelling. hdfs needs libhdfs on each machine, so it is left to Spark.
SCHEMES = {"": "", "file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def scheme_of(path: str) -> str:
    return path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else ""


def system_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system for a path, and the path in it."""
    scheme = scheme_of(path)
    if scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), os.path.abspath("/" + path[5:].lstrip("/") if scheme else path)
    return pyarrow.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + path[len(scheme) :])


def open_file(path: str) -> BinaryIO:
    """A file that can be read from any place."""
    system, at = system_of(path)
    return system.open_input_file(at)
