"""Recordings as bytes: the inverse of the decoders, for fixtures and round trips."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from myospark.sources.stores import system_of


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows (path, content) to files of these names in a folder that all executors share; a repeated task writes the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, at = system_of(f"{folder}/{path.lstrip('/')}")
                system.create_dir(at.rsplit("/", 1)[0])
                part = f"{at}.{uuid.uuid4()}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, at)
            yield b.select(["path"])

    files.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def archive(found: dict[str, bytes], kind: str = "tar") -> bytes:
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            for name, content in found.items():
                z.writestr(name, content)
    else:
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, content in found.items():
                info = tarfile.TarInfo(name)
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def interleaved(counts: np.ndarray, kind: str) -> bytes:
    """Channels by samples, as a stream of samples."""
    return np.ascontiguousarray(counts.T).astype(kind).tobytes()


def encode_otb(header: dict[str, object], adapters: list[tuple[dict[str, object], list[dict[str, object]]]], counts: np.ndarray, kind: str = "tar", tail: bytes = b"") -> bytes:
    """header: attributes of the root; adapters: attributes of each and of its channels. tail: a partial last sample."""
    text = lambda d: {k: str(v) for k, v in d.items()}
    root = ElementTree.Element("Device", text(header))
    top = ElementTree.SubElement(root, "Channels")
    for attributes, channels in adapters:
        adapter = ElementTree.SubElement(top, "Adapter", text(attributes))
        for channel in channels:
            ElementTree.SubElement(adapter, "Channel", text(channel))
    raw = interleaved(counts, "<i2" if int(header.get("ad_bits", 16)) == 16 else "<i4") + tail
    return archive({"rec.sig": raw, "rec.xml": ElementTree.tostring(root)}, kind)


def encode_otb4(tracks: list[dict[str, object]], streams: dict[str, bytes], kind: str = "tar") -> bytes:
    """tracks: child elements of each TrackInfo."""
    root = ElementTree.Element("ArrayOfTrackInfo")
    for track in tracks:
        e = ElementTree.SubElement(root, "TrackInfo")
        for name, value in track.items():
            ElementTree.SubElement(e, name).text = str(value)
    return archive({"Tracks_000.xml": ElementTree.tostring(root), **streams}, kind)
