"""Recordings in archives: directories are walked by seeking, and members read by range; nothing is unpacked to disk."""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Callable
from typing import BinaryIO


class Archive:
    """The files of a tar or zip archive, by name.

    Of a tar archive only the headers are read, of a zip archive the directory. `stored`: whether any range of a member can be read
    without what stands before it; else it is inflated up to the range, in small pieces, and ranges that follow each other go on from there.
    """

    def __init__(self, file: BinaryIO):
        self.names: list[str] = []
        self._members: dict[str, tuple[int, bool, Callable[[], BinaryIO]]] = {}
        self._opened: dict[str, BinaryIO] = {}
        for walk in (_tar, _zip, _packed_tar):
            file.seek(0)
            if (found := walk(file)) is not None:
                self._members = {_clean(name): member for name, *member in found}
                self.names = sorted(self._members)
                return
        raise RuntimeError("the recording is neither a tar nor a zip archive")

    def __contains__(self, name: str) -> bool:
        return name in self._members

    def size(self, name: str) -> int:
        return self._members[name][0]

    def stored(self, name: str) -> bool:
        return self._members[name][1]

    def read(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        if name not in self._opened:
            self._opened[name] = self._members[name][2]()
        member = self._opened[name]
        if member.tell() != start:
            member.seek(start)
        return member.read(self.size(name) - start if size is None else size)

    @property
    def signals(self) -> list[str]:
        return [name for name in self.names if name.lower().endswith(".sig")]


def _tar(file: BinaryIO, mode: str = "r:", stored: bool = True) -> list[tuple] | None:
    try:
        t = tarfile.open(fileobj=file, mode=mode)
        return [(m.name, m.size, stored, lambda m=m: t.extractfile(m)) for m in t.getmembers() if m.isfile()]
    except tarfile.TarError:
        return None


def _packed_tar(file: BinaryIO) -> list[tuple] | None:
    return _tar(file, "r:*", False)


def _zip(file: BinaryIO) -> list[tuple] | None:
    try:
        z = zipfile.ZipFile(file)
    except zipfile.BadZipFile:
        return None
    return [(i.filename, i.file_size, i.compress_type == zipfile.ZIP_STORED, lambda i=i: z.open(i)) for i in z.infolist() if not i.is_dir()]


def _clean(name: str) -> str:
    return "/".join(p for p in name.split("/") if p not in ("", "."))
