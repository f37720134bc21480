"""MATLAB files of recordings, level 5 and level 4: Data, Time, Description, SamplingFrequency. HDF5 based files (7.3) aren't read."""

from __future__ import annotations

import struct
import zlib
from typing import BinaryIO

import numpy as np

from myospark.operators.layout import check_time
from myospark.sources.recording import Decoded

#: Fixed values of the format: data types of elements, and classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED, UTF8, UTF16, UTF32 = 14, 15, 16, 17, 18
CELL, STRUCT, CHAR, DOUBLE, INT16 = 1, 2, 4, 6, 10
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
HEADER_BYTES = 128
#: Fixed values of level 4: number types by their digit, kinds of matrices, and the type digit's weight beside those of byte order and kind.
NUMBERS_4 = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}
NUMERIC_4, TEXT_4, BIG_ENDIAN = 0, 1, 1000
HEADER_BYTES_4 = 20


def elements(raw: bytes, order: str):
    """(type, content) of the elements that follow each other in raw."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # both in four bytes, with up to four bytes of content
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def numbers(kind: int, raw: bytes, order: str) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(NUMBERS[kind]).newbyteorder(order))


class Unread(tuple):
    """The shape of an array whose numbers weren't read; `kind` is its class."""

    kind = DOUBLE


def matrix(raw: bytes, order: str, skip: str | None = None) -> tuple[str, object]:
    """Name and value of an array: numbers, a string (rows of characters as a list), or a list for a cell array.

    skip: the name of an array of which only the shape is read.
    """
    parts = elements(raw, order)
    flags = numbers(*next(parts), order)
    shape = tuple(numbers(*next(parts), order).tolist())
    name = bytes(next(parts)[1]).decode("latin-1")
    kind = int(flags[0]) & 0xFF
    if name == skip:
        unread = Unread(shape)
        unread.kind = kind
        return name, unread
    if kind == CELL:
        return name, [matrix(p, order)[1] if p else np.zeros((0, 0)) for t, p in parts if t == MATRIX]
    if kind == CHAR:
        t, p = next(parts)
        return name, characters(t, p, shape, order)
    if kind not in CLASSES:
        return name, None
    values = numbers(*next(parts), order).astype(CLASSES[kind])
    return name, values.reshape(shape, order="F")


def characters(kind: int, raw: bytes, shape: tuple, order: str) -> object:
    if kind == UTF8:
        text = raw.decode("utf-8", "replace")
    elif kind in (UTF16, UTF32):
        text = raw.decode({UTF16: "utf-16", UTF32: "utf-32"}[kind] + ("-le" if order == "<" else "-be"))
    else:
        text = "".join(map(chr, numbers(kind, raw, order).tolist()))
    if not shape or shape[0] <= 1:
        return text
    return ["".join(row).rstrip() for row in np.array(list(text)).reshape(shape, order="F")]


#: Bytes that an array's flags, shape and name fit into.
HEAD_BYTES = 1024


def unpacked(raw: bytes, order: str, skip: str | None) -> bytes:
    """A compressed array; if it is the one to skip, only its head."""
    if skip is not None:
        head = zlib.decompressobj().decompress(raw, HEAD_BYTES)
        if struct.unpack_from(order + "I", head)[0] == MATRIX:
            parts = elements(head[8:], order)
            next(parts), next(parts)
            if bytes(next(parts)[1]).decode("latin-1") == skip:
                return head
    return zlib.decompress(raw)


def read_mat(content: bytes, skip: str | None = None) -> dict[str, object]:
    """All variables of a file of either level; of the one named `skip` only the shape."""
    if 0 in content[:4]:  # level 5 begins with four characters of text
        return read_mat4(content, skip)
    if len(content) < HEADER_BYTES or content[:8] == b"\x89HDF\r\n\x1a\n":
        raise ValueError("this isn't a MATLAB file of level 4 or 5")
    order = {b"IM": "<", b"MI": ">"}.get(content[126:128])
    if order is None:
        raise ValueError("this isn't a MATLAB file of level 4 or 5")
    out: dict[str, object] = {}
    for kind, raw in elements(content[HEADER_BYTES:], order):
        if kind == COMPRESSED:
            kind, raw = next(elements(unpacked(raw, order, skip), order))
        if kind == MATRIX:
            name, value = matrix(raw, order, skip)
            out[name] = value
    return out


def read_mat4(content: bytes, skip: str | None = None) -> dict[str, object]:
    """Variables that follow each other, each behind a header of its own. Sparse matrices have no value; imaginary parts are left out."""
    out: dict[str, object] = {}
    at = 0
    while at < len(content):
        if len(content) - at < HEADER_BYTES_4:
            raise ValueError("the file ends inside a variable's header")
        order = "<" if struct.unpack_from("<I", content, at)[0] < 10 * BIG_ENDIAN else ">"
        code, rows, columns, imaginary, name_bytes = struct.unpack_from(order + "5i", content, at)
        machine, number, kind = code // BIG_ENDIAN, code // 10 % 10, code % 10
        if machine not in (0, 1) or machine != (order == ">") or number not in NUMBERS_4 or code // 100 % 10 or min(rows, columns, name_bytes) < 0:
            raise ValueError("this isn't a MATLAB file of level 4 or 5")
        at += HEADER_BYTES_4
        name = content[at : at + name_bytes].split(b"\0")[0].decode("latin-1")
        at += name_bytes
        of = np.dtype(NUMBERS_4[number]).newbyteorder(order)
        size = rows * columns * of.itemsize
        if at + size > len(content):
            raise ValueError(f"the file ends inside {name}")
        if name == skip:
            unread = Unread((rows, columns))
            unread.kind = INT16 if NUMBERS_4[number] == "i2" else DOUBLE
            out[name] = unread
        elif kind == TEXT_4:
            codes = np.frombuffer(content, of, rows * columns, at).reshape((rows, columns), order="F")
            lines = ["".join(chr(int(c)) for c in row) for row in codes]
            out[name] = [x.rstrip() for x in lines] if rows > 1 else "".join(lines)
        else:
            out[name] = np.frombuffer(content, of, rows * columns, at).astype(NUMBERS_4[number]).reshape((rows, columns), order="F") if kind == NUMERIC_4 else None
        at += size * (2 if imaginary else 1)
    return out


def write_mat4(variables: dict[str, object]) -> bytes:
    """A level 4 file; lists of strings become rows of characters, padded with blanks, and other number types doubles."""
    parts, numbers_of = [], {np.dtype(v): k for k, v in NUMBERS_4.items()}
    for name, value in variables.items():
        kind = NUMERIC_4
        if isinstance(value, str | list):
            lines, kind = [value] if isinstance(value, str) else value, TEXT_4
            wide = max((len(x) for x in lines), default=0)
            x = np.array([[ord(c) for c in line.ljust(wide)] for line in lines], float).reshape(len(lines), wide)
        else:
            x = np.atleast_2d(np.asarray(value))
            x = x if x.dtype in numbers_of else x.astype(float)
        named = name.encode("latin-1") + b"\0"
        parts.append(struct.pack("<5i", numbers_of[x.dtype] * 10 + kind, *x.shape, 0, len(named)) + named + x.tobytes(order="F"))
    return b"".join(parts)


def element(kind: int, raw: bytes) -> bytes:
    return struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def array(name: str, value: object) -> bytes:
    """The element of an array: numbers, a string, or a column of strings."""
    if isinstance(value, str):
        raw = value.encode("utf-16-le")
        kind, shape, body = CHAR, (1 if value else 0, len(raw) // 2), element(4, raw)
    elif isinstance(value, list):
        kind, shape, body = CELL, (len(value), 1), b"".join(array("", v) for v in value)
    else:
        x = np.atleast_2d(np.asarray(value))
        codes = {np.dtype(v): k for k, v in CLASSES.items()}
        if x.dtype not in codes:
            x = x.astype(float)
        number = {np.dtype(v): k for k, v in NUMBERS.items()}[x.dtype]
        kind, shape, body = codes[x.dtype], x.shape, element(number, x.tobytes(order="F"))
    head = element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode("latin-1"))
    return element(MATRIX, head + body)


def write_mat(variables: dict[str, object]) -> bytes:
    """A file with these variables, each compressed."""
    parts = []
    for name, value in variables.items():
        packed = zlib.compress(array(name, value))
        parts.append(struct.pack("<II", COMPRESSED, len(packed)) + packed)
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + b"".join(parts)


def texts(value: object) -> list[str] | None:
    """Descriptions, however deeply they are nested."""
    if value is None:
        return None
    if isinstance(value, list):
        return [t for v in value for t in (texts(v) or [""])]
    return [value] if isinstance(value, str) else [str(v) for v in np.ravel(value)]


def decode(content: bytes | BinaryIO, header_only: bool = False) -> Decoded:
    """Data is turned so that it has no fewer samples than channels; 16-bit integers become single floats. The file is read whole."""
    found = read_mat(content if isinstance(content, bytes) else content.read(), "Data" if header_only else None)
    for name in ("Data", "Time"):
        if name not in found:
            raise KeyError(name)
    data, time = found["Data"], np.ravel(found["Time"])
    if header_only:
        shape, whole = (tuple(data) if len(data) > 1 else (1, *data)), data.kind == INT16
    else:
        data = np.atleast_2d(data)
        shape, whole = data.shape, data.dtype == np.int16
    wide = shape[0] < shape[1]
    n_samples, n_channels = shape[::-1] if wide else shape
    aligned = check_time(len(time), n_samples, n_channels)
    rate = found.get("SamplingFrequency")

    def read(start: int, n: int) -> np.ndarray:
        return (data if wide else data.T)[:, start : start + n].astype(float)

    return Decoded(float(np.ravel(rate)[0]) if rate is not None else 1.0, n_samples, texts(found.get("Description")), None if header_only else read, time.astype(float), whole, aligned, n_channels)
