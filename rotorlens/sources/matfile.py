"""Recordings in MATLAB level-5 files: a small reader of the format, and their channels as samples."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format: element types and array classes.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, CHAR = 1, 2, 4
NUMERIC = range(6, 16)


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element keeps its size and up to four bytes in the tag
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
            continue
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("the file ends inside an element")
        yield kind, body
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def _numbers(element: tuple[int, bytes], order: str) -> np.ndarray:
    kind, body = element
    if kind not in NUMBERS:
        raise ValueError(f"element type {kind} holds no numbers")
    return np.frombuffer(body, order + NUMBERS[kind])


def _matrix(body: bytes, order: str) -> tuple[str, object]:
    """Name and value: an array (columns first, as stored), a text, a list of cells, or a list of dicts."""
    parts = list(_elements(body, order))
    if len(parts) < 3:
        return "", np.zeros(0)
    kind = int(_numbers(parts[0], order)[0]) & 0xFF
    shape = tuple(int(n) for n in _numbers(parts[1], order))
    name, rest = parts[2][1].decode("latin-1"), parts[3:]
    if kind == CELL:
        return name, [_matrix(b, order)[1] for _, b in rest]
    if kind == STRUCT:
        width = int(_numbers(rest[0], order)[0])
        names = [rest[1][1][i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(rest[1][1]), width)]
        values = [_matrix(b, order)[1] for _, b in rest[2:]]
        return name, [dict(zip(names, values[i : i + len(names)])) for i in range(0, len(values), max(1, len(names)))]
    if kind == CHAR:
        return name, "".join(map(chr, _numbers(rest[0], order))) if rest else ""
    if kind in NUMERIC:
        return name, (_numbers(rest[0], order) if rest else np.zeros(0)).reshape(shape, order="F")
    raise ValueError(f"arrays of class {kind} are not read")


def variables(data: bytes) -> dict[str, object]:
    """The file's variables by name, in order; other levels of the format raise."""
    mark = data[126:128]
    if len(data) < 128 or mark not in (b"IM", b"MI"):
        raise ValueError("not a level-5 file")
    order, out = "<" if mark == b"IM" else ">", {}
    for kind, body in _elements(data[128:], order):
        if kind == COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind == MATRIX:
            name, value = _matrix(body, order)
            out[name] = value
    return out


def channels(data: bytes) -> dict[str, np.ndarray]:
    """Name and samples of each channel: entries of Y in the first variable that is not the format's own."""
    value = next((v for k, v in variables(data).items() if not k.startswith("__")), None)
    if not isinstance(value, list) or not value or "Y" not in value[0]:
        raise ValueError("the first variable has no channels Y")
    return {str(y["Name"]): np.asarray(y["Data"], float).ravel() for y in value[0]["Y"]}


def recordings(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """file, channel, x (array), error: a row for each channel of each .mat file under path; a file that can't be
    read gives one row with the reason instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["file"], b["content"]):
                try:
                    rows = [(file, name, x, None) for name, x in channels(data).items() if wanted is None or name in wanted]
                    missing = sorted(set(wanted or []) - {r[1] for r in rows})
                    if missing:
                        raise ValueError(f"no channels {missing}")
                except (ValueError, KeyError, TypeError, IndexError, StopIteration, struct.error, zlib.error) as e:
                    rows = [(file, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["file", "channel", "x", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInPandas(run, "file string, channel string, x array<double>, error string")
