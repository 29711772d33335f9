"""Frames as tables: a PNG codec without outside libraries, a scan of image folders, and a data source of raw video."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode_png(a: np.ndarray) -> bytes:
    """8-bit grey (h, w) or RGB (h, w, 3) as PNG."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def _restored(line: bytes, above: bytes, n: int, kind: int) -> bytearray:
    """A row under the filter of averages (3) or of the nearest neighbour (4), with ``n`` bytes a cell."""
    out = bytearray(n) + line
    corner = bytes(n) + above
    for i, b in enumerate(above):
        a, c = out[i], corner[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            left, up, diagonal = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if left <= up and left <= diagonal else b if up <= diagonal else c
        out[i + n] = (out[i + n] + guess) & 255
    return out[n:]


def decode_png(data: bytes) -> np.ndarray:
    """8-bit PNG without interlacing as (h, w, channels); anything else raises ValueError."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
        if kind == b"IEND":
            break
    else:
        raise ValueError("truncated PNG")
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    w, h, n = head[0], head[1], _CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(w, n), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line += above
        elif kind:  # these two depend on what has just been restored
            line = np.frombuffer(_restored(line.tobytes(), above.tobytes(), n, kind), np.uint8)
        out[y] = above = line
    return out.reshape(h, w, n)


def read_png_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(path, h, w, channels, pixels): all PNG files of a folder; those that can't be read have null sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for path, content in zip(p.path, p.content, strict=True):
                try:
                    a = decode_png(bytes(content))
                    rows.append((path, *a.shape, a.tobytes()))
                except (ValueError, zlib.error):
                    rows.append((path, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "channels", "pixels"]).astype({"h": "Int32", "w": "Int32", "channels": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, h int, w int, channels int, pixels binary")


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class RawVideoReader(DataSourceReader):
    """Frames of planar raw video (YUV4MPEG2) by index ranges; every partition seeks to its own frames."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("framesPerPartition", "64"))
        with open(self.path, "rb") as f:
            line = f.readline().decode("ascii").split()
        if not line or line[0] != "YUV4MPEG2":
            raise ValueError("not raw video")
        tags = {t[0]: t[1:] for t in line[1:]}
        self.w, self.h, self.colour = int(tags["W"]), int(tags["H"]), tags.get("C", "420")
        if not self.colour.startswith(("420", "444", "mono")):
            raise ValueError(f"unsupported layout {self.colour}")
        self.head = len(" ".join(line)) + 1
        luma = self.w * self.h
        self.size = luma if self.colour.startswith("mono") else 3 * luma if self.colour.startswith("444") else luma + 2 * ((self.w + 1) // 2) * ((self.h + 1) // 2)

    def _count(self) -> int:
        import os

        return (os.path.getsize(self.path) - self.head) // (self.size + 6)

    def partitions(self) -> list[InputPartition]:
        n = self._count()
        return [_Range(a, min(a + self.step, n)) for a in range(0, n, self.step)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            for i in range(part.lo, part.hi):
                f.seek(self.head + i * (self.size + 6))
                if f.read(6) != b"FRAME\n":
                    raise ValueError(f"frame {i} has parameters of its own")
                yield i, self.h, self.w, f.read(self.w * self.h)


class RawVideo(DataSource):
    """``spark.read.format("rawvideo").option("path", ...)``: (frame, h, w, luma). The file must be where all executors see it."""

    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return "frame int, h int, w int, luma binary"

    def reader(self, schema) -> RawVideoReader:
        return RawVideoReader(self.options)
