"""Arrays, label maps and stroke documents that other programs wrote, each with what is wrong with it.

Files of no bytes have no row: the file source skips them, so that their frames are missing ones.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources.frames import read_png_frames

#: A frame's number is the last one in its file's name.
_NUMBER = r"(\d+)\D*$"


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def frame_number(path: str = "path"):
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return F.regexp_extract(F.regexp_replace(name, r"\.[^.]*$", ""), _NUMBER, 1).try_cast("int")


def read_arrays(spark: SparkSession, folder: str, pattern: str = "*.npy", kinds: str = "f", shape: tuple[int, ...] | None = None, member: str | None = None) -> DataFrame:
    """(path, frame, shape, kind, data, problem) of array files; of archives (.npz) the named member, or the only one.

    ``kinds`` are the allowed kinds of numbers ('f', 'u', 'i'). Floats come as little-endian float32,
    others as they are, row by row. What can't be read, is of another kind or shape, or isn't finite
    has null data and says why; nothing stored as Python objects is ever loaded.
    """

    def load(content: bytes) -> tuple:
        try:
            a = np.load(io.BytesIO(content), allow_pickle=False)
            if isinstance(a, np.lib.npyio.NpzFile):
                name = member or (a.files[0] if len(a.files) == 1 else "")
                if name not in a.files:
                    return None, None, None, "member"
                a = a[name]
        except (ValueError, EOFError, OSError, zipfile.BadZipFile):
            return None, None, None, "unreadable"
        if a.dtype.kind not in kinds:
            return list(a.shape), a.dtype.name, None, "kind"
        if shape is not None and a.shape != shape:
            return list(a.shape), a.dtype.name, None, "shape"
        if a.dtype.kind == "f" and not np.isfinite(a).all():
            return list(a.shape), a.dtype.name, None, "not finite"
        return list(a.shape), a.dtype.name, np.ascontiguousarray(a, "<f4" if a.dtype.kind == "f" else a.dtype.newbyteorder("<")).tobytes(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, *load(bytes(c))) for p, n, c in zip(b["path"], b["frame"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "frame", "shape", "kind", "data", "problem"]).astype({"frame": "Int32"})

    files = _files(spark, folder, pattern).select("path", frame_number().alias("frame"), "content")
    return files.mapInPandas(run, "path string, frame int, shape array<int>, kind string, data binary, problem string")


def cells_of(arrays: DataFrame) -> DataFrame:
    """(frame, y, x, d) of two-dimensional float arrays without a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, (h, w), data in zip(b["frame"], b["shape"], b["data"], strict=True):
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                yield pd.DataFrame({"frame": np.full(h * w, frame, np.int32), "y": y, "x": x, "d": np.frombuffer(data, "<f4").astype(float)})

    good = arrays.where("problem is null and size(shape) = 2 and kind like 'float%' and frame is not null")
    return good.select("frame", "shape", "data").mapInPandas(run, "frame int, y int, x int, d double")


def read_labels(spark: SparkSession, folder: str, most: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """(path, frame, h, w, pixels, problem) of label maps: grey PNG files with labels 0..most."""
    png = read_png_frames(spark, folder)
    top = F.udf(lambda p: max(p, default=0) if p is not None else None, "int")  # one call a file
    wrong = F.lit(False) if shape is None else (F.col("h") != shape[0]) | (F.col("w") != shape[1])
    problem = F.when(F.col("h").isNull(), "unreadable").when(F.col("channels") != 1, "channels").when(wrong, "shape").when(top("pixels") > most, "label")
    return png.select("path", frame_number().alias("frame"), "h", "w", "pixels", problem.alias("problem"))


STROKES = "frame_index int, width int, height int, source struct<vectorize_hash: string>, prev_sha256 string, strokes array<struct<track_id: int, type: string, closed: boolean, groups: array<string>, points: array<array<double>>, anchor: int, strength: double>>"


def read_strokes(spark: SparkSession, folder: str, width: int, height: int, params: str) -> DataFrame:
    """(path, frame, sha, strokes, problem) of stroke documents, one file a frame.

    A document must name its own frame, this size and these parameters, and the hash of the document
    of the frame before it, unless there is none (then null); of several problems the first is told.
    """
    doc = F.from_json(F.col("content").cast("string"), STROKES).alias("doc")
    files = _files(spark, folder, "*.json").select("path", frame_number().alias("frame"), F.sha2("content", 256).alias("sha"), doc)
    before = files.groupBy((F.col("frame") + 1).alias("frame")).agg(F.min("sha").alias("before"))
    d = F.col("doc")
    no = lambda test: ~F.coalesce(test, F.lit(False))
    problem = (
        F.when(d["strokes"].isNull(), "unreadable")
        .when(no(d["frame_index"] == F.col("frame")), "frame")
        .when(no((d["width"] == width) & (d["height"] == height)), "size")
        .when(no(d["source"]["vectorize_hash"] == params), "parameters")
        .when(~d["prev_sha256"].eqNullSafe(F.col("before")), "chain")
    )
    return files.join(before, "frame", "left").select("path", "frame", "sha", d["strokes"].alias("strokes"), problem.alias("problem"))


def folder_size(spark: SparkSession, folders: dict[str, str], pattern: str = "*") -> DataFrame:
    """(name, files, bytes) of everything below each named folder, from the listing alone."""
    parts = [spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(f).select(F.lit(n).alias("name"), "length") for n, f in folders.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
