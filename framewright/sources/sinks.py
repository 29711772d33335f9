"""Sinks: staged writes, and PNG frames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framewright.sources.frames import encode_png


def promote(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside ``path`` and swap it in by renames of the file system that holds it; what was there goes last.

    Readers see the old table, none between the two renames, or the whole new one; never a part.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    part, old = f"{path}.partial-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(part)
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(make(path)) and not fs.rename(make(path), make(old)):
        raise OSError(f"can't move {path} away")
    if not fs.rename(make(part), make(path)):
        fs.rename(make(old), make(path))
        raise OSError(f"can't move {part} to {path}")
    fs.delete(make(old), True)


def png_frames(cells: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """(frame, png) from (frame, y, x, value 0..255); cells that are absent are 0. A frame's cells meet in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((height, width), np.uint8)
        grid[pdf.y, pdf.x] = pdf[value].clip(0, 255)
        return pd.DataFrame({"frame": [int(pdf.frame.iloc[0])], "png": [encode_png(grid)]})

    return cells.select("frame", "y", "x", value).groupBy("frame").applyInPandas(run, "frame int, png binary")


def pack_masks(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, bits): a mask's cells as packed bits, for spilling."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for ys, xs in zip(p.y, p.x, strict=True):
                grid = np.zeros((height, width), bool)
                grid[np.array(ys, int), np.array(xs, int)] = True
                out.append(np.packbits(grid).tobytes())
            yield pd.DataFrame({"frame": p.frame, "bits": out})

    from pyspark.sql import functions as F

    return cells.groupBy("frame").agg(F.collect_list("y").alias("y"), F.collect_list("x").alias("x")).mapInPandas(run, "frame int, bits binary")
