"""Queries over the sinks' own formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.registry import query
from framewright.sources.sinks import pack_masks, png_frames
from framewright.sources.views import HEIGHT, WIDTH, gmap


@query("frame_pngs")
def frame_pngs(spark, sf_dir):
    p = png_frames(gmap(spark, sf_dir).withColumn("ink", F.col("g") * 80), "ink", HEIGHT, WIDTH)
    return p.select("frame", F.length("png").alias("bytes"), F.sha2("png", 256).alias("sha"))


@query("packed_masks")
def packed_masks(spark, sf_dir):
    return pack_masks(gmap(spark, sf_dir).where("g = 2"), HEIGHT, WIDTH).select("frame", F.hex("bits").alias("bits"))
