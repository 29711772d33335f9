"""Strokes to what is drawn: cut at the frame's edge, smoothed, simplified, splined, run on over the edge, rasterised."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import draw, kernels
from framewright.plans.polyline import strokes as fixture_strokes
from framewright.registry import query
from framewright.sources.frames import encode_png

PIECES = "piece int, closed boolean, on_edge boolean, points array<struct<x double, y double>>"


@dataclasses.dataclass(frozen=True)
class Pen:
    """Lengths are output cells; ``scale`` leads from frame to output."""

    scale: float = 1.0
    width: float = 4.0
    smooth: float = 5.0
    step: float = 1.0
    epsilon: float = 2.8
    tension: float = 0.5
    steps: int = 4
    tolerance: float = 0.03
    draw_edge: bool = False
    fine: int = 3
    ink: tuple[int, int, int] = (0, 0, 0)
    paper: tuple[int, int, int] = (255, 255, 255)


def stroke_pieces(p: np.ndarray, closed: bool, width: int, height: int, pen: Pen) -> list[tuple[bool, bool, np.ndarray]]:
    """(closed, on the edge, points) of a stroke's pieces, in output cells rounded to hundredths.

    Runs on the frame's edge go (or stay as they are, with ``draw_edge``); pieces between them start
    and end at the crossing points and are drawn on past the canvas. Open lines that end where they
    start are closed ones. Fewer than two points are nothing.
    """
    if not closed and len(p) > 3 and (p[0] == p[-1]).all():
        closed, p = True, p[:-1]
    sides = draw.edge_sides(p, width, height)
    on = np.array([bool(s) for s in sides], bool)
    inside, along = draw.off_edge(on, closed)
    whole = not on.any()
    todo = [(list(range(len(p))), False, False, False)] if whole else [(i, a, b, False) for i, a, b in inside]
    if pen.draw_edge:
        todo += [(i, False, False, True) for i in along]
    out = []
    for at, cut0, cut1, edge in todo:
        if len(at) < 2:
            continue
        ring = closed and (whole or on.all())
        q = p[at] * pen.scale
        if not edge:
            q = draw.smooth(q, ring, pen.smooth, pen.step)
        if pen.epsilon > 0 and len(q) > 2:
            few = draw.simplify_ring(q, pen.epsilon) if ring else q[kernels.simplify(q, pen.epsilon)]
            q = few if len(few) >= (3 if ring else 2) else q
        line = q if edge else draw.spline(q, ring, pen.tension, pen.steps, pen.tolerance)
        if not pen.draw_edge:
            w, h = width * pen.scale, height * pen.scale
            if cut0:
                line = np.concatenate([[draw.run_on(q[0], q[0] - q[1], sides[at[0]], w, h, pen.width)], line])
            if cut1:
                line = np.concatenate([line, [draw.run_on(q[-1], q[-1] - q[-2], sides[at[-1]], w, h, pen.width)]])
        out.append((ring, edge, np.round(line, 2) + 0.0))
    return out


def pieces(strokes: DataFrame, keys: list[str], width: int, height: int, pen: Pen) -> DataFrame:
    """(keys, piece, closed, on_edge, points) of (keys, closed, points), by Arrow batches and without a shuffle.

    A stroke is the unit. Null or empty points have no pieces, null ``closed`` is open.
    """
    types = dict(strokes.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, closed, x, y in zip(b[keys].itertuples(index=False), b["closed"], b["xs"], b["ys"], strict=True):
                p = np.stack([np.asarray(x, float), np.asarray(y, float)], axis=1)
                if not len(p):
                    continue
                for i, (ring, edge, q) in enumerate(stroke_pieces(p, bool(closed), width, height, pen)):
                    rows.append((*key, i, ring, edge, [{"x": u, "y": v} for u, v in q.tolist()]))
            yield pd.DataFrame(rows, columns=[*keys, "piece", "closed", "on_edge", "points"])

    known = strokes.where("points is not null and not exists(points, q -> q.x is null or q.y is null)")
    flat = known.select(*keys, F.coalesce("closed", F.lit(False)).alias("closed"), F.transform("points", lambda q: q["x"]).alias("xs"), F.transform("points", lambda q: q["y"]).alias("ys"))
    return flat.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + f", {PIECES}")


def pictures(lines: DataFrame, width: int, height: int, pen: Pen) -> DataFrame:
    """(frame, ink, png) from (frame, closed, points), and optionally ``pass`` (from 0), ``opacity`` and ``widths``.

    Lines of a pass are united, passes lie over each other. ``ink`` is the sum of the shares of ink. A
    frame's lines meet in one task. Frames without lines have no row.
    """
    have = lines.columns
    lines = lines.select(
        "frame",
        (F.col("pass") if "pass" in have else F.lit(0)).cast("int").alias("pass"),
        (F.col("opacity") if "opacity" in have else F.lit(1.0)).cast("double").alias("opacity"),
        F.coalesce("closed", F.lit(False)).alias("closed"),
        F.transform("points", lambda q: q["x"]).alias("xs"),
        F.transform("points", lambda q: q["y"]).alias("ys"),
        (F.col("widths") if "widths" in have else F.transform("points", lambda q: F.lit(float(pen.width)))).alias("ws"),
    ).where("size(xs) > 0")
    shades = np.linspace(0, 1, 256)[:, None]
    table = np.rint(np.array(pen.paper) * (1 - shades) + np.array(pen.ink) * shades).astype(np.uint8)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        passes = []
        for _, same in sorted(pdf.groupby("pass"), key=lambda kv: kv[0]):
            rows = [(np.stack([np.asarray(x, float), np.asarray(y, float)], axis=1), np.asarray(w, float), bool(c)) for x, y, w, c in zip(*(same[c] for c in ("xs", "ys", "ws", "closed")), strict=True)]
            passes.append((float(same.opacity.max()), rows))
        share = draw.ink(passes, width, height, pen.fine)
        png = encode_png(table[np.rint(share * 255).astype(int)])
        return pd.DataFrame({"frame": [key[0]], "ink": [float(share.sum())], "png": [png]})

    return lines.groupBy("frame").applyInPandas(run, f"frame {dict(lines.dtypes)['frame']}, ink double, png binary")


#: The fixture's strokes lie within 50 cells of the origin; they are drawn on a canvas of 100 x 100.
CANVAS = 100
FIXTURE = Pen(width=2.0, smooth=2.0, epsilon=1.0)


def _on_canvas(spark, sf_dir) -> DataFrame:
    def clamp(v):
        return F.greatest(F.lit(0.5), F.least(F.lit(CANVAS - 0.5), F.floor(v + CANVAS / 2) + 0.5))

    return fixture_strokes(spark, sf_dir).select("stroke", "frame", (F.col("type") % 2 == 0).alias("closed"), F.transform("p", lambda q: F.struct(clamp(q["x"]).alias("x"), clamp(q["y"]).alias("y"))).alias("points"))


@query("drawn_pieces")
def drawn_pieces(spark, sf_dir):
    """All strokes cut, smoothed, simplified and splined."""
    out = pieces(_on_canvas(spark, sf_dir), ["stroke", "frame"], CANVAS, CANVAS, FIXTURE)
    return out.select("stroke", "piece", "closed", F.posexplode("points").alias("i", "q")).select("stroke", "piece", "closed", "i", "q.x", "q.y")


@query("drawn_frames")
def drawn_frames(spark, sf_dir):
    """A picture of each frame with all of its strokes, the second pass fainter."""
    p = pieces(_on_canvas(spark, sf_dir), ["stroke", "frame"], CANVAS, CANVAS, FIXTURE).withColumn("pass", F.col("stroke") % 2).withColumn("opacity", F.when(F.col("stroke") % 2 == 0, 1.0).otherwise(0.6))
    return pictures(p, CANVAS, CANVAS, FIXTURE).select("frame", F.round("ink", 6).alias("ink"), F.sha2("png", 256).alias("sha"))
