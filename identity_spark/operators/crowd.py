"""Pairs of boxes of a frame that may overlap, also where a frame is full of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..shared import checkpointed, small

FRAME = ["camera_id", "frame_idx"]
#: Frames with more boxes on a side are cut into cells.
CROWD = 500
#: Cells of a frame in each direction, at most.
CELLS = 256


def crowded_frames(left: DataFrame, box: str, most: int) -> DataFrame:
    """camera_id, frame_idx and cell (its size) of frames with more than ``most`` boxes: the mean side of a box, but no less
    than a part of CELLS of what the boxes span."""
    b = F.col(box)
    side = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"])
    span = F.greatest(F.max(b["x2"]) - F.min(b["x1"]), F.max(b["y2"]) - F.min(b["y1"])) / CELLS
    sizes = left.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_n"), F.greatest(F.avg(side), span, F.lit(1.0)).alias("_cell"))
    return sizes.filter(F.col("_n") > most).select(*FRAME, "_cell")


def _cells(rows: DataFrame, box: str) -> DataFrame:
    """Each row once for every cell that its box touches; boxes with an end before their beginning touch none."""
    b, place = F.col(box), lambda edge: F.floor(edge / F.col("_cell"))
    run = lambda a, z: F.sequence(place(a), place(z))
    whole = rows.filter((b["x1"] <= b["x2"]) & (b["y1"] <= b["y2"]))
    return whole.withColumn("_cx", F.explode(run(b["x1"], b["x2"]))).withColumn("_cy", F.explode(run(b["y1"], b["y2"])))


def pairs_in_frames(left: DataFrame, right: DataFrame, a: str, b: str, crowd: int = CROWD) -> DataFrame:
    """Rows of both sides of one frame, joined; in crowded frames those alone whose boxes have a point in common.

    a, b: columns with the boxes, structs of x1..y2; a point is a box whose edges are equal. Frames with up to ``crowd``
    boxes on the left are joined whole. A larger one is cut into cells, rows meet in equal cells, and a pair comes from
    the cell that the corner of what they share lies in, so from one; its cells are dealt out over all tasks."""
    crowded = checkpointed(crowded_frames(left, a, crowd))
    if crowded.isEmpty():
        return left.join(right, FRAME)
    crowded = small(crowded)
    usual = left.join(crowded, FRAME, "left_anti").join(right, FRAME)
    names = [*left.columns, *[c for c in right.columns if c not in FRAME]]
    far = _cells(left.join(crowded, FRAME), a).join(_cells(right.join(crowded, FRAME), b).drop("_cell"), [*FRAME, "_cx", "_cy"])
    corner = lambda e: F.floor(F.greatest(F.col(a)[e], F.col(b)[e]) / F.col("_cell"))
    return usual.select(*names).unionByName(far.filter((F.col("_cx") == corner("x1")) & (F.col("_cy") == corner("y1"))).select(*names))


def point(p: Column) -> Column:
    """A struct of x and y as a box without size."""
    return F.struct(*[p[e[0]].cast("double").alias(e) for e in boxes.EDGES])
