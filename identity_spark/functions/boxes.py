"""Boxes are four columns or a struct of x1, y1, x2, y2, in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _zero() -> Column:
    return F.lit(0.0)

EDGES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> Column:
    """The struct of four columns with a prefix."""
    return F.struct(*[F.col(prefix + e).alias(e) for e in EDGES])


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the boxes share no area."""
    w = F.greatest(_zero(), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(_zero(), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = w * h
    return F.when(both == 0, _zero()).otherwise(both / (area(a) + area(b) - both))


def truncated(b: Column) -> Column:
    """Edges as whole numbers, towards zero."""
    return F.struct(*[b[e].cast("int").alias(e) for e in EDGES])


def crop_rect(b: Column, frame_w: Column, frame_h: Column) -> Column:
    """The part of the frame that a box cuts out, in whole pixels, with its size and whether it is empty."""
    t = truncated(b)
    x1, y1 = F.greatest(F.lit(0), t["x1"]), F.greatest(F.lit(0), t["y1"])
    x2, y2 = F.least(frame_w, t["x2"]), F.least(frame_h, t["y2"])
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.greatest(F.lit(0), x2 - x1).alias("w"), F.greatest(F.lit(0), y2 - y1).alias("h"), ((x2 <= x1) | (y2 <= y1)).alias("is_empty"))


def embeddable(crop: Column, least: int) -> Column:
    """Whether a crop is large enough for a body model."""
    return F.coalesce(~crop["is_empty"] & (crop["w"] >= least) & (crop["h"] >= least), F.lit(False))


def from_centre(b: Column, frame_w: Column, frame_h: Column) -> Column:
    """Box of an array (cx, cy, w, h) in parts of the frame, clipped to the frame."""
    clip = lambda v, most: F.least(F.greatest(v, _zero()), most.cast("double"))
    at = lambda i: F.element_at(b, i)
    return F.struct(
        clip((at(1) - at(3) / 2) * frame_w, frame_w).alias("x1"), clip((at(2) - at(4) / 2) * frame_h, frame_h).alias("y1"),
        clip((at(1) + at(3) / 2) * frame_w, frame_w).alias("x2"), clip((at(2) + at(4) / 2) * frame_h, frame_h).alias("y2"),
    )


def face_centre(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Centre of a face in whole pixels."""
    return F.struct((x + F.floor(w / 2)).alias("x"), (y + F.floor(h / 2)).alias("y"))


def letterbox(w: Column, h: Column, target_w: int, target_h: int, centred: bool) -> Column:
    """Scale, size and padding of a frame that is fitted into a target; not centred: padding is right and below only."""
    scale = F.least(F.lit(target_w) / w, F.lit(target_h) / h)
    nw, nh = F.floor(w * scale).cast("int"), F.floor(h * scale).cast("int")
    pad = lambda t, n: F.floor((F.lit(t) - n) / 2).cast("int") if centred else F.lit(0)
    return F.struct(scale.alias("scale"), nw.alias("nw"), nh.alias("nh"), pad(target_w, nw).alias("pad_x"), pad(target_h, nh).alias("pad_y"))
