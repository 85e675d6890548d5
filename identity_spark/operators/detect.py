"""Raw model outputs to boxes: person detections, anchors and faces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.vectors import sigmoid
from ..params import DEFAULTS, Params

FACE_TARGET = 640


def decode_detections(raw: DataFrame, target_class: int = 0, params: Params = DEFAULTS) -> DataFrame:
    """Adds class_id, confidence and box x1..y2 of the rows whose best class is the target, above the threshold."""
    scores = raw.withColumn("_scores", F.transform("logits", lambda x: sigmoid(x.cast("double"))))
    scores = scores.withColumn("confidence", F.array_max("_scores"))
    scores = scores.withColumn("class_id", (F.array_position("_scores", F.col("confidence")) - 1).cast("int")).drop("_scores")
    kept = scores.filter((F.col("confidence") > params.detect_confidence) & (F.col("class_id") == target_class))
    b = boxes.from_centre(F.col("box"), F.col("frame_w"), F.col("frame_h"))
    return kept.withColumn("_b", b).select("*", "_b.*").drop("_b")


def crops(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds crop (whole-pixel rectangle inside the frame) and embeddable, from x1..y2, frame_w and frame_h."""
    out = rows.withColumn("crop", boxes.crop_rect(boxes.box(), F.col("frame_w"), F.col("frame_h")))
    return out.withColumn("embeddable", boxes.embeddable(F.col("crop"), params.min_crop_side))


def anchor_grid(strides: DataFrame, size: int = FACE_TARGET) -> DataFrame:
    """Adds anchor_idx and its point (ax, ay) for every cell of each row's stride, row by row of the grid."""
    side = F.expr(f"{size} div stride")
    grid = strides.withColumn("anchor_idx", F.explode(F.sequence(F.lit(0), side * side - 1)))
    return with_anchors(grid, size)


def with_anchors(rows: DataFrame, size: int = FACE_TARGET) -> DataFrame:
    """Adds the point (ax, ay) of each row's anchor."""
    side = F.expr(f"{size} div stride")
    return rows.withColumns({"ax": F.col("anchor_idx") % side * F.col("stride"), "ay": F.floor(F.col("anchor_idx") / side) * F.col("stride")})


def decode_faces(raw: DataFrame, scale: float = 1.0, pad_x: int = 0, pad_y: int = 0, params: Params = DEFAULTS) -> DataFrame:
    """Adds score, x1..y2 and landmarks of the anchors whose score reaches the threshold; strides are just rows."""
    raw = with_anchors(raw).withColumn("score", F.sqrt(sigmoid(F.col("cls")) * sigmoid(F.col("obj")))).filter(F.col("score") >= params.face_conf_threshold)
    at = lambda i: F.element_at("bbox", i)
    raw = raw.withColumns({
        "_cx": (F.col("ax") + at(1) * F.col("stride") - pad_x) / scale, "_cy": (F.col("ay") + at(2) * F.col("stride") - pad_y) / scale,
        "_w": F.exp(at(3)) * F.col("stride") / scale, "_h": F.exp(at(4)) * F.col("stride") / scale,
    })
    point = lambda i: F.struct(((F.col("ax") + F.element_at("kps", 2 * i + 1) * F.col("stride") - pad_x) / scale).alias("x"), ((F.col("ay") + F.element_at("kps", 2 * i + 2) * F.col("stride") - pad_y) / scale).alias("y"))
    return raw.withColumns({
        "x1": F.col("_cx") - F.col("_w") / 2, "y1": F.col("_cy") - F.col("_h") / 2, "x2": F.col("_cx") + F.col("_w") / 2, "y2": F.col("_cy") + F.col("_h") / 2,
        "landmarks": F.array(*[point(i) for i in range(5)]),
    }).drop("_cx", "_cy", "_w", "_h")


def clip_faces(faces: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """x, y, w, h in whole pixels inside the frame, without faces narrower or lower than the least side."""
    cut = faces.withColumn("_c", boxes.crop_rect(boxes.box(), F.col("frame_w"), F.col("frame_h")))
    out = cut.withColumns({"x": F.col("_c.x1"), "y": F.col("_c.y1"), "w": F.col("_c.x2") - F.col("_c.x1"), "h": F.col("_c.y2") - F.col("_c.y1")}).drop("_c")
    return out.filter((F.col("w") >= params.min_face_side) & (F.col("h") >= params.min_face_side))


def suppressed(b: np.ndarray, score: np.ndarray, seq: np.ndarray, most: float) -> np.ndarray:
    """Places of the boxes that greedy non-maximum suppression keeps, best first; ties by seq."""
    order = np.lexsort((seq, -score))
    area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    kept: list[int] = []
    while len(order):
        i, order = order[0], order[1:]
        kept.append(i)
        w = np.maximum(0, np.minimum(b[i, 2], b[order, 2]) - np.maximum(b[i, 0], b[order, 0]))
        h = np.maximum(0, np.minimum(b[i, 3], b[order, 3]) - np.maximum(b[i, 1], b[order, 1]))
        both = w * h
        order = order[~((both > 0) & (both / np.maximum(area[i] + area[order] - both, 1e-12) > most))]
    return np.array(kept, int)


def nms_faces(faces: DataFrame, frame: list[str], seq: str, params: Params = DEFAULTS) -> DataFrame:
    """The rows that suppression keeps in each frame. Frames are small and many, so a sorted partition is walked through."""
    names = faces.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[frame] == rows[frame].iloc[-1]).all(axis=1).to_numpy()
            cut = len(rows) - int(last[::-1].argmin() if not last.all() else len(rows))
            rest = rows.iloc[cut:].reset_index(drop=True)
            if cut:
                yield keep(rows.iloc[:cut].reset_index(drop=True))
        if rest is not None and len(rest):
            yield keep(rest)

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        b, score, order = rows[list(boxes.EDGES)].to_numpy(float), rows["score"].to_numpy(float), rows[seq].to_numpy()
        starts = np.flatnonzero(np.r_[True, (rows[frame].to_numpy()[1:] != rows[frame].to_numpy()[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(rows)]
        kept = [s + suppressed(b[s:e], score[s:e], order[s:e], params.face_nms_threshold) for s, e in zip(starts, ends, strict=True)]
        return rows.iloc[np.sort(np.concatenate(kept))][names]

    return faces.repartition(*frame).sortWithinPartitions(*frame, seq).mapInPandas(walk, faces.schema)
