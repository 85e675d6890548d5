"""Names of qualities and texts of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import FULL_BODY, QUALITIES, UPPER_BODY


def quality_number(name: Column) -> Column:
    """Number of a quality's name; an unknown name counts as upper body."""
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in QUALITIES.items()], F.lit(UPPER_BODY))


def quality_letter(quality: Column) -> Column:
    return F.when(quality == FULL_BODY, "F").when(quality == UPPER_BODY, "U").otherwise("?")


def track_label(gid: Column, tid: Column, quality: Column, has_face: Column, match_type: Column, match_score: Column, face_sim: Column, buffered: Column, wanted: int) -> Column:
    """Text beside a track's box: its identity and match, how far its buffer is, or a question mark."""
    face = F.when(has_face, "f").otherwise("")
    match = F.when(match_type.isNull(), "").when(match_type == "NEW", " [NEW]").otherwise(F.format_string(" [%s %.2f]", match_type, F.bround(match_score, 2)))
    sim = F.when(face_sim >= -1.0, F.format_string(" fs:%.2f", F.bround(face_sim, 2))).otherwise("")
    known = F.concat(F.lit("G"), gid.cast("string"), F.lit(" T"), tid.cast("string"), F.lit(" "), quality_letter(quality), face, match, sim)
    waiting = F.concat(F.lit("buf"), buffered.cast("string"), F.lit(f"/{wanted} T"), tid.cast("string"), face)
    return F.when(gid.isNotNull(), known).when(buffered.isNotNull(), waiting).otherwise(F.concat(F.lit("? T"), tid.cast("string")))
