"""Near-duplicate identities: candidates, roots of chains, and the tables after a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from ..shared import checkpointed
from .match import all_top1_sims, centroids, top1_per_group

GID = ["camera_id", "global_id"]


def merge_candidates(gallery: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """camera_id, source, target, score: each identity's nearest older one by centroid, if near enough; the first of equal ones."""
    c = centroids(gallery)
    pairs = all_top1_sims(c.withColumnRenamed("global_id", "source"), c, query="source", least=params.gid_merge_threshold, older=True)
    near = pairs.filter(F.col("score") >= params.gid_merge_threshold)
    return top1_per_group(near, ["camera_id", "source"], "score", "global_id").select("camera_id", "source", F.col("global_id").alias("target"), "score")


def roots(edges: DataFrame) -> DataFrame:
    """camera_id, source, target with every target a root: pointers jump until none moves. edges: a target a source, older than it.

    A chain of n links takes log2(n) rounds; each round is an equi join, written so that its lineage ends."""
    now = checkpointed(edges.select("camera_id", "source", "target"))
    while True:
        up = now.select("camera_id", F.col("source").alias("target"), F.col("target").alias("_up"))
        jumped = now.join(up, ["camera_id", "target"], "left").select("camera_id", "source", F.coalesce("_up", "target").alias("target"), F.col("_up").isNotNull().alias("_moved"))
        now = checkpointed(jumped)
        if not now.filter("_moved").limit(1).count():
            return now.drop("_moved")
        now = now.drop("_moved")


def remap_gids(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """Rows with the identity that theirs went over into."""
    out = rows.join(remap.select("camera_id", F.col("source").alias("global_id"), F.col("target").alias("_t")), GID, "left")
    return out.withColumn("global_id", F.coalesce("_t", "global_id")).select(*rows.columns)


def merge_state(state: DataFrame, remap: DataFrame) -> DataFrame:
    """last_seen (the later one) and box (the target's, or else the last source's that has one) after a merge."""
    out = state.join(remap.select("camera_id", F.col("source").alias("global_id"), F.col("target").alias("_t")), GID, "left")
    out = out.withColumns({"_own": F.col("_t").isNull(), "_order": F.col("global_id"), "global_id": F.coalesce("_t", "global_id")})
    has = F.col("x1").isNotNull()
    best = F.max_by(F.struct("x1", "y1", "x2", "y2"), F.when(has, F.struct(F.col("_own").cast("int"), -F.col("_order"))))
    return out.groupBy(*GID).agg(F.max("last_seen").alias("last_seen"), best.alias("_b")).select(*GID, "last_seen", "_b.*")
