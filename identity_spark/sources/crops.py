"""A store of crops: immutable parts by camera, and a manifest that says which of them count.

A change writes new parts first and then appends its version's rows to the manifest in one file. So a change that fails
before that, wherever, leaves the store as it was, and a reader sees one version or the next, never some of both. Pruning
rewrites the cameras that lose a crop and no others. One writer at a time."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, small
from .sinks import pruned_crops

CROPS = "global_id long, frame_idx long, kind string, crop_path string, crop binary, part string, camera_id long"
MANIFEST = "version long, camera_id long, part string"


class CropStore:
    """Crops (camera_id, global_id, frame_idx, kind, crop_path, crop) in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    @property
    def versions(self) -> DataFrame:
        """camera_id and part of each version; a version lists all that counts in it."""
        return self._table("manifest", MANIFEST)

    @property
    def version(self) -> int:
        """The latest one, 0 for a store that nothing was written to."""
        return self.versions.agg(F.max("version")).first()[0] or 0

    def _listed(self, version: int | None) -> DataFrame:
        return self.versions.filter(F.col("version") == (self.version if version is None else version)).filter("part IS NOT NULL").select("camera_id", "part")

    def read(self, version: int | None = None) -> DataFrame:
        """The crops of the latest version, or of an earlier one whose parts are still there."""
        return self._table("data", CROPS).join(small(self._listed(version)), ["part", "camera_id"], "left_semi").drop("part")

    def _written(self, crops: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows = crops.select("global_id", "frame_idx", "kind", "crop_path", "crop", F.lit(part).alias("part"), "camera_id")
        rows.write.partitionBy("part", "camera_id").mode("append").parquet(f"{self.path}/data")
        return part

    def _commit(self, listed: DataFrame) -> int:
        """A version of these parts; one row without a part where there is none, as a version has rows."""
        version = self.version + 1
        marked = listed.unionByName(self.spark.range(1).select(F.lit(None).cast("long").alias("camera_id"), F.lit(None).cast("string").alias("part")))
        # one small row for each camera and part, in one file, which appears as a whole
        checkpointed(marked.select(F.lit(version).cast("long").alias("version"), "camera_id", "part")).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return version

    def add(self, crops: DataFrame) -> int:
        """Crops that aren't empty, beside those that are there; gives the new version."""
        kept = crops.filter(F.length("crop") > 0)
        part = self._written(kept)
        new = self._table("data", CROPS).filter(F.col("part") == part).select("camera_id", "part").distinct()
        return self._commit(self._listed(None).unionByName(new))

    def prune(self, gallery: DataFrame) -> int:
        """Leaves out crops whose entry (camera_id, crop_path) is gone from the gallery; gives the version, a new one only
        if something went."""
        now = self.read()
        gone, kept = pruned_crops(now.select("camera_id", "crop_path"), gallery)
        cameras = checkpointed(gone.select("camera_id").distinct())
        if cameras.isEmpty():
            return self.version
        part = self._written(now.join(small(cameras), "camera_id", "left_semi").join(kept.distinct(), ["camera_id", "crop_path"], "left_semi"))
        left = self._listed(None).join(small(cameras), "camera_id", "left_anti")
        new = self._table("data", CROPS).filter(F.col("part") == part).select("camera_id", "part").distinct()
        return self._commit(left.unionByName(new))

    def unlisted(self, since: int) -> DataFrame:
        """part and camera_id of folders that no version from ``since`` on lists: those of failed changes and of older
        versions, which may be deleted once nothing reads these."""
        listed = self.versions.filter(F.col("version") >= since).select("part", "camera_id").distinct()
        return self._table("data", CROPS).select("part", "camera_id").distinct().join(listed, ["part", "camera_id"], "left_anti")
