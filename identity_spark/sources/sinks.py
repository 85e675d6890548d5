"""Identity messages, lookup results and crops as rows ready for a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACK_FIELDS = ["tracker_id", "global_id", "bbox", "confidence", "match_score", "match_type"]


def identity_messages(tracks: DataFrame) -> DataFrame:
    """camera_id, frame_idx, stamp and value (JSON): a message a frame, with [] for frames without tracks.

    tracks: the fields of a track, its null track for an empty frame, det_seq for the order."""
    bbox = F.array(*[F.col(e).cast("int") for e in ("x1", "y1", "x2", "y2")])
    fields = [bbox.alias("bbox") if f == "bbox" else F.col(f) for f in TRACK_FIELDS]
    own = F.when(F.col("tracker_id").isNotNull(), F.struct("det_seq", F.struct(*fields).alias("t")))
    frames = tracks.groupBy("camera_id", "frame_idx", "stamp").agg(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["t"]).alias("tracks"))
    return frames.select("camera_id", "frame_idx", "stamp", F.to_json(F.struct("stamp", "frame_idx", "tracks")).alias("value"))


def find_result_messages(results: DataFrame) -> DataFrame:
    """request_id and value (JSON) of lookup results."""
    return results.select("request_id", F.to_json(F.struct("request_id", "global_id", "track_id", "score", "method")).alias("value"))


def write_messages(messages: DataFrame, path: str) -> None:
    """The values of messages as lines of text files, which :func:`identity_spark.sources.messages.message_files` reads."""
    messages.select("value").write.mode("append").text(path)


def crop_path(root: str, gid: Column, frame: Column, face: bool = False, there: Column | None = None) -> Column:
    """Path of a crop below ``root``; "" where dumping is off (no root) or the crop is empty."""
    if not root:
        return F.lit("")
    path = F.format_string(root.replace("%", "%%") + ("/face" if face else "") + "/gid%04d_f%07d.jpg", gid, frame)
    return path if there is None else F.when(there, path).otherwise("")


def write_crops(crops: DataFrame, root: str, path: str, face: bool = False) -> None:
    """Crops as a table by camera: paths and bytes; one file a crop would swamp a file system."""
    there = F.length(F.coalesce("crop", F.lit(b""))) > 0
    crops.withColumn("crop_path", crop_path(root, F.col("global_id"), F.col("frame_idx"), face, there)).write.partitionBy("camera_id").mode("append").parquet(path)


def crop_names(paths: DataFrame, path: str = "path") -> DataFrame:
    """Adds global_id, frame_idx and kind (body, face) of crops by their paths; rows of other paths are left out."""
    part = lambda n: F.regexp_extract(path, r"gid(\d+)_f(\d+)\.jpg$", n)
    named = paths.filter(F.col(path).rlike(r"gid\d+_f\d+\.jpg$"))
    return named.withColumns({"global_id": part(1).cast("long"), "frame_idx": part(2).cast("long"), "kind": F.when(F.col(path).rlike(r"(^|/)face/[^/]*$"), "face").otherwise("body")})


def read_gallery_crops(spark: SparkSession, root: str) -> DataFrame:
    """global_id, frame_idx, kind, path and bytes of a folder of crops."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(root)
    return crop_names(files.select("path", F.col("content").alias("crop")))


def pruned_crops(crops: DataFrame, gallery: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to delete, to keep): crops whose entry is gone from the gallery, and the others."""
    key = ["camera_id", "crop_path"]
    return crops.join(gallery.select(*key), key, "left_anti"), crops.join(gallery.select(*key), key, "left_semi")


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """frame_idx (the last number in the file's name) and bytes of a folder of stills."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d+)\D*$", 1).cast("long").alias("frame_idx"), F.col("content").alias("frame"), "path")


def target_class_id(labels: DataFrame, label: str = "person") -> DataFrame:
    """One row: class_id of the label (the least number if several have it), 0 if none; labels: id2label MAP<STRING,STRING>."""
    pairs = labels.select(F.explode("id2label").alias("id", "name")).filter(F.lower("name") == label)
    return pairs.agg(F.coalesce(F.min(F.col("id").cast("int")), F.lit(0)).alias("class_id"))


def largest_person(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """Box of the largest track of each frame, the first of equal ones; the whole frame where there is none."""
    from ..functions import boxes

    best = tracks.groupBy("camera_id", "frame_idx").agg(F.max_by(boxes.box(), F.struct(boxes.area(boxes.box()).alias("a"), -F.col("tracker_id"))).alias("_b"))
    out = frames.join(best, ["camera_id", "frame_idx"], "left")
    whole = {"x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.col("frame_w").cast("double"), "y2": F.col("frame_h").cast("double")}
    return out.withColumns({e: F.coalesce(F.col(f"_b.{e}"), v) for e, v in whole.items()}).drop("_b")
