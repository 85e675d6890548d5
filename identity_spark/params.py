"""The settings of all operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

NONE, UPPER_BODY, FULL_BODY = 0, 1, 2
#: Names of the pose qualities; an unknown name means UPPER_BODY.
QUALITIES = {"none": NONE, "upper_body": UPPER_BODY, "full_body": FULL_BODY}
FACE_STRATEGIES = ("face_only_top1", "face_top1_dino_top1_avg", "face_body_all_gallery", "face_body_face_gallery")


@dataclass(frozen=True)
class Params:
    """Thresholds are inclusive unless said otherwise."""

    detect_confidence: float = 0.5  # kept above it
    sim_threshold: float = 0.82
    gid_merge_threshold: float = 0.90  # 1.0 switches merging off
    emb_novelty_threshold: float = 0.85  # novel below it
    keyframe_min_interval: int = 60
    match_rate_threshold: float = 0.40  # novel below it
    max_gallery_per_gid: int = 10
    match_strategy: str = "top1"  # or "centroid"
    iou_gate_threshold: float = 0.0  # 0 switches the gate off; identities below it are left out
    stable_iou_threshold: float = 0.70
    stable_min_frames: int = 5
    pending_confirm_frames: int = 5
    pose_conf_threshold: float = 0.50
    pose_min_quality: str = "upper_body"
    pose_iou_match_min: float = 0.30
    face_conf_threshold: float = 0.65
    face_nms_threshold: float = 0.3  # a face is dropped above it
    face_keyframe_threshold: float = 0.95  # a face is not added from here on
    face_sim_threshold: float = 0.35
    max_face_gallery_per_gid: int = 10
    face_match_strategy: str = "face_top1_dino_top1_avg"
    min_face_side: int = 10
    min_crop_side: int = 4
    keypoints_per_crop: int = 1024
    count_empty_frames: bool = False
    forbid_shared_merge: bool = False  # True: a new identity never merges into one that is active in its frame

    def __post_init__(self) -> None:
        if self.match_strategy not in ("top1", "centroid"):
            raise ValueError(f"unknown match strategy {self.match_strategy!r}")
        if self.face_match_strategy not in FACE_STRATEGIES:
            raise ValueError(f"unknown face match strategy {self.face_match_strategy!r}")

    @property
    def least_quality(self) -> int:
        return QUALITIES.get(self.pose_min_quality, UPPER_BODY)


DEFAULTS = Params()
