"""One camera's galleries and tracks as they go from frame to frame: the step that batch replay and stream share.

Everything is bounded by what is alive: a gallery has so many entries an identity, a buffer so many embeddings a track.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from ..params import DEFAULTS, UPPER_BODY, Params


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def most_central(vectors: list[np.ndarray]) -> int:
    """Place of the entry that is most alike the others on average, the first of equal ones."""
    m = np.stack(vectors)
    alike = m @ m.T
    return int(np.argmax((alike.sum(axis=1) - 1.0) / max(len(vectors) - 1, 1)))


def cosines(v: np.ndarray, vectors: Iterable[np.ndarray]) -> np.ndarray:
    m = np.stack(list(vectors))
    return m @ v / np.maximum(np.sqrt((m * m).sum(axis=1)) * np.sqrt(v @ v), 1e-12)


#: Galleries of more entries, which only those can be that came in above the cap, are searched by a pool.
POOL_FROM = 64

def capped(vectors: list[np.ndarray], most: int) -> list[int]:
    """Places of the entries that stay when the most central one, the first of equal ones, goes again and again.

    A mean of dot products is one product with the sum, so an entry that goes takes one product with each that stays."""
    m = np.stack(vectors)
    places, alike, live = np.arange(len(m)), m @ m.sum(axis=0), np.ones(len(m), bool)
    for _ in range(len(m) - most):
        k = int(np.argmax(alike))
        live[places[k]], v = False, m[k].copy()
        alike[k] = -np.inf
        alike -= m @ v
        if len(m) > 64 and 2 * np.count_nonzero(alike > -np.inf) < len(m):
            stay = alike > -np.inf
            m, places, alike = m[stay], places[stay], alike[stay]
    return np.flatnonzero(live).tolist()


class Pool:
    """Vectors in the order of arrival. Asking for the nearest or the most central one takes one product of each."""

    def __init__(self, vectors: list[np.ndarray]):
        self._take(np.stack(vectors))

    def __len__(self) -> int:
        return self.n

    def _take(self, m: np.ndarray) -> None:
        self.n = self.used = len(m)
        self.rows = np.concatenate([m, np.zeros((max(256, len(m) // 4), m.shape[1]))])
        self.norms = np.sqrt((self.rows * self.rows).sum(axis=1))
        self.out = np.zeros(len(self.rows))  # -inf where an entry has gone
        self.sum = m.sum(axis=0)

    def nearest(self, v: np.ndarray) -> float:
        u = self.used
        return float((self.rows[:u] @ v / np.maximum(self.norms[:u] * np.sqrt(v @ v), 1e-12) + self.out[:u]).max())

    def pop_most_central(self) -> int:
        """The place, among those that are there, of the entry that goes."""
        k = int(np.argmax(self.rows[: self.used] @ self.sum + self.out[: self.used]))
        place = int(np.count_nonzero(self.out[:k] == 0))
        self.sum = self.sum - self.rows[k]
        self.out[k], self.n = -np.inf, self.n - 1
        return place

    def add(self, v: np.ndarray) -> None:
        if self.used == len(self.rows):
            self._take(self.rows[self.out == 0])
        k = self.used
        self.rows[k], self.norms[k], self.sum = v, np.sqrt(v @ v), self.sum + v
        self.used, self.n = k + 1, self.n + 1


def pool_of(pools: dict[int, Pool], gid: int, own: list, vectors: Iterable[np.ndarray]) -> Pool:
    """The pool of an identity's entries, made anew where their number has changed beside it."""
    if gid not in pools or len(pools[gid]) != len(own):
        pools[gid] = Pool(list(vectors))
    return pools[gid]


@dataclass
class Entry:
    """An embedding in the body gallery."""

    vector: np.ndarray
    frame: int
    quality: int
    has_face: bool
    seq: int = 0


@dataclass
class BodyGallery:
    """Entries of each identity in the order of arrival; after adding, the most central one goes if there are too many."""

    params: Params = DEFAULTS
    entries: dict[int, list[Entry]] = field(default_factory=dict)
    last_seen: dict[int, int] = field(default_factory=dict)
    last_box: dict[int, np.ndarray] = field(default_factory=dict)
    pools: dict[int, Pool] = field(default_factory=dict)
    tops: dict[int, tuple[int, int, int]] = field(default_factory=dict)

    def top(self, gid: int) -> tuple[int, int]:
        """The last frame and the best quality of an identity's entries; kept while there are more of them than the cap, as
        then they are only added to or capped."""
        own = self.entries[gid]
        if len(own) <= max(POOL_FROM, self.params.max_gallery_per_gid):
            self.tops.pop(gid, None)
            return max(e.frame for e in own), max(e.quality for e in own)
        if gid not in self.tops or self.tops[gid][0] != len(own):
            self.tops[gid] = (len(own), max(e.frame for e in own), max(e.quality for e in own))
        return self.tops[gid][1:]

    def touch(self, gid: int, frame: int, box: np.ndarray | None) -> None:
        self.last_seen[gid] = frame
        if box is not None:
            self.last_box[gid] = box

    def needs_keyframe(self, gid: int, quality: int) -> bool:
        if quality < UPPER_BODY:
            return False
        own = self.entries.get(gid)
        if not own:
            return True
        last, best = self.top(gid)
        return self.last_seen.get(gid, last) - last >= self.params.keyframe_min_interval or quality > best

    def offer(self, gid: int, entry: Entry, box: np.ndarray | None) -> bool:
        """Adds the entry if it is new to the identity's view or shows more of the body."""
        self.touch(gid, entry.frame, box)
        if entry.quality < UPPER_BODY:
            return False
        own = self.entries.setdefault(gid, [])
        if own:
            large = len(own) > max(POOL_FROM, self.params.max_gallery_per_gid)
            nearest = pool_of(self.pools, gid, own, (e.vector for e in own)).nearest(entry.vector) if large else cosines(entry.vector, (e.vector for e in own)).max()
            if nearest >= self.params.emb_novelty_threshold and entry.quality <= self.top(gid)[1]:
                return False
        own.append(entry)
        self.cap(gid)
        return True

    def cap(self, gid: int) -> None:
        own = self.entries[gid]
        if len(own) > self.params.max_gallery_per_gid + 1:
            own[:] = [own[i] for i in capped([e.vector for e in own], self.params.max_gallery_per_gid)]
        elif len(own) > self.params.max_gallery_per_gid:
            own.pop(most_central([e.vector for e in own]))
        self.pools.pop(gid, None)
        self.tops.pop(gid, None)

    def scores(self, v: np.ndarray, only_with_face: bool = False) -> dict[int, float]:
        out = {}
        for gid, own in self.entries.items():
            part = [e.vector for e in own if e.has_face or not only_with_face]
            if part:
                out[gid] = float(cosines(v, part).max())
        return out

    def centroid(self, gid: int) -> np.ndarray:
        return unit(np.mean([e.vector for e in self.entries[gid]], axis=0))

    def merge(self, source: int, target: int) -> None:
        moved = self.entries.pop(source, [])
        if moved:
            self.entries.setdefault(target, []).extend(moved)
            self.cap(target)
        self.last_seen[target] = max(self.last_seen.pop(source, 0), self.last_seen.get(target, 0))
        box = self.last_box.pop(source, None)
        if box is not None:
            self.last_box.setdefault(target, box)


@dataclass
class FaceGallery:
    """Faces of each identity; if there are too many, the most central one goes before a new one comes."""

    params: Params = DEFAULTS
    entries: dict[int, list[np.ndarray]] = field(default_factory=dict)
    pools: dict[int, Pool] = field(default_factory=dict)

    def offer(self, gid: int, v: np.ndarray) -> tuple[bool, float]:
        """Whether the face was added, and its highest cosine to the faces before (-1 for the first)."""
        own = self.entries.setdefault(gid, [])
        if not own:
            own.append(v)
            return True, -1.0
        if len(own) > max(POOL_FROM, self.params.max_face_gallery_per_gid):
            pool = pool_of(self.pools, gid, own, own)
            if (alike := pool.nearest(v)) >= self.params.face_keyframe_threshold:
                return False, alike
            own.pop(pool.pop_most_central())
            own.append(v)
            pool.add(v)
            return True, alike
        alike = float(cosines(v, own).max())
        if alike >= self.params.face_keyframe_threshold:
            return False, alike
        if len(own) >= self.params.max_face_gallery_per_gid:
            own.pop(most_central(own))
        own.append(v)
        return True, alike

    def merge(self, source: int, target: int) -> None:
        moved = self.entries.pop(source, [])
        if moved:
            own = self.entries.setdefault(target, [])
            own.extend(moved)
            if len(own) > self.params.max_face_gallery_per_gid:
                own[:] = [own[i] for i in capped(own, self.params.max_face_gallery_per_gid)]
        self.pools.pop(source, None)
        self.pools.pop(target, None)


@dataclass
class Seen:
    """A detection of a frame: track, box, pose quality, embeddings or None."""

    tid: int
    box: np.ndarray
    quality: int
    body: np.ndarray | None
    face: np.ndarray | None


@dataclass
class Camera:
    """Identities of one camera. :meth:`step` takes a frame's detections in order and says who they are."""

    params: Params = DEFAULTS
    body: BodyGallery = None
    face: FaceGallery = None
    frame: int = 0
    next_gid: int = 0
    gid_of: dict[int, int] = field(default_factory=dict)
    stable: dict[int, int] = field(default_factory=dict)
    box: dict[int, np.ndarray] = field(default_factory=dict)
    pending: dict[int, list[np.ndarray]] = field(default_factory=dict)
    pending_face: dict[int, np.ndarray] = field(default_factory=dict)
    info: dict[int, tuple[float, str]] = field(default_factory=dict)
    face_sim: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.body = self.body or BodyGallery(self.params)
        self.face = self.face or FaceGallery(self.params)

    def _eligible(self, active: set[int], box: np.ndarray):
        gate = self.params.iou_gate_threshold

        def ok(gid: int) -> bool:
            return gid not in active and (gate <= 0 or gid not in self.body.last_box or overlap(box, self.body.last_box[gid]) >= gate)

        return ok

    def match(self, body: np.ndarray | None, face: np.ndarray | None, active: set[int], box: np.ndarray, strategy: str | None = None) -> tuple[int, float] | None:
        """Best eligible identity and its score, if that reaches the strategy's threshold."""
        ok, p = self._eligible(active, box), self.params
        if face is None:
            if body is None:
                return None
            if p.match_strategy == "centroid":
                scores = {g: float(cosines(body, [self.body.centroid(g)])[0]) for g, own in self.body.entries.items() if own}
            else:
                scores = self.body.scores(body)
            return best_of({g: s for g, s in scores.items() if ok(g)}, p.sim_threshold)
        strategy = strategy or p.face_match_strategy
        faces = {g: float(cosines(face, own).max()) for g, own in self.face.entries.items() if own}
        gids = sorted(g for g in {*faces, *(g for g, own in self.body.entries.items() if own)} if ok(g))
        if strategy == "face_only_top1":
            return best_of({g: faces.get(g, 0.0) for g in gids}, p.face_sim_threshold)
        bodies = {} if body is None else self.body.scores(body, strategy == "face_body_face_gallery")
        parts = {g: [x[g] for x in (faces, bodies) if g in x] for g in gids}
        return best_of({g: sum(x) / len(x) for g, x in parts.items() if x}, p.sim_threshold)

    def _new(self) -> int:
        self.next_gid += 1
        return self.next_gid - 1

    def step(self, seen: list[Seen]) -> list[tuple[int, int, float, str, float | None, int]]:
        """(track, identity, score, match type, face similarity, stable count) of the detections that are identified."""
        p = self.params
        if not seen:
            self.frame += p.count_empty_frames
            return []
        active = {self.gid_of[s.tid] for s in seen if s.tid in self.gid_of}
        wanted = {s.tid for s in seen if s.body is not None and s.quality >= p.least_quality and (s.tid not in self.gid_of or self.body.needs_keyframe(self.gid_of[s.tid], s.quality))}
        named: dict[int, int] = {}
        full: list[tuple[float, Seen, np.ndarray, np.ndarray | None]] = []
        for s in seen:
            body = s.body if s.tid in wanted else None
            if s.tid in self.gid_of:
                self._known(s, body)
                named[s.tid] = self.gid_of[s.tid]
                continue
            self.box[s.tid] = s.box
            if body is None and s.face is None:
                continue
            if body is None:  # by the face alone, at once
                found = self.match(None, s.face, active, s.box, "face_only_top1")
                gid = found[0] if found else self._new()
                self.info[s.tid] = (found[1], "F") if found else (0.0, "NEW")
                self.gid_of[s.tid] = named[s.tid] = gid
                self.face_sim[s.tid] = self.face.offer(gid, s.face)[1]
                self.body.touch(gid, self.frame, s.box)
                active.add(gid)
                continue
            buffer = self.pending.setdefault(s.tid, [])
            buffer.append(body)
            if s.face is not None:
                self.pending_face[s.tid] = s.face
            if len(buffer) >= p.pending_confirm_frames:
                mean, face = unit(np.mean(self.pending.pop(s.tid), axis=0)), self.pending_face.pop(s.tid, None)
                found = self.match(mean, face, active, s.box)
                full.append((found[1] if found else 0.0, s, mean, face))
        for _, s, mean, face in sorted(full, key=lambda x: -x[0]):
            named[s.tid] = self._assign(s, mean, face, active)
        tids = {s.tid for s in seen}
        self.pending = {t: b for t, b in self.pending.items() if t in tids}
        self.pending_face = {t: f for t, f in self.pending_face.items() if t in self.pending}
        self.frame += 1
        return [(s.tid, named[s.tid], *self.info.get(s.tid, (0.0, "B")), self.face_sim.get(s.tid), self.stable.get(s.tid, 0)) for s in seen if s.tid in named]

    def _known(self, s: Seen, body: np.ndarray | None) -> None:
        gid, before = self.gid_of[s.tid], self.box.get(s.tid)
        still = before is not None and overlap(s.box, before) >= self.params.stable_iou_threshold
        self.stable[s.tid] = self.stable.get(s.tid, 0) + 1 if still else 0
        if s.face is not None:
            self.face_sim[s.tid] = self.face.offer(gid, s.face)[1]
        if body is not None:
            self.body.offer(gid, Entry(body, self.frame, s.quality, s.face is not None), s.box)
        else:
            self.body.touch(gid, self.frame, s.box)
        self.box[s.tid] = s.box

    def _assign(self, s: Seen, mean: np.ndarray, face: np.ndarray | None, active: set[int]) -> int:
        found = self.match(mean, face, active, s.box)
        gid = found[0] if found else self._new()
        self.info[s.tid] = (found[1], "F+B" if face is not None else "B") if found else (0.0, "NEW")
        self.gid_of[s.tid] = gid
        self.body.offer(gid, Entry(mean, self.frame, s.quality, s.face is not None), s.box)
        if face is not None:
            self.face_sim[s.tid] = self.face.offer(gid, face)[1]
        if not found and self.params.gid_merge_threshold < 1.0 and (into := self._near_duplicate(gid, active)) is not None:
            self.body.merge(gid, into)
            self.face.merge(gid, into)
            self.gid_of = {t: into if g == gid else g for t, g in self.gid_of.items()}
            self.info[s.tid] = (self.params.gid_merge_threshold, "MERGE")
            gid = into
        active.add(gid)
        return gid

    def _near_duplicate(self, gid: int, active: set[int]) -> int | None:
        """The identity whose centroid is nearest to that of a new one, if near enough to be the same."""
        others = [g for g, own in self.body.entries.items() if g != gid and own and not (self.params.forbid_shared_merge and g in active)]
        if not others or not self.body.entries.get(gid):
            return None
        alike = cosines(self.body.centroid(gid), [self.body.centroid(g) for g in others])
        k = int(np.argmax(alike))
        return others[k] if alike[k] >= self.params.gid_merge_threshold else None


def best_of(scores: dict[int, float], least: float) -> tuple[int, float] | None:
    """The first identity of highest score, if that reaches ``least``."""
    if not scores:
        return None
    gid = max(scores, key=scores.get)
    return (gid, scores[gid]) if scores[gid] >= least else None


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return float(w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h))
