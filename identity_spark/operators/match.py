"""Similarity of query embeddings to galleries of identities.

Scores come from products of packed blocks: both sides are packed by camera and dealt into groups, and each group of the
gallery meets each group of queries in one tile. There are a few tiles for each core, however large the tables are, so a
block is sent to the root of that number of places and no more; where a part of the gallery would not fit a task, there are
more groups of it. A tile holds its part of the gallery and lets queries stream past. A block product gives, for each
query, the best score of each identity; what is below ``least`` can be left out there, before the shuffle.

With ``least`` most products needn't be made. An identity's entries stand in one block (a large identity's in several),
and in a large gallery blocks are clustered: identities go to the pivot nearest to their centroid. A query whose angle to
a block's centre is larger than the block's radius and the angle of ``least`` together has no score there, and likewise
for an identity's centroid and radius. Both are exact, as angles keep the triangle inequality; only the rest is multiplied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.vectors import dot, l2_normalize, mean_vector
from ..params import DEFAULTS, Params
from ..shared import checkpointed, small

BLOCK = 1024
#: Bytes of the gallery that a tile holds at most.
HELD = 128 << 20
#: Tiles for each core.
TILES = 6
#: Galleries of so many entries and more are clustered by pivots.
PIVOT_FROM = 64 * BLOCK
#: Most pivots: the centroids of the identities of the least hashes.
PIVOTS = 256
#: Of angles, against rounding.
SLACK = 1e-6


def _packed(rows: DataFrame, ids: list[str], vector: str, deal: Column, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(camera_id, dim, by, part and arrays of ids and components; camera_id, dim, by and their number of parts).

    A camera has a part for every BLOCK of its own rows, so parts are as full with many cameras as with one."""
    key = ["camera_id", "dim", *by]
    kept = rows.filter(F.col(vector).isNotNull()).select("camera_id", *by, *ids, deal.alias("_deal"), F.transform(vector, lambda x: x.cast("double")).alias("_v")).withColumn("dim", F.size("_v"))
    sizes = checkpointed(kept.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts")))
    packed = kept.join(small(sizes), key).withColumn("part", F.pmod("_deal", F.col("parts"))).groupBy(*key, "part").agg(F.collect_list(F.struct(*ids, "_v")).alias("_rows"))
    return packed.select(*key, "part", *[F.col(f"_rows.{i}").alias(i) for i in ids], F.flatten("_rows._v").alias("flat")), sizes


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    m = flat.astype(np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def with_pivots(identities: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """camera_id, global_id and pivot: the number of the nearest of some directions, -1 for vectors of another length."""
    unit = _unit(pivots.ravel(), pivots.shape[1])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, size = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            fits = size == unit.shape[1]
            out = np.full(len(size), -1, np.int32)
            if fits.any():
                out[fits] = (_unit(flat[np.repeat(fits, size)], unit.shape[1]) @ unit.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("camera_id"), batch.column("global_id"), pa.array(out)], ["camera_id", "global_id", "pivot"])

    return identities.select("camera_id", "global_id", F.col(vector).alias("v")).mapInArrow(nearest, "camera_id long, global_id long, pivot int")


def _gallery_blocks(gallery: DataFrame, entry: str, least: float | None, pivot_from: int, older: bool) -> tuple[DataFrame, DataFrame]:
    """As :func:`_packed` gives them. An identity's entries are dealt as one, or in runs of BLOCK where it has more; if only
    older identities count, in the order of their numbers."""
    every = ["camera_id", "global_id", "entry_seq", entry]
    if older:
        return _packed(gallery.select(*every), ["global_id", "entry_seq"], entry, F.floor(F.col("global_id") / BLOCK))
    if least is None:
        return _packed(gallery.select(*every), ["global_id", "entry_seq"], entry, F.xxhash64("global_id", "entry_seq", F.lit(2)))
    have = gallery.filter(F.col(entry).isNotNull())
    sizes = checkpointed(have.groupBy("camera_id", "global_id").agg(F.count(F.lit(1)).alias("_n"))).withColumn("_runs", F.ceil(F.col("_n") / BLOCK).cast("long"))
    run = F.when(F.col("_runs") > 1, F.pmod(F.xxhash64("entry_seq", F.lit(3)), F.col("_runs"))).otherwise(0)
    deal = F.xxhash64("global_id", run, F.lit(2))
    held = have.select(*every).join(small(sizes), ["camera_id", "global_id"])
    if (sizes.agg(F.sum("_n")).first()[0] or 0) < pivot_from:
        return _packed(held, ["global_id", "entry_seq"], entry, deal)
    means = checkpointed(centroids(have.select("camera_id", "global_id", "entry_seq", F.col(entry).alias("embedding"))))
    first = means.orderBy(F.xxhash64("camera_id", "global_id"), "camera_id", "global_id").limit(PIVOTS).select("embedding").collect()
    dim = len(first[0][0])
    pivots = np.array([r[0] for r in first if len(r[0]) == dim])
    placed = held.join(with_pivots(means, "embedding", pivots), ["camera_id", "global_id"])
    return _packed(placed, ["global_id", "entry_seq"], entry, deal, ("pivot",))


def _best_scores(q: np.ndarray, e: np.ndarray, starts: np.ndarray, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows of q, identities and best scores that reach ``least``, and how many products were made; e: unit entries sorted by
    identity, starts: where each one's begin."""
    if least is None:
        top = np.maximum.reduceat(q @ e.T, starts, axis=1)
        a, b = np.nonzero(top >= -2.0)
        return a, b, top[a, b], len(q) * len(e)
    size = np.diff(starts, append=len(e))
    reach = np.arccos(np.clip(least, -1, 1)) + SLACK
    angle = lambda x, y: np.arccos(np.clip((x * y).sum(axis=-1), -1, 1))
    no_entry = (e * e).sum(axis=1) < 0.5  # of length 0, so of no direction
    if least <= 0 or no_entry.any():
        top = np.maximum.reduceat(q @ e.T, starts, axis=1)
        a, b = np.nonzero(top >= least - 1e-9)
        return a, b, top[a, b], len(q) * len(e)
    centre = _unit(e.sum(axis=0), e.shape[1])[0]
    rows = np.flatnonzero(np.arccos(np.clip(q @ centre, -1, 1)) <= reach + angle(e, centre).max())
    made, alive = len(q), None
    if len(rows) and len(starts) < len(e):
        means = _unit(np.add.reduceat(e, starts, axis=0).ravel(), e.shape[1])
        radius = np.maximum.reduceat(angle(e, np.repeat(means, size, axis=0)), starts)
        alive = np.arccos(np.clip(q[rows] @ means.T, -1, 1)) <= reach + radius
        made += alive.size
        rows, alive = rows[alive.any(axis=1)], alive[alive.any(axis=1)]
    own = np.arange(len(starts)) if alive is None else np.flatnonzero(alive.any(axis=0))
    if not len(rows) or not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), made
    n = size[own]
    at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    s = q[rows] @ e[at].T
    top = np.maximum.reduceat(s, np.cumsum(n) - n, axis=1)
    a, b = np.nonzero(top >= least - 1e-9)
    return rows[a], own[b], top[a, b], made + s.size


def _tiles(q: DataFrame, q_sizes: DataFrame, g: DataFrame, g_sizes: DataFrame, key: list[str], place: Column) -> DataFrame:
    """Blocks of both sides by tile of their key, in partitions where a tile's gallery comes before its queries.

    q and g: key, part and more; sizes: key and parts. Work is in products of blocks; a key has its share of the tiles."""
    spark = q.sparkSession
    both = checkpointed(q_sizes.groupBy(*key).agg(F.sum("parts").alias("_qn")).join(g_sizes.groupBy(*key).agg(F.sum("parts").alias("_gn")), key))
    work = both.agg(F.sum(F.col("_qn").cast("double") * F.col("_gn"))).first()[0] or 0.0
    most = int(max(1, min(TILES * spark.sparkContext.defaultParallelism, work)))
    tiles = F.ceil(F.lit(most) * F.col("_qn") * F.col("_gn") / F.lit(max(work, 1.0)))
    fits = F.ceil(F.col("_gn") * F.greatest(F.col("dim"), F.lit(1)) * (8 * BLOCK) / F.lit(HELD))
    balanced = F.round(F.sqrt(tiles * F.col("_gn") / F.col("_qn")))
    dealt = both.select(*key, "_qn", "_gn", tiles.alias("_t"), F.least("_gn", F.greatest(fits, balanced, F.lit(1))).cast("long").alias("_gs"))
    dealt = small(dealt.select(*key, "_gs", F.least("_qn", F.greatest(F.ceil(F.col("_t") / F.col("_gs")), F.lit(1))).cast("long").alias("_qs")))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = q.join(dealt, key).withColumn("_a", F.pmod("part", F.col("_qs"))).withColumn("_b", each("_gs")).drop("_qs", "_gs")
    g = g.join(dealt, key).withColumn("_b", F.pmod(place, F.col("_gs"))).withColumn("_a", each("_qs")).drop("_qs", "_gs")
    every = g.withColumn("_side", F.lit(0)).unionByName(q.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    at = [*key, "_a", "_b"]
    return every.repartition(most, *at).sortWithinPartitions(*at, "_side", "part")


def _products(queries: DataFrame, gallery: DataFrame, query: str, vector: str, entry: str, least: float | None, pivot_from: int, older: bool = False, own: bool = False) -> DataFrame:
    """camera_id, query, global_id and score of block products; a row of null query and identity for each, with the number
    of products of a query and an entry, and of those made, as pairs and made. own: queries have a global_id, and meet the
    entries of that identity alone."""
    extra = ("global_id",) if own else ()
    key = ["camera_id", "dim", *extra]
    q, q_sizes = _packed(queries, [query], vector, F.floor(F.col(query) / BLOCK) if older else F.xxhash64(query, F.lit(1)), extra)
    if own:
        g, sizes = _packed(gallery.select("camera_id", "global_id", "entry_seq", entry), ["entry_seq"], entry, F.xxhash64("entry_seq", F.lit(2)), extra)
    else:
        g, sizes = _gallery_blocks(gallery, entry, least, pivot_from, older)
    q = q.select(*key, "part", F.col(query).alias("q_ids"), F.col("flat").alias("q_flat"))
    g = g.select(*key, "part", *(["pivot"] if "pivot" in g.columns else []), *([] if own else [F.col("global_id").alias("g_ids")]), F.size("entry_seq").alias("n"), "flat")
    place = F.xxhash64("part", "pivot") if "pivot" in g.columns else F.col("part")
    tiles = _tiles(q, q_sizes, g, sizes, key, place)
    schema = f"camera_id long, {query} {dict(queries.dtypes)[query]}, global_id long, score double, pairs long, made long"
    mark = [*key, "_a", "_b"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["camera_id", query, "global_id", "score", "pairs", "made"]
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                at = {n: batch.column(n)[i] for n in batch.schema.names}
                array = lambda n: at[n].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                tile, dim = tuple(at[n].as_py() for n in mark), at["dim"].as_py()
                if tile != now:
                    now, held = tile, []
                if at["_side"].as_py() == 0:
                    e = _unit(array("flat"), dim) if dim else np.zeros((at["n"].as_py(), 0))
                    gids = np.full(len(e), at["global_id"].as_py()) if own else array("g_ids")
                    order = np.argsort(gids, kind="stable")
                    held.append((gids[order], np.flatnonzero(np.r_[True, np.diff(gids[order]) != 0]), e[order]))
                    continue
                ids = at["q_ids"].values
                x = _unit(array("q_flat"), dim) if dim else np.zeros((len(ids), 0))
                newest = max(ids.to_pylist()) if older else None
                rows, of, scores, pairs, made = [], [], [], 0, 0
                for gids, starts, e in held:
                    pairs += len(ids) * len(gids)
                    if older and gids[0] >= newest:
                        continue
                    a, b, top, n = _best_scores(x, e, starts, least)
                    made += n
                    b = gids[starts][b]
                    if older:
                        keep = b < ids.to_numpy()[a]
                        a, b, top = a[keep], b[keep], top[keep]
                    rows, of, scores = [*rows, a], [*of, b], [*scores, top]
                    if sum(map(len, rows)) > 64 * BLOCK:
                        rows, of, scores = ([c] for c in _highest(rows, of, scores))
                a, b, top = _highest(rows, of, scores)
                none = pa.nulls(len(a), pa.int64())
                camera = lambda n: pa.array(np.full(n, at["camera_id"].as_py()))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([camera(len(a)), ids.take(pa.array(a)), pa.array(b), pa.array(top), none, none], names)
                yield pa.RecordBatch.from_arrays([camera(1), pa.nulls(1, ids.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([pairs]), pa.array([made])], names)

    return tiles.mapInArrow(best, schema)


def _highest(rows: list[np.ndarray], of: list[np.ndarray], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's highest score of each identity, from several blocks."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if len(rows) == 1:
        return rows[0], of[0], scores[0]
    a, b, top = map(np.concatenate, (rows, of, scores))
    if not len(a):
        return a, b, top
    order = np.lexsort((b, a))
    a, b, top = a[order], b[order], top[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)])
    return a[starts], b[starts], np.maximum.reduceat(top, starts)


def all_top1_sims(queries: DataFrame, gallery: DataFrame, *, query: str = "query_id", vector: str = "embedding", entry: str = "embedding", least: float | None = None, pivot_from: int = PIVOT_FROM, older: bool = False) -> DataFrame:
    """camera_id, query, global_id, score (highest cosine of the identity's entries) and first_seq (its first entry).

    queries: camera_id, query, vector; gallery: camera_id, global_id, entry_seq, entry. Null vectors have no score. older:
    the queries are identities by number, and each meets those of lower numbers alone, in half of the products."""
    scores = _products(queries, gallery, query, vector, entry, least, pivot_from, older).filter("global_id IS NOT NULL")
    scores = scores.groupBy("camera_id", query, "global_id").agg(F.max("score").alias("score"))
    first = gallery.groupBy("camera_id", "global_id").agg(F.min("entry_seq").alias("first_seq"))
    return scores.join(first, ["camera_id", "global_id"])


def products_made(queries: DataFrame, gallery: DataFrame, least: float, *, query: str = "query_id", vector: str = "embedding", entry: str = "embedding", pivot_from: int = PIVOT_FROM, older: bool = False) -> DataFrame:
    """camera_id, pairs (of a query and an entry) and made: how many products :func:`all_top1_sims` makes, with those to
    centres and centroids; their difference is what the angles spare."""
    found = _products(queries, gallery, query, vector, entry, least, pivot_from, older).filter("global_id IS NULL")
    return found.groupBy("camera_id").agg(F.sum("pairs").alias("pairs"), F.sum("made").alias("made"))


def centroids(gallery: DataFrame, vector: str = "embedding") -> DataFrame:
    """Unit mean of each identity's entries, with its first entry's number."""
    means = gallery.groupBy("camera_id", "global_id").agg(mean_vector(F.col(vector)).alias("_m"), F.min("entry_seq").alias("entry_seq"), F.count(F.lit(1)).alias("n_entries"))
    return means.select("camera_id", "global_id", "entry_seq", "n_entries", l2_normalize(F.col("_m")).alias("embedding"))


def own_sims(queries: DataFrame, gallery: DataFrame, query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """camera_id, query, global_id and score: the highest cosine of a query with the entries of its own identity. Queries
    whose identity has no entry of their length have no row, and null vectors or components no score."""
    whole = lambda df, v: df.filter(~F.exists(v, lambda x: x.isNull()))
    scores = _products(whole(queries, vector), whole(gallery, "embedding"), query, vector, "embedding", None, PIVOT_FROM, own=True)
    return scores.filter("global_id IS NOT NULL").groupBy("camera_id", query, "global_id").agg(F.max("score").alias("score"))


def top1_sim(queries: DataFrame, gallery: DataFrame, query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """Highest cosine of a query within its own identity (camera_id, query, global_id); 0.0 if that has no entry."""
    key = ["camera_id", query, "global_id"]
    own = queries.select(*key).distinct().join(own_sims(queries, gallery, query, vector), key, "left")
    return own.select(*key, F.coalesce("score", F.lit(0.0)).alias("score"))


def exclude_active(scores: DataFrame, active: DataFrame, query: str = "query_id") -> DataFrame:
    """Candidates that no known track of the query's frame holds; active: camera_id, query, global_id."""
    return scores.join(active.select("camera_id", query, "global_id"), ["camera_id", query, "global_id"], "left_anti")


def iou_gate(scores: DataFrame, boxes_of: DataFrame, gid_state: DataFrame, params: Params = DEFAULTS, query: str = "query_id") -> DataFrame:
    """Candidates whose last box overlaps the query's box enough; those without a last box stay. boxes_of: query, x1..y2."""
    if params.iou_gate_threshold <= 0:
        return scores
    own = boxes_of.select("camera_id", query, boxes.box().alias("_own"))
    last = gid_state.select("camera_id", "global_id", boxes.box().alias("_last"))
    out = scores.join(own, ["camera_id", query]).join(last, ["camera_id", "global_id"], "left")
    kept = F.col("_last").isNull() | F.col("_last.x1").isNull() | (boxes.iou(F.col("_own"), F.col("_last")) >= params.iou_gate_threshold)
    return out.filter(kept).drop("_own", "_last")


def top1_per_group(rows: DataFrame, group: list[str], score: str, seq: str) -> DataFrame:
    """The row of highest score in each group, the least ``seq`` of equal ones; a partial aggregate, not a sort."""
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(score, -F.col(seq))).alias("_best")).select(*group, "_best.*")


def rank_gallery(scores: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """rank 1 to k of each query's identities by score, earlier identities first among equal ones."""
    from pyspark.sql import Window

    order = Window.partitionBy("camera_id", query).orderBy(F.desc("score"), "first_seq")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def match(queries: DataFrame, gallery: DataFrame, params: Params = DEFAULTS, *, query: str = "query_id", vector: str = "embedding", active: DataFrame | None = None, boxes_of: DataFrame | None = None, gid_state: DataFrame | None = None) -> DataFrame:
    """Best eligible identity of each query by the strategy: camera_id, query, global_id, score. Queries without one have no row."""
    against = centroids(gallery) if params.match_strategy == "centroid" else gallery
    scores = all_top1_sims(queries, against, query=query, vector=vector, least=params.sim_threshold)
    if active is not None:
        scores = exclude_active(scores, active, query)
    if boxes_of is not None and gid_state is not None:
        scores = iou_gate(scores, boxes_of, gid_state, params, query)
    return top1_per_group(scores.filter(F.col("score") >= params.sim_threshold), ["camera_id", query], "score", "first_seq").select("camera_id", query, "global_id", "score")


def fused_scores(queries: DataFrame, gallery: DataFrame, faces: DataFrame, strategy: str, least: float, *, query: str = "query_id", body: str = "body", face: str = "face") -> DataFrame:
    """camera_id, query, global_id, face_score, body_score and score of the candidates whose score may reach ``least``.

    Candidates are the identities of either gallery. No cosine is above 1, so a mean of two reaches ``least`` only if
    both parts reach 2 * least - 1: lower ones are left out before the shuffle. Which parts an identity has, and so
    whether one was left out, is told by the galleries."""
    asked = queries.filter(F.col(face).isNotNull())
    if strategy == "face_only_top1":
        # an identity without faces scores 0
        every = None if least > 0 else asked.select("camera_id", query).join(candidate_gids(gallery, faces), "camera_id")
        f = all_top1_sims(asked, faces, query=query, vector=face, least=least).select("camera_id", query, "global_id", F.col("score").alias("face_score"))
        both = f if every is None else f.join(every, ["camera_id", query, "global_id"], "full_outer")
        return both.select("*", F.lit(None).cast("double").alias("body_score"), F.coalesce("face_score", F.lit(0.0)).alias("score"))
    part = gallery.filter("has_face") if strategy == "face_body_face_gallery" else gallery
    bound = min(least, 2 * least - 1)
    key = ["camera_id", query, "global_id"]
    f = all_top1_sims(asked, faces, query=query, vector=face, least=bound).select(*key, F.col("score").alias("face_score"))
    b = all_top1_sims(asked, part, query=query, vector=body, least=bound).select(*key, F.col("score").alias("body_score"))
    parts = faces.select("camera_id", "global_id").distinct().withColumn("_f", F.lit(True)).join(part.select("camera_id", "global_id").distinct().withColumn("_b", F.lit(True)), ["camera_id", "global_id"], "full_outer")
    has_body = asked.select("camera_id", query, F.col(body).isNotNull().alias("_body"))
    both = f.join(b, key, "full_outer").join(parts, ["camera_id", "global_id"]).join(has_body, ["camera_id", query])
    has_faces, has_bodies = F.coalesce("_f", F.lit(False)), F.coalesce("_b", F.lit(False)) & F.col("_body")
    whole = (~has_faces | F.col("face_score").isNotNull()) & (~has_bodies | F.col("body_score").isNotNull())
    n = has_faces.cast("int") + has_bodies.cast("int")
    score = (F.coalesce("face_score", F.lit(0.0)) + F.coalesce("body_score", F.lit(0.0))) / n
    return both.filter(whole).select(*key, "face_score", "body_score", score.alias("score"))


def match_with_face(queries: DataFrame, gallery: DataFrame, faces: DataFrame, params: Params = DEFAULTS, *, query: str = "query_id", body: str = "body", face: str = "face") -> DataFrame:
    """Best identity of each query by face and body: camera_id, query, global_id, score; the least identity of equal ones.

    Queries without a face go by the body alone; those without either have no row."""
    least = params.face_sim_threshold if params.face_match_strategy == "face_only_top1" else params.sim_threshold
    fused = fused_scores(queries, gallery, faces, params.face_match_strategy, least, query=query, body=body, face=face).filter(F.col("score") >= least)
    best = top1_per_group(fused, ["camera_id", query], "score", "global_id").select("camera_id", query, "global_id", "score")
    alone = match(queries.filter(F.col(face).isNull() & F.col(body).isNotNull()), gallery, params, query=query, vector=body)
    return best.unionByName(alone)


def candidate_gids(gallery: DataFrame, faces: DataFrame) -> DataFrame:
    """Identities with an entry in either gallery."""
    return gallery.select("camera_id", "global_id").union(faces.select("camera_id", "global_id")).distinct()
