"""Localisation through learned features: a written index of keyframes, retrieval, matching by pairs, poses.

Features come from whatever extractor made them; what is done here is the rest: which world point a keypoint sees, which
keyframes look like an image, which of their keypoints match, and where the image was taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import affine
from .localize import MATCHERS, best_candidate, nearest_keypoint, solve_poses
from .matching import nearest

#: Keyframes tried for an image, pixels to a map feature, pixels of a reprojection, samples, least inliers and confidences.
CANDIDATES, ASSIGNED, PIXELS, ROUNDS, LEAST = 5, 8.0, 8.0, 1000, 4
BOUNDS = (0.01, 0.99)


def placed_keypoints(keypoints: DataFrame, features: DataFrame, poses: DataFrame) -> DataFrame:
    """Keypoints (map, node, point_id, u, v, vec) with x, y, z in the world: those of the nearest map feature of their node
    within ``ASSIGNED`` pixels, null where there is none, it has no depth, or the node has no pose.

    ``features``: map, node, feature_id, u, v, dx, dy, dz (in the node's camera); ``poses``: map, node, r, t.
    """
    near = nearest_keypoint(keypoints, features.dropna(subset=["u", "v"]), ["map", "node"], "point_id", "feature_id", ("u", "v"), ASSIGNED)
    world = affine([F.col("r")[i] for i in range(9)], [F.col("t")[i] for i in range(3)], [F.col(c) for c in ("dx", "dy", "dz")])
    # one unknown coordinate makes all unknown
    known = F.col("dx").isNotNull() & F.col("dy").isNotNull() & F.col("dz").isNotNull()
    there = features.join(poses.select("map", "node", "r", "t"), ["map", "node"], "left").select("feature_id", *[F.when(known, w).alias(c) for w, c in zip(world, "xyz")])
    return keypoints.join(near.select("point_id", "feature_id"), "point_id", "left").join(there, "feature_id", "left").drop("feature_id")


def write_index(path: str, keypoints: DataFrame, keyframes: DataFrame, features: DataFrame, poses: DataFrame, mode: str = "errorifexists") -> None:
    """Write the index of keyframes as two tables under ``path``, a folder for each map: ``points`` (node, point_id, u, v,
    vec, x, y, z) and ``keyframes`` (node, vec: what the whole image looks like).

    ``keypoints`` and ``keyframes`` of nodes without a pose are left out, as are keyframes without a vector.  point_id and
    feature_id are unique over all maps.
    """
    posed = poses.where("r is not null and t is not null").select("map", "node").distinct()
    points = placed_keypoints(keypoints.join(posed, ["map", "node"], "left_semi"), features, poses)
    points.select("map", "node", "point_id", "u", "v", "vec", "x", "y", "z").repartition("map", "node").sortWithinPartitions("map", "node").write.partitionBy("map").mode(mode).parquet(f"{path}/points")
    keyframes.where("vec is not null").join(posed, ["map", "node"], "left_semi").select("map", "node", "vec").repartition("map").write.partitionBy("map").mode(mode).parquet(f"{path}/keyframes")


def read_index(spark: SparkSession, path: str, maps: str = "long") -> tuple[DataFrame, DataFrame]:
    """The tables ``points`` and ``keyframes`` of an index; filters on map read only its folders.  ``maps`` is the type of a
    map's id, which folder names don't keep."""
    read = lambda name: spark.read.parquet(f"{path}/{name}").withColumn("map", F.col("map").cast(maps))
    return read("points"), read("keyframes")


def index_summary(points: DataFrame, keyframes: DataFrame) -> DataFrame:
    """map, num_keyframes, num_with_3d (keyframes of which a keypoint has a place), num_points, num_placed."""
    per = points.groupBy("map", "node").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("k"))
    of = per.groupBy("map").agg(F.count_if(F.col("k") > 0).alias("num_with_3d"), F.sum("n").alias("num_points"), F.sum("k").alias("num_placed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keyframes.groupBy("map").agg(F.count(F.lit(1)).alias("num_keyframes")).join(of, "map", "left").select("map", "num_keyframes", *[zero(c) for c in ("num_with_3d", "num_points", "num_placed")])


def candidates(images: DataFrame, keyframes: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """map, image, node, rank (from 1), similarity: the keyframes of a map that look most like an image (map, image, vec)."""
    found = nearest(images, keyframes, k, "cosine", "image", "node", within=["map"])
    return found.select("map", F.col("query_id").alias("image"), F.col("point_id").alias("node"), "rank", (1 - F.col("dist")).alias("similarity"))


def pair_matches(queries: DataFrame, points: DataFrame, pairs: DataFrame, name: str = "mutual", **options) -> DataFrame:
    """map, image, node, query_id, point_id: the features of an image matched with those of each of its candidates alone.

    ``queries``: image, query_id, vec; ``points``: map, node, point_id, vec; ``pairs``: map, image, node.  The matcher compares
    descriptors of one pair only, so an image's features meet five keyframes and not a map.
    """
    keys = ["map", "image", "node"]
    asked = queries.select("image", "query_id", "vec").join(pairs.select(*keys), "image")
    there = points.select("map", "node", "point_id", "vec").join(pairs.select(*keys), ["map", "node"])
    return MATCHERS[name](asked, there, within=keys, **options)


def localize_by_candidates(queries: DataFrame, images: DataFrame, points: DataFrame, keyframes: DataFrame, intrinsics: tuple[float, float, float, float], k: int = CANDIDATES, name: str = "mutual", **options) -> DataFrame:
    """map, image, node, rank, num_matches (agreeing points), num_correspondences, confidence, pose: of an image's candidates the
    one with most agreeing points, of equal ones the likest.

    ``queries``: image, query_id, u, v, vec; ``images``: map, image, vec.  A candidate needs four matches with a place in the world, and
    as many that agree; an image for which none has them has no row.
    """
    pairs = candidates(images, keyframes, k)
    matches = pair_matches(queries, points, pairs, name, **options)
    seen = points.where("x is not null and y is not null and z is not null").select("map", "node", "point_id", "x", "y", "z")
    placed = matches.join(seen, ["map", "node", "point_id"]).join(queries.select("image", "query_id", "u", "v"), ["image", "query_id"])
    solved = solve_poses(placed, ["map", "image", "node"], intrinsics, PIXELS, ROUNDS, LEAST, BOUNDS)
    ranked = solved.join(pairs.select("map", "image", "node", "rank"), ["map", "image", "node"]).withColumn("_pair", F.struct("map", "image"))
    best = best_candidate(ranked.drop("map"), "_pair", "image", "rank")
    return best.select("_pair.map", "image", "node", "rank", F.col("num_inliers").alias("num_matches"), "num_correspondences", "confidence", *"xyz", "qx", "qy", "qz", "qw")
