"""The learned path, poses from few points, floors, and nearest neighbours in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import learned, localize, matching, trajectories

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
K = (500.0, 500.0, 320.0, 240.0)


def floats(v):
    return [float(x) for x in v]


def camera(seed):
    rng = np.random.default_rng(seed)
    return localize.turned(rng.normal(size=3) * 0.4), np.array([0.3, -0.2, 9.0])


@pytest.mark.parametrize("n, plane", [(4, False), (5, False), (4, True), (12, True), (6, False)])
def test_poses_from_few_and_from_planar_points(n, plane):
    for seed in range(40):
        rng = np.random.default_rng(seed)
        points = rng.uniform(-3, 3, (n, 3))
        if plane:
            points[:, 2] = 0.3 * points[:, 0] - 0.1 * points[:, 1] + 0.2
        r, t = camera(seed)
        got = localize.solve(points, localize.project(points, r, t), 5 / 500, 300)
        assert got is not None and np.linalg.norm(got[0].T @ got[1] - r.T @ t) < 0.01 and got[2].all()


def test_poses_among_false_matches_and_noise():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        points, (r, t) = rng.uniform(-3, 3, (40, 3)), camera(seed)
        image = localize.project(points, r, t) + rng.normal(size=(40, 2)) * 0.0005
        image[:13] += rng.uniform(0.05, 0.2, (13, 2))
        got = localize.solve(points, image, 5 / 500, 300)
        assert np.linalg.norm(got[0].T @ got[1] - r.T @ t) < 0.08 and got[2].sum() >= 26


def test_points_that_fix_no_pose():
    line = np.outer(np.arange(6.0), [1.0, 2.0, 0.5])
    r, t = camera(1)
    assert localize.solve(line, localize.project(line, r, t), 0.01, 50) is None
    assert localize.solve(line[:3], localize.project(line[:3], r, t), 0.01, 50) is None
    same = np.ones((5, 3))
    assert localize.solve(same, localize.project(same, r, t), 0.01, 50) is None


def test_four_matches_are_enough(spark):
    rng = np.random.default_rng(3)
    points, (r, t) = rng.uniform(-3, 3, (4, 3)), camera(3)
    uv = localize.project(points, r, t) * 500 + [320, 240]
    rows = [(1, *floats(a), *floats(b)) for a, b in zip(uv, points)] + [(2, *floats(a), *floats(b)) for a, b in list(zip(uv, points))[:3]] + [(1, None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image long, u double, v double, x double, y double, z double")
    got = localize.solve_poses(df, "image", K, min_inliers=4).collect()
    assert [g["image"] for g in got] == [1] and np.allclose([got[0][c] for c in "xyz"], -r.T @ t, atol=0.01) and got[0]["num_inliers"] == 4
    assert localize.solve_poses(df, "image", K, min_inliers=5).count() == 0


# ---------------------------------------------------------------- maps of many keyframes


def scene(seed, nodes=8, points=30):
    """Keyframes of one map: their world points, descriptors and looks."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-3, 3, (points, 3)), rng.normal(size=(points, 16)), rng.normal(size=24)) for _ in range(nodes)]


def tables(spark, maps):
    """keypoints, keyframes, features and poses of ``maps`` {map: scene}: a node's frame is shifted, features lie near keypoints."""
    kp, kf, ft, ps = [], [], [], []
    for m, frames in maps.items():
        for node, (world, vec, look) in enumerate(frames):
            shift = np.array([node, -node, 0.5 * m])
            kf.append((m, node, floats(look)))
            ps.append((m, node, floats(EYE), floats(shift)))
            for i, (w, v) in enumerate(zip(world, vec)):
                pid, u = (m * 100 + node) * 1000 + i, 20.0 * i + 5
                kp.append((m, node, pid, u, 100.0 + node, floats(v)))
                depth = floats(w - shift) if i % 5 != 4 else [None, 1.0, 1.0]  # every fifth has no depth
                ft.append((m, node, pid, u + (3.0 if i % 7 else 9.0), 100.0 + node, *depth))  # every seventh is too far
    return (
        spark.createDataFrame(kp, "map long, node long, point_id long, u double, v double, vec array<double>"),
        spark.createDataFrame(kf + [(1, 99, None), (1, 98, floats(np.ones(24)))], "map long, node long, vec array<double>"),
        spark.createDataFrame(ft, "map long, node long, feature_id long, u double, v double, dx double, dy double, dz double"),
        spark.createDataFrame(ps + [(1, 97, None, None)], "map long, node long, r array<double>, t array<double>"),
    )


def seen(frame, image, seed):
    """Features of an image that shows a keyframe: query_id, image, u, v, vec; and what it looks like."""
    rng, (r, t) = np.random.default_rng(seed), camera(seed)
    uv = localize.project(frame[0], r, t) * 500 + [320, 240]
    rows = [(image * 1000 + i, image, *floats(a), floats(v + rng.normal(size=16) * 0.02)) for i, (a, v) in enumerate(zip(uv, frame[1]))]
    return rows, floats(frame[2] + rng.normal(size=24) * 0.05), -r.T @ t


def test_learned_localisation_through_a_written_index(spark, tmp_path):
    maps = {1: scene(1), 2: scene(2)}
    learned.write_index(str(tmp_path / "index"), *(lambda kp, kf, ft, ps: (kp, kf, ft, ps))(*tables(spark, maps)))
    points, keyframes = learned.read_index(spark, str(tmp_path / "index"))
    assert "map=" in points.where("map = 2").select("map", "node").inputFiles()[0]
    told = {r["map"]: tuple(r)[1:] for r in learned.index_summary(points, keyframes).collect()}
    placed = sum(1 for i in range(30) if i % 5 != 4 and i % 7)
    assert told == {m: (8, 8, 240, 8 * placed) for m in (1, 2)}  # nodes without a look or a pose are left out
    # places in the world come back, whatever frame the node has
    row = points.where("map = 2 and node = 3 and point_id = 203001").first()
    assert np.allclose([row[c] for c in "xyz"], maps[2][3][0][1])
    rows, looks, at = [], [], {}
    for image, (m, node) in {1: (1, 2), 2: (2, 5), 3: (1, 7)}.items():
        r, look, eye = seen(maps[m][node], image, image)
        rows += r
        looks.append((m, image, look))
        at[image] = (m, node, eye)
    looks.append((2, 4, floats(np.ones(24))))  # an image whose features nobody has
    rows += [(4000 + i, 4, 1.0 * i, 2.0, floats(np.full(16, 100.0 + i))) for i in range(3)]
    queries = spark.createDataFrame(rows, "query_id long, image long, u double, v double, vec array<double>")
    images = spark.createDataFrame(looks, "map long, image long, vec array<double>")
    pairs = learned.candidates(images, keyframes)
    assert {r["image"]: r["n"] for r in pairs.groupBy("image").agg(F.count("*").alias("n")).collect()} == {1: 5, 2: 5, 3: 5, 4: 5}
    assert {r["image"]: r["node"] for r in pairs.where("rank = 1 and image < 4").collect()} == {i: n for i, (_, n, _) in at.items()}
    for name in ("mutual", "ratio"):
        got = {r["image"]: r for r in learned.localize_by_candidates(queries, images, points, keyframes, K, name=name).collect()}
        assert set(got) == {1, 2, 3}
        for image, (m, node, eye) in at.items():
            g = got[image]
            assert (g["map"], g["node"], g["rank"], g["num_matches"]) == (m, node, 1, placed) and g["confidence"] == 0.99
            assert np.allclose([g[c] for c in "xyz"], eye, atol=0.01)


def test_matches_stay_within_their_pair(spark):
    """Two keyframes with the same descriptors: each pair has all of them, as if there were no other."""
    vec = [floats(v) for v in np.random.default_rng(1).normal(size=(6, 4))]
    points = spark.createDataFrame([(1, n, n * 10 + i, v) for n in (1, 2) for i, v in enumerate(vec)], "map long, node long, point_id long, vec array<double>")
    queries = spark.createDataFrame([(5, i, v) for i, v in enumerate(vec)], "image long, query_id long, vec array<double>")
    pairs = spark.createDataFrame([(1, 5, 1), (1, 5, 2)], "map long, image long, node long")
    for name in ("mutual", "ratio"):
        got = {(r["node"], r["query_id"], r["point_id"]) for r in learned.pair_matches(queries, points, pairs, name).collect()}
        assert got == {(n, i, n * 10 + i) for n in (1, 2) for i in range(6)}


def test_buildings_with_equal_levels_do_not_mix(spark):
    """An image of building 7 shows what only building 8 has: it must fail, and the other's request must not."""
    maps = {70: scene(11, 2), 71: scene(12, 2), 80: scene(13, 2)}
    kp, _, _, _ = tables(spark, maps)
    world = [(m, (m * 100 + n) * 1000 + i, n, *floats(w)) for m, fs in maps.items() for n, f in enumerate(fs) for i, w in enumerate(f[0])]
    points = kp.select("map", "point_id", "node", "vec").join(spark.createDataFrame(world, "map long, point_id long, node long, x double, y double, z double"), ["map", "point_id", "node"])
    poses = spark.createDataFrame([(m, n, EYE, [0.0] * 3) for m in maps for n in (0, 1)], "map long, node long, r array<double>, t array<double>")
    rows, at = [], {}
    for image, m in {1: 80, 2: 71, 3: 80}.items():
        r, _, eye = seen(maps[m][1], image, 20 + image)
        rows += r
        at[image] = eye
    queries = spark.createDataFrame(rows, "query_id long, image long, u double, v double, vec array<double>")
    # request 100 shows building 8 but asks in 7, 101 asks in 7 with two images, 102 in 8, 103 where there is no map
    requests = spark.createDataFrame([(100, 7, 1), (101, 7, 1), (101, 7, 2), (102, 8, 3), (103, 9, 3)], "request long, building long, image long")
    floors = spark.createDataFrame([(7, 1, 70), (7, 2, 71), (8, 1, 80)], "building long, level long, map long")
    run = lambda pairs: localize.localize(queries, points, poses, K, pairs=pairs).where("method = 'pose'")
    got = {r["request"]: r for r in localize.localize_on_floors(requests, floors, run).collect()}
    assert got[100]["error"] == "failed on all floors" and got[100]["building"] == 7 and got[100]["level"] is None
    assert (got[101]["level"], got[101]["map"], got[101]["image"], got[101]["error"]) == (2, 71, 2, None)
    assert (got[102]["level"], got[102]["map"]) == (1, 80) and np.allclose([got[102][c] for c in "xyz"], at[3], atol=0.01)
    assert got[103]["error"] == "no map of the building" and got[103]["building"] == 9
    per = localize.floor_results(requests, floors, run)
    assert {(r["request"], r["level"]): r["image"] for r in per.collect()} == {(100, 1): None, (100, 2): None, (101, 1): None, (101, 2): 2, (102, 1): 3}


def test_match_debug_keeps_the_best_node(spark):
    matches = spark.createDataFrame([(1, 5, 50), (1, 6, 60), (1, 7, 51), (2, 9, 60)], "image long, query_id long, point_id long")
    points = spark.createDataFrame([(50, 1), (51, 1), (60, 2)], "point_id long, node long")
    got = {r["image"]: (r["node"], r["num_good_matches"], r["num_node_matches"], [tuple(p) for p in r["pairs"]]) for r in localize.match_debug(matches, points, ["image"]).collect()}
    assert got == {1: (1, 3, 2, [(5, 50), (7, 51)]), 2: (2, 1, 1, [(9, 60)])}


# ---------------------------------------------------------------- nearest neighbours


@pytest.mark.parametrize("bits", [64, 100])
def test_packed_bits_in_blocks_and_groups(spark, monkeypatch, bits):
    monkeypatch.setattr(matching, "QUERY_BLOCK", 17)
    monkeypatch.setattr(matching, "POINT_BLOCK", 23)
    rng = np.random.default_rng(bits)
    v = rng.integers(0, 2, (150, bits)).astype(np.uint8)
    v[40:60] = v[3]
    packed = np.packbits(v, axis=1)
    df = spark.createDataFrame([(i, i, i % 3, bytes(p)) for i, p in enumerate(packed)] + [(900, 900, 0, None), (901, 901, None, bytes(packed[0])), (None, None, 0, bytes(packed[0]))], "query_id long, point_id long, g long, vec binary")
    got = matching.nearest(df, df, 4, "hamming", other_than_self=True, within=["g"]).collect()
    for q in range(150):
        want = sorted((int((v[q] != v[p]).sum()), p) for p in range(q % 3, 150, 3) if p != q)[:4]
        mine = sorted((r["rank"], r["dist"], r["point_id"]) for r in got if r["query_id"] == q)
        assert [m[1:] for m in mine] == [(float(d), p) for d, p in want] and [m[0] for m in mine] == [1, 2, 3, 4]
    assert len(got) == 600


def test_nothing_and_unlike_lengths(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0])], "query_id long, point_id long, vec array<double>")
    assert matching.nearest(df.where("false"), df, 2).count() == 0 and matching.nearest(df, df.where("false"), 2).count() == 0
    odd = df.unionByName(spark.createDataFrame([(2, 2, [1.0])], df.schema))
    with pytest.raises(Exception, match="unlike lengths"):
        matching.nearest(odd, odd, 1).collect()
    with pytest.raises(ValueError):
        matching.nearest(df, df, 1, "manhattan")


def test_no_query_passes_through_the_driver(spark):
    """100 000 queries: one plan of scans and shuffles; neither side is collected or broadcast."""
    df = spark.range(100_000).select(F.col("id").alias("query_id"), F.col("id").alias("point_id"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    text = matching.nearest(df, df, 2)._jdf.queryExecution().executedPlan().toString()
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before and "CoGroupsInArrow" in text


def test_stride_of_many_picks(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").alias("i"))
    got = trajectories.stride_sample(rows, "g", ["i"], 50_000).agg(F.count("*"), F.sum("i")).first()
    want = [int(k * (1_000_000 / 50_000)) for k in range(50_000)]
    assert tuple(got) == (50_000, sum(want))
    for n, most in ((1_000_003, 333_333), (99_999, 70_001), (7, 6), (5, 4)):
        mine = trajectories.stride_sample(spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("i")), "g", ["i"], most).agg(F.count("*"), F.sum("i")).first()
        picks = {int(k * (n / most)) for k in range(most)}
        assert tuple(mine) == (len(picks), sum(picks))
