"""Every query with SQL against DuckDB, and the operators on small tables."""

import json
import math
import sqlite3
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import codecs, geometry, text
from waymark.operators import localize, matching, navigation, trajectories
from waymark.plans.catalog import ORACLE_SQL, QUERIES
from waymark.sources.maps import read_map

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(frame):
    value = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(map(str, frame[sorted(frame)].map(value).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert plain(got) == plain(want)


def test_quaternion_branches(spark):
    def matrix(x, y, z, w):
        return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]

    qs = [(0.1, 0.2, 0.3, 0.9), (0.9, 0.1, 0.2, 0.1), (0.1, 0.9, 0.2, 0.1), (0.1, 0.2, 0.9, 0.1)]
    qs = [tuple(c / math.sqrt(sum(v * v for v in q)) for c in q) for q in qs]
    df = spark.createDataFrame([tuple(matrix(*q)) for q in qs], [f"r{i}" for i in range(9)])
    rows = df.select(*geometry.canonical(geometry.quaternion([F.col(f"r{i}") for i in range(9)]))).collect()
    for q, r in zip(qs, rows):
        assert all(abs(a - b) < 1e-9 for a, b in zip(q, r))


def test_stride_takes_the_whole_part_of_each_step(spark):
    sizes = [1, 49, 50, 51, 113, 150, 999, 1500]
    df = spark.createDataFrame([(g, i) for g in sizes for i in range(g)], "g long, i long")
    got = trajectories.stride_sample(df, "g", ["i"], 50).groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("i")).collect()
    assert {r["g"]: r["i"] for r in got} == {n: sorted({int(k * (n / 50)) for k in range(50)}) if n > 50 else list(range(n)) for n in sizes}


def test_neighbours_in_blocks_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, size=(300, 8)).astype(float)
    v[100:140] = v[7]  # ties go to the lesser id
    df = spark.createDataFrame([(i, i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, 900, None)], "query_id long, point_id long, vec array<double>")
    monkeypatch.setattr(matching, "QUERY_BLOCK", 7)
    monkeypatch.setattr(matching, "POINT_BLOCK", 11)
    distance = {
        "l2": lambda a, b: float(np.sqrt(((a - b) ** 2).sum())),
        "hamming": lambda a, b: float(((a > 0) != (b > 0)).sum()),
        "cosine": lambda a, b: 1 - float((a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b))),
    }
    for metric, f in distance.items():
        got = matching.nearest(df.where("query_id % 10 = 0"), df, 3, metric, other_than_self=True).collect()
        for q in range(0, 300, 10):
            best = sorted((round(f(v[q], v[p]), 9), p) for p in range(300) if p != q)[:3]
            mine = sorted((r["rank"], round(r["dist"], 9), r["point_id"]) for r in got if r["query_id"] == q)
            assert [m[1] for m in mine] == [b[0] for b in best]
            assert metric == "cosine" or [m[2] for m in mine] == [b[1] for b in best]


def test_gate_with_rotations():
    gate = trajectories.Gate(0.01, speed=5.0, turn=1.0)
    still, turned = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0, 0.0, math.sin(0.02), math.cos(0.02))
    assert gate.reason(None, 0.0, still) is None and gate.reason((0.0, still), 1.0, still) == "near"
    assert gate.step((0.0, still), 1.0, turned) and gate.reason((0.0, still), 0.1, (9.0, *still[1:])) == "fast"


def test_gyro_turns_against_a_plain_fold(spark):
    rows = [(0.0, 9.0, 9.0, 9.0), (0.1, 1.0, 0.5, -0.3), (0.3, -0.2, 0.1, 0.9)]
    got = spark.range(1).select(geometry.turned_by_gyro(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, "txyz")]) for r in reversed(rows)])).alias("q")).first()["q"]
    q, last = np.array([0, 0, 0, 1.0]), 0.0
    for t, *w in rows:
        a, b, c = (np.array(w) * (t - last) / 2).tolist()
        last = t
        # about y, then x, then z
        for axis, h in ((2, c), (0, b), (1, a))[::-1]:
            e = np.zeros(4)
            e[axis], e[3] = math.sin(h), math.cos(h)
            x, y, z, u = q
            q = np.array([u * e[0] + x * e[3] + y * e[2] - z * e[1], u * e[1] - x * e[2] + y * e[3] + z * e[0], u * e[2] + x * e[1] - y * e[0] + z * e[3], u * e[3] - x * e[0] - y * e[1] - z * e[2]])
    assert np.allclose(got, q, atol=1e-9)


def test_localize_from_descriptors_to_floors(spark):
    """Two images of a scene of two nodes: one is seen well, of the other only descriptors match."""
    rng = np.random.default_rng(5)
    world = rng.uniform(-3, 3, size=(60, 3))
    vec = rng.normal(size=(60, 16))
    shift = {1: np.zeros(3), 2: np.array([1.0, 2.0, 0.5])}
    node = [1 + i % 2 for i in range(60)]
    pts = [(i, node[i], *(map(float, world[i] - shift[node[i]]) if i < 55 else (None,) * 3), [float(x) for x in vec[i]]) for i in range(60)]
    r, at = localize.turned(np.array([0.1, -0.2, 0.05])), np.array([0.2, 0.1, 8.0])
    uv = localize.project(world, r, at) * 500 + 300
    rows = [(i, 0, *map(float, uv[i]), [float(x) for x in vec[i]]) for i in range(60)]
    rows += [(100 + i, 1, *map(float, rng.uniform(0, 600, 2)), [float(x) for x in vec[i] + 0.01]) for i in range(40, 60)]
    queries = spark.createDataFrame(rows, "query_id long, image long, u double, v double, vec array<double>")
    points = spark.createDataFrame(pts, "point_id long, node long, x double, y double, z double, vec array<double>")
    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    poses = spark.createDataFrame([(k, [float(x) for x in eye], [float(x) for x in t]) for k, t in shift.items()], "node long, r array<double>, t array<double>")
    for name in ("ratio", "mutual"):
        got = {x["image"]: x for x in localize.localize(queries, points, poses, (500.0, 500.0, 300.0, 300.0), name).collect()}
        assert got[0]["method"] == "pose" and got[0]["num_inliers"] == 55 and got[0]["num_matches"] == 60
        assert np.allclose([got[0][c] for c in "xyz"], -r.T @ at, atol=0.02)
        if name == "mutual":  # the other image's descriptors are nearer
            assert 1 not in got
            continue
        assert got[1]["method"] == "votes" and got[1]["x"] is None and got[1]["confidence"] == 0.5


def test_chunk_streams(spark, tmp_path):
    from waymark.streaming import ingest

    frames = lambda c, n: json.dumps([{"session_id": "s", "chunk_index": c, "frame_index": c * 1000 + i, "at": f"2024-01-01T00:00:{c * 4 + i:02d}Z"} for i in range(n)])
    (tmp_path / "in").mkdir()
    for name, text in (("a", frames(0, 3)), ("b", frames(1, 2)), ("again", frames(1, 2)), ("bad", "[{")):
        (tmp_path / "in" / f"{name}.json").write_text(text)
    schema = T.StructType().add("session_id", "string").add("chunk_index", "integer").add("frame_index", "integer").add("at", "timestamp")
    stream = ingest.deduplicated(ingest.chunk_stream(spark, str(tmp_path / "in"), schema), "at")
    q = stream.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["frame_index"] for r in spark.table("frames").collect()) == [0, 1, 2, 1000, 1001]
    batch = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(str(tmp_path / "in"))
    closed = ingest.closed_sessions(batch.dropDuplicates(["frame_index"]), "at", "3 seconds").collect()
    assert [(r["total_frames"], r["total_chunks"]) for r in closed] == [(5, 2)]


def test_gate_in_batch_and_stream(spark, tmp_path):
    rows = [(s, i, float(i), x) for s in (1, 2) for i, x in enumerate([0.0, 0.4, 0.9, 1.1, 1.5, 2.3, 2.2, 9.0])]
    df = spark.createDataFrame(rows, "s long, i long, t double, x double")
    gate = trajectories.Gate(1.0, speed=3.0)
    want = {}
    for s in (1, 2):
        last = None
        for _, i, t, x in (r for r in rows if r[0] == s):
            want[s, i] = gate.step(last, t, (x,))
            last = (t, (x,)) if want[s, i] else last
    got = trajectories.keyframe_gate(df, "s", "i", "t", ["x"], gate).collect()
    assert {(r["s"], r["i"]): r["accepted"] for r in got} == want and not want[1, 7]
    for k in (0, 1):
        df.where(f"i div 4 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = trajectories.gate_stream(stream, "s", "i", "t", ["x"], gate).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["s"], r["i"]) for r in spark.table("gated").collect()} == set(want)


def test_sqlite_source_and_poses(spark, tmp_path):
    path = str(tmp_path / "map.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE Node (id INTEGER PRIMARY KEY, stamp REAL, pose BLOB)")
        pose = struct.pack("<12f", *range(12))
        c.executemany("INSERT INTO Node VALUES (?, ?, ?)", [(1, 0.5, pose), (2, None, None), (3, 1.0, b"x" * 47), (4, 1.0, bytes(48)), (9, 2.0, pose + b"zzzz")])
    df = read_map(spark, path, "Node").select("id", codecs.decode_pose(F.col("pose")).alias("p"), codecs.decode_pose(F.col("pose"), strict=False).alias("q"))
    got = {r["id"]: (r["p"], r["q"]) for r in df.collect()}
    assert got[1][0] == [float(i) for i in range(12)] and got[2] == (None, None) and got[3] == (None, None)
    assert got[4] == (None, [0.0] * 12) and got[9][0] is None and len(got[9][1]) == 12


def test_nearest_in_time_edges(spark):
    frames = spark.createDataFrame([(1, 10, 100), (1, 11, 200), (1, 12, 1000), (2, 13, 5)], "k long, f long, t long")
    samples = spark.createDataFrame([(1, 1, 50), (1, 2, 150), (1, 4, 150), (1, 3, 251)], "k long, s long, t long")
    got = {r["f"]: (r["s"], r["delta"]) for r in trajectories.nearest_in_time(frames, samples, ["k"], "f", "t", "s", 50).collect()}
    assert got == {10: (1, 50), 11: (2, 50), 12: (None, None), 13: (None, None)}


def test_matching_without_rows(spark):
    none = spark.createDataFrame([], "query_id long, point_id long, vec array<float>")
    assert matching.nearest(none, none, 2).count() == 0


def test_text_helpers(spark):
    df = spark.createDataFrame([("a:1;b:x:y;;", "d/e/f.tar.gz", "map_20240102_030405"), (None, "f", "map_x")], "p string, q string, m string")
    rows = df.select(text.params_map(F.col("p")).alias("p"), text.stem(F.col("q")).alias("q"), text.map_time(F.col("m")).alias("m")).collect()
    assert rows[0]["p"] == {"a": "1", "b": "x:y"} and rows[0]["q"] == "f.tar" and rows[0]["m"].year == 2024
    assert rows[1]["p"] is None and rows[1]["m"] is None


def test_pose_of_a_noisy_view(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for image in range(4):
        r, t = localize.turned(rng.normal(size=3)), np.array([0.3, -0.2, 9.0])
        points = rng.uniform(-3, 3, size=(60, 3))
        uv = localize.project(points, r, t) * 400 + 200 + rng.normal(scale=0.2, size=(60, 2))
        uv[:20] += rng.uniform(30, 90, size=(20, 2))
        rows += [(image, *map(float, a), *map(float, b)) for a, b in zip(uv, points)]
        want[image] = r, -r.T @ t
    rows += [(9, 1.0, 1.0, float(k), 0.0, 0.0) for k in range(30)] + [(10, 1.0, None, 0.0, 0.0, 0.0), (11, 1.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "image long, u double, v double, x double, y double, z double")
    got = {g["image"]: g for g in localize.solve_poses(df, "image", (400.0, 400.0, 200.0, 200.0)).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for image, (r, at) in want.items():
        g = got[image]
        assert g["num_correspondences"] == 60 and 38 <= g["num_inliers"] <= 42
        assert np.abs(np.array([g[c] for c in "xyz"]) - at).max() < 0.05
        x, y, z, w = (g[c] for c in ("qx", "qy", "qz", "qw"))
        forward = [1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w)]
        assert w >= 0 and np.abs(forward - r[2]).max() < 0.01  # the map's forward axis is the optical one


def test_pose_log_edges(spark):
    logs = ["POSE: 1 2 3 0 0 0 1\nLocalized 9 9 9 0 0 0 1", "x=1y=2 z=-3.5e0 qx=0 qy=0 qz=0 qw=1\nmatches=30\nmatches=12", "pose 1 2 3", "Pose 1 2 3 0 0 0 1\nmatches: 100 inliers: 1", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i long, log string")
    got = {r["i"]: (r["pose"], r["num_matches"], r["confidence"]) for r in localize.pose_log(df, "log").collect()}
    assert got[0] == ([1, 2, 3, 0, 0, 0, 1], 0, 0.5) and got[1] == ([1, 2, -3.5, 0, 0, 0, 1], 30, 0.5)
    assert all(got[i] == (None, None, None) for i in (2, 3, 4, 5))


def guided(positions, start, goal):
    """The rules of guidance written out point by point."""
    line = lambda a, b, n: [[u + (v - u) * i / (n - 1) for u, v in zip(a, b)] for i in range(n)]
    path, at, done, out = line(start, goal, 40), 0, False, []
    for p in positions:
        if done:
            out.append((None, None, None, "completed"))
            continue
        best, least = at, math.inf
        for i in range(max(0, at - 5), min(len(path), at + 10)):
            if math.dist(p, path[i]) < least:
                best, least = i, math.dist(p, path[i])
        if least > 10:
            for i, q in enumerate(path):
                if math.dist(p, q) < least:
                    best, least = i, math.dist(p, q)
        at, done, again = best, math.dist(p, goal) <= 1.5, least > 5
        if again:
            path, at = [p] + line(p, goal, max(20, len(path) - best)), 0
        out.append((at, len(path) - at - 1, again, "completed" if done else "running"))
    return out


def test_navigation_in_batch_and_stream(spark, tmp_path):
    walks = {1: [(0, 0, 0), (2, 0.5, 0), (9, 4, 0), (10, 11, 0), (30, 9, 0), (49, 1, 0), (50, 0, 0), (50, 0, 0)], 2: [(50, 30, 0), (20, 0, 0), (3, 0, 1), (48, 0, 0), (49.5, 1, 0)]}
    rows = [(s, i, *map(float, p), 0.0, 0.0, 0.0, 50.0, 0.0, 0.0) for s, w in walks.items() for i, p in enumerate(w)]
    df = spark.createDataFrame([*rows, (3, 0, None, *[0.0] * 8)], "s long, i long, x double, y double, z double, sx double, sy double, sz double, gx double, gy double, gz double")
    want = {(s, i): a for s, w in walks.items() for i, a in enumerate(guided([list(map(float, p)) for p in w], [0.0, 0.0, 0.0], [50.0, 0.0, 0.0]))}
    answers = lambda rows: {(r["s"], r["i"]): (r["path_index"], r["n_remaining"], r["replan"], r["status"]) for r in rows}
    assert answers(navigation.navigate(df, "s", "i").collect()) == want
    for k, part in enumerate(("i < 3", "i >= 3")):
        df.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = navigation.navigate_stream(stream, "s", "i").writeStream.format("memory").queryName("guided").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert answers(spark.table("guided").collect()) == want
