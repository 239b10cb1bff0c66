"""Messages and sensors in batch and stream, the gate's reasons, images as arrays."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geometry
from waymark.operators import navigation, trajectories
from waymark.streaming import sensors

A, B = [0.0, 0.0, 0.0], [20.0, 0.0, 0.0]


def start(s, n, **x):
    return {"session_id": s, "seq": n, "type": "session_start", "user_id": "u", "map_id": "m", "start": A, "goal": B, "position": None, **x}


def at(s, n, *p, **x):
    return {"session_id": s, "seq": n, "type": "position_frame", "user_id": None, "map_id": None, "start": None, "goal": None, "position": list(map(float, p)), **x}


def end(s, n):
    return at(s, n) | {"type": "session_end", "position": None}


#: A scripted log: unknown sessions, missing fields, a replan, an arrival, frames after it and after the end, a second start.
LOG = [
    at("a", 1, 0, 0, 0), start("a", 2, map_id=None), start("a", 3, user_id=None, goal=None), start("a", 4), at("a", 5, 1, 0, 0), at("a", 6, 1, 0, 7), at("a", 7, 2, 0, 7),
    at("a", 8, 1, 0) , at("a", 9, 19.5, 0, 0), at("a", 10, 0, 0, 0), {**end("a", 11), "type": "hello"}, end("a", 12), at("a", 13, 1, 1, 1), start("a", 14), at("a", 15, 1, 0, 0),
    end("b", 1), at("b", 2, 0, 0, 0), start("b", 3, start=[1.0]), end(None, 1), at(None, 2, 1, 2, 3), start("c", 1), at("c", 2, 0.5, 0, 0),
]


def plain(rows):
    return sorted((r["session_id"] or "", r["seq"], r["nth"], r["type"], r["message"], r["status"], r["path_index"], r["n_remaining"], r["replan"], r["arrival"], None if r["deviation"] is None else round(r["deviation"], 6)) for r in rows)


def test_messages_are_answered_by_the_rules(spark):
    got = navigation.exchange(spark.createDataFrame(LOG, navigation.EVENTS).repartition(3)).collect()
    kinds = {(r["session_id"], r["seq"], r["nth"]): (r["type"], r["message"]) for r in got}
    assert kinds["a", 1, 0] == ("error", "Session a not found") and kinds["a", 2, 0] == ("error", "Missing field map_id") and kinds["a", 3, 0] == ("error", "Missing field user_id")
    assert kinds["a", 4, 0][0] == "session_started" and kinds["a", 5, 0][0] == "position_update"
    assert [kinds["a", 6, k] for k in (0, 1)] == [("position_update", None), ("replan", "deviation")] and ("a", 7, 1) not in kinds
    assert kinds["a", 8, 0] == ("error", "session_id and position required")
    ninth = [kinds[k][0] for k in sorted(k for k in kinds if k[:2] == ("a", 9))]
    assert ninth[0] == "position_update" and ninth[-1] == "session_completed"
    assert kinds["a", 10, 0][0] == "position_update" and next(r for r in got if (r["session_id"], r["seq"]) == ("a", 10))["status"] == "completed"
    assert kinds["a", 11, 0] == ("error", "Unknown message type: hello") and kinds["a", 12, 0][0] == "session_ended" and kinds["a", 13, 0] == ("error", "Session a not found")
    assert kinds["a", 15, 0][0] == "position_update" and kinds["b", 1, 0][0] == "session_ended" and kinds["b", 3, 0] == ("error", "start and goal must be three numbers")
    assert kinds[None, 1, 0] == ("error", "session_id required") and kinds[None, 2, 0] == ("error", "session_id and position required")


def test_messages_in_batch_and_stream_agree(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, rows in enumerate((LOG[:6], LOG[6:10] + LOG[15:17], LOG[10:15] + LOG[17:])):  # sessions span micro-batches
            spark.createDataFrame(rows, navigation.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(navigation.EVENTS).parquet(str(tmp_path / "in"))
            q = navigation.exchange_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(180)
        assert plain(spark.read.parquet(str(tmp_path / "out")).collect()) == plain(navigation.exchange(spark.createDataFrame(LOG, navigation.EVENTS)).collect())
        # only c, and a since its second start, are held
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 3
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def moments(seed, n):
    rng = np.random.default_rng(seed)
    zero = dt.datetime(2024, 1, 1)
    frames = [("s%d" % (i % 2), i, zero + dt.timedelta(milliseconds=100 * i)) for i in range(n)]
    samples = [("s%d" % rng.integers(0, 3), i, str(rng.choice(["accel", "gyro", "magnet", "other"])), zero + dt.timedelta(milliseconds=int(rng.integers(0, 100 * n))), float(i), 0.0, 1.0) for i in range(6 * n)]
    # exactly 50 ms, 51 ms, and two equally near ones
    samples += [("s0", 9000, "magnet", zero + dt.timedelta(milliseconds=50), 1.0, 2.0, 3.0), ("s1", 9001, "gyro", zero + dt.timedelta(milliseconds=151), 1.0, 2.0, 3.0)]
    return frames, samples


FRAMES, SAMPLES = "session_id string, frame_id long, frame_time timestamp", "session_id string, sample_id long, type string, sample_time timestamp, x double, y double, z double"


def test_sensors_in_batch_and_stream_agree_and_are_let_go(spark, tmp_path):
    frames, samples = moments(1, 120)
    batch = sensors.matched(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(samples, SAMPLES)).collect()
    for r in batch:
        for kind in sensors.KINDS:
            near = sorted((abs((s[3] - r["frame_time"]) / dt.timedelta(milliseconds=1)), s[3], s[1], s[4]) for s in samples if s[0] == r["session_id"] and s[2] == kind)
            want = (near[0][3], near[0][0]) if near and near[0][0] <= 50 else None
            assert (r[kind] and (r[kind]["x"], r[kind]["dt_ms"])) == want
    # four micro-batches of three seconds each
    for k in range(4):
        inside = lambda t: 3 * k <= (t - dt.datetime(2024, 1, 1)).total_seconds() < 3 * k + 3  # noqa: B023, E731
        spark.createDataFrame([f for f in frames if inside(f[2])], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        spark.createDataFrame([s for s in samples if inside(s[3])], SAMPLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    later = dt.datetime(2024, 1, 1, 1)  # what closes the last frames
    spark.createDataFrame([("z", 99999, later)], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    spark.createDataFrame([("z", 99999, "gyro", later, 0.0, 0.0, 0.0)], SAMPLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / name))
    q = sensors.matched_stream(read("f", FRAMES), read("s", SAMPLES)).writeStream.format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    key = lambda rows: sorted((r["frame_id"], *(r[k] and tuple(r[k]) for k in sensors.KINDS)) for r in rows if r["frame_id"] < 99999)
    got = spark.table("matched").collect()
    assert key(got) == key(batch)
    held = [p["stateOperators"][-1]["numRowsTotal"] + sum(s["numRowsTotal"] for s in p["stateOperators"][:-1]) for p in q.recentProgress if p["stateOperators"]]
    # all but the last rows are let go in the end
    assert max(held) > 0 and q.lastProgress["stateOperators"][0]["numRowsTotal"] < 20


def test_the_gate_tells_why_and_counts_frames(spark):
    rows = [("s", i, float(i), x) for i, x in enumerate((0.0, 2.0, 2.1, 9.0, 9.0, 9.5, 40.0, 12.0))] + [("t", 0, 0.0, 5.0), ("t", 1, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "s string, i long, t double, x double")
    gate = trajectories.Gate(1.0, speed=8.0, frames=2)
    got = {(r["s"], r["i"]): r["reason"] for r in trajectories.keyframe_gate(df, "s", "i", "t", ["x"], gate).collect()}
    # 2.0 comes one frame after the first, which is too soon; 2.1 is then far enough and late enough
    assert got == {("s", 0): None, ("s", 1): "soon", ("s", 2): None, ("s", 3): "soon", ("s", 4): None, ("s", 5): "near", ("s", 6): "fast", ("s", 7): None, ("t", 0): None, ("t", 1): "soon"}


@pytest.mark.parametrize("every", [1, 2, 3])
def test_sharpness_against_plain_loops(spark, every):
    rng = np.random.default_rng(every)
    images = [rng.integers(0, 256, (h, w)) for h, w in ((5, 5), (12, 9), (7, 16), (4, 9), (9, 3))]
    df = spark.createDataFrame([(i, [int(x) for x in m.ravel()], m.shape[1], m.shape[0]) for i, m in enumerate(images)] + [(9, None, 8, 8)], "i int, p array<int>, w int, h int")
    got = {r["i"]: r["s"] for r in df.select("i", geometry.laplacian_variance(F.col("p"), F.col("w"), F.col("h"), every).alias("s")).collect()}
    for i, m in enumerate(images):
        e = [abs(4.0 * m[y, x] - m[y, x - 1] - m[y, x + 1] - m[y - 1, x] - m[y + 1, x]) for y in range(2, m.shape[0] - 2, every) for x in range(2, m.shape[1] - 2, every)]
        assert got[i] == pytest.approx(np.mean(np.square(e)) - np.mean(e) ** 2 if e else 100.0)
    assert got[9] is None


def test_grids_in_other_sizes(spark):
    for w, h, nw, nh in ((4, 3, 9, 7), (9, 7, 4, 3), (5, 5, 5, 5), (1, 1, 3, 2), (640 // 40, 480 // 40, 256 // 40, 192 // 40)):
        m = np.arange(w * h).reshape(h, w)
        got = spark.range(1).select(geometry.resized_nearest(F.array(*[F.lit(int(x)) for x in m.ravel()]), F.lit(w), F.lit(h), F.lit(nw), F.lit(nh)).alias("g")).first()["g"]
        assert got == [int(m[min(j * h // nh, h - 1), min(i * w // nw, w - 1)]) for j in range(nh) for i in range(nw)]
