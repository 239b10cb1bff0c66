"""Map files both ways, frames that come again, chunk files, calibrations."""

import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringStartsWith

from waymark.functions import codecs
from waymark.operators import mapping
from waymark.sources import frames, maps

NODES = maps.TABLES["Node"] + ", map_id string"


def pose(i):
    return struct.pack("<12f", 1, 0, 0, i, 0, 1, 0, 2 * i, 0, 0, 1, 3)


def nodes(spark, names, n=40):
    return spark.createDataFrame([(i, float(i), pose(i) if i % 4 else None, m) for m in names for i in range(1, n + 1)], NODES)


def test_written_maps_come_back_and_filters_run_in_the_files(spark, tmp_path):
    folder = str(tmp_path / "maps")
    maps.write_maps(nodes(spark, ["map_20240101_000000", "b", "c"]), folder, "Node")
    back = maps.read_map(spark, folder, "Node")
    assert back.count() == 120 and sorted(map(str, back.collect())) == sorted(map(str, nodes(spark, ["map_20240101_000000", "b", "c"]).collect()))
    found = back.where("map_id = 'b' and id = 7 and pose is not null")
    assert [r["stamp"] for r in found.collect()] == [7.0]
    assert maps.read_map(spark, f"{folder}/b.db", "Node", low=7, high=7).rdd.getNumPartitions() == 1
    assert back.where("id > 38 and id <= 39 or stamp = 3").count() == 6
    assert {r["map_id"] for r in back.where("map_id in ('b', 'c') and stamp < 2.5").collect()} == {"b", "c"}
    assert back.where("map_id like 'map%' and id in (1, 40)").count() == 2 and back.where("id = 3.5").count() == 0


def test_a_point_lookup_reads_one_row(spark, tmp_path):
    maps.write_maps(nodes(spark, ["a"], 1000), str(tmp_path), "Node")
    reader = maps.PushingMapReader({"path": str(tmp_path), "numpartitions": "10"}, ["id", "map_id"])
    odd = StringStartsWith(("pose",), "x")
    left = list(reader.pushFilters([EqualTo(("id",), 555), IsNotNull(("id",)), odd, EqualTo(("a", "b"), 1)]))
    assert left == [odd, EqualTo(("a", "b"), 1)]
    parts = reader.partitions()
    assert len(parts) == 1 and [r for p in parts for r in reader.read(p)] == [(555, "a")] and reader.rows_read == 1
    reader = maps.PushingMapReader({"path": str(tmp_path), "numpartitions": "10"}, ["id"])
    assert list(reader.pushFilters([GreaterThan(("id",), 250), LessThanOrEqual(("id",), 300), In(("id",), (260, 299, 999))])) == []
    assert len(reader.partitions()) == 1 and sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == [260, 299]


def test_names_are_checked(spark, tmp_path):
    for options, columns in (({"path": "x", "table": 'Node"; DROP'}, ["id"]), ({"path": "x"}, ['id", 1 --'])):
        with pytest.raises(ValueError):
            maps.SqliteMapReader(options, columns)
    with pytest.raises(Exception, match="can't name"):
        maps.write_maps(nodes(spark, ["../evil"], 2), str(tmp_path / "m"), "Node")
    assert list((tmp_path / "m").glob("*.db")) == []


def test_maps_appear_whole_or_not_at_all(spark, tmp_path):
    folder = tmp_path / "maps"
    maps.write_maps(nodes(spark, ["a"], 3), str(folder), "Node")
    with pytest.raises(Exception, match="there already"):
        maps.write_maps(nodes(spark, ["a", "b"], 5), str(folder), "Node")
    assert [p.name for p in folder.iterdir()] == ["a.db"] and maps.read_map(spark, str(folder), "Node").count() == 3
    # a key that is there twice kills the task: nothing of the job stays
    twice = nodes(spark, ["a", "z"], 4).unionByName(nodes(spark, ["z"], 1))
    with pytest.raises(Exception):
        maps.write_maps(twice, str(folder), "Node", overwrite=True)
    assert [p.name for p in folder.iterdir()] == ["a.db"] and maps.read_map(spark, str(folder), "Node").count() == 3
    maps.write_maps(nodes(spark, ["a", "b"], 5), str(folder), "Node", overwrite=True)
    assert sorted(p.name for p in folder.iterdir()) == ["a.db", "b.db"] and maps.read_map(spark, str(folder), "Node").count() == 10


def test_broken_files_are_told_and_skipped(spark, tmp_path):
    maps.write_maps(nodes(spark, ["map_20240305_101112", "plain"], 8), str(tmp_path), "Node")
    (tmp_path / "bad.db").write_bytes(b"this is no database" * 100)
    with sqlite3.connect(tmp_path / "empty.db") as c:
        c.execute("CREATE TABLE other (x)")
    with pytest.raises(Exception, match="bad.db"):
        maps.read_map(spark, str(tmp_path), "Node").count()
    assert maps.read_map(spark, str(tmp_path), "Node", broken="skip").count() == 16
    got = maps.catalogue(spark, str(tmp_path)).collect()
    assert [(r["map_id"], r["keyframes"], r["error"] is None) for r in got] == [("bad", None, False), ("empty", None, False), ("map_20240305_101112", 6, True), ("plain", 6, True)]
    assert str(got[2]["created_at"]) == "2024-03-05 10:11:12" and got[3]["created_at"] is None
    assert maps.catalogue(spark, str(tmp_path / "none")).count() == 0
    one = maps.fixed_map(maps.catalogue(spark, str(tmp_path)), "plain")
    assert one.count() == 1 and maps.fixed_map(maps.catalogue(spark, str(tmp_path)), "bad").count() == 0


def test_keypoints_images_and_calibrations(spark, tmp_path):
    with sqlite3.connect(tmp_path / "m.db") as c:
        c.execute("CREATE TABLE Data (id INTEGER PRIMARY KEY, image BLOB, depth BLOB, calibration BLOB)")
        c.executemany("INSERT INTO Data VALUES (?, ?, NULL, ?)", [(i, None if i % 3 == 0 else b"image%d" % i, b"cal%d" % i if i > 4 else None) for i in range(1, 30)])
        c.execute("CREATE TABLE Feature (node_id, pos_x, pos_y, depth_x, depth_y, depth_z, descriptor_size, descriptor)")
        c.executemany("INSERT INTO Feature VALUES (?, ?, 2.0, NULL, NULL, NULL, 0, NULL)", [(1, 1.0), (1, None), (2, 5.0)])
    path = str(tmp_path / "m.db")
    assert [(r["id"], bytes(r["image"])) for r in maps.images(spark, path, [2, 3, 29, 77]).orderBy("id").collect()] == [(2, b"image2"), (29, b"image29")]
    assert [(r["map_id"], r["id"], bytes(r["calibration"])) for r in maps.first_calibrations(spark, path).collect()] == [("m", 5, b"cal5")]
    assert maps.keypoints(spark, path).count() == 2


def test_calibrations_both_ways(spark):
    good = struct.pack("<3i i 2i 4i i 9d 12f", 0, 21, 4, 0, 640, 480, 9, 0, 0, 0, 12, 525.5, 0, 319.5, 0, 526.5, 239.5, 0, 0, 1, *[0.0] * 12)
    bad = struct.pack("<3i i 2i 4i i 9d 12f", 0, 21, 4, 0, 640, 0, 9, 0, 0, 0, 12, 525.5, 0, 319.5, 0, 526.5, 239.5, 0, 0, 1, *[0.0] * 12)
    df = spark.createDataFrame([(1, good), (2, good[:-1]), (3, bad), (4, None), (5, good + b"x")], "id long, b binary")
    got = {r["id"]: r["k"] and tuple(r["k"]) for r in df.select("id", codecs.decode_calibration(F.col("b")).alias("k")).collect()}
    want = (525.5, 526.5, 319.5, 239.5, 640, 480)
    assert got == {1: want, 2: None, 3: None, 4: None, 5: None}
    made = spark.createDataFrame([want], codecs.INTRINSICS).select(codecs.encode_calibration("fx", "fy", "cx", "cy", "width", "height").alias("b"))
    assert tuple(made.select(codecs.decode_calibration(F.col("b")).alias("k")).first()["k"]) == want


def test_keyframe_list(spark):
    turned = struct.pack("<12f", -1, 0, 0, 1, 0, -1, 0, 2, 0, 0, 1, 3)
    df = spark.createDataFrame([(1, pose(5)), (2, turned + b"more"), (3, b"short"), (4, None)], "id long, pose binary")
    got = {r["id"]: tuple(r)[1:] for r in mapping.keyframe_list(df).collect()}
    assert got[1] == (5.0, 10.0, 3.0, 0.0, 0.0, 0.0, 1.0) and got[2] == (1.0, 2.0, 3.0, 0.0, 0.0, 1.0, 0.0)
    assert got[3] == got[4] == (None,) * 7


# ---------------------------------------------------------------- frames


FRAME = "session_id string, chunk_index int, frame_index long, image string, at long"


def test_a_repeated_batch_leaves_one_copy_of_each_frame(spark, tmp_path):
    path = str(tmp_path / "frames")
    batch = spark.createDataFrame([("s", 0, i, f"i{i}", 1) for i in range(5)] + [("s", 1, 1000, "x", 1), (None, 0, 1, "lost", 1)], FRAME)
    frames.save_frames(batch, path, "at")
    frames.save_frames(batch, path, "at")
    part = spark.createDataFrame([("s", 0, 4, "newer", 2), ("s", 0, 5, "i5", 2), ("t", 0, 0, "other", 2)], FRAME)
    frames.save_frames(part, path, "at")
    # a merge that died half way leaves its folder behind; the batch is repeated
    batch.write.mode("overwrite").parquet(f"{path}_merging")
    frames.save_frames(part, path, "at")
    got = {(r["session_id"], r["frame_index"]): r["image"] for r in frames.known_frames(spark, path, part.schema).collect()}
    assert got == {**{("s", i): f"i{i}" for i in (0, 1, 2, 3, 5)}, ("s", 4): "newer", ("s", 1000): "x", ("t", 0): "other"}
    assert frames.known_frames(spark, path, part.schema).count() == len(got)
    asked = spark.createDataFrame([("s", "2024-01-01"), ("s", "2024-01-02"), ("new", "2024-01-03"), (None, "2024-01-03")], "session_id string, d string")
    new = frames.created_sessions(asked.select("session_id", F.to_timestamp("d").alias("created_at"), F.create_map(F.lit("d"), "d").alias("device_info")))
    told = {r["session_id"]: (r["device_info"]["d"], r["status"], r["total_frames"], r["total_chunks"]) for r in frames.session_totals(frames.known_frames(spark, path, part.schema), new).collect()}
    assert told == {"s": ("2024-01-01", "scanning", 7, 2), "new": ("2024-01-03", "scanning", 0, 0)}


def test_the_sink_survives_a_killed_batch(spark, tmp_path):
    path, source = str(tmp_path / "frames"), tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"session_id": "s", "chunk_index": 0, "frame_index": i, "image": f"i{i}", "at": 1}) for i in range(4)))
    stream = lambda: spark.readStream.schema(FRAME).json(str(source)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)

    def dies(batch, batch_id):
        frames.save_frames(batch, path, "at")
        raise RuntimeError("killed after writing, before the batch was told done")

    with pytest.raises(Exception, match="killed"):
        stream().foreachBatch(dies).start().awaitTermination(120)
    stream().foreachBatch(frames.frame_sink(path, "at")).start().awaitTermination(120)
    assert sorted(r["frame_index"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]


def test_chunk_files_in_order_of_place(spark, tmp_path):
    f = lambda i, p, t: {"frame_index": i, "image_path": p, "timestamp": t}
    (tmp_path / "chunk_0000.json").write_text(json.dumps([f(9, "images/a.jpg", 1), f(2, "images/a.png", 2), f(3, None, 3), f(4, "images/b.jpg", 4)]))
    (tmp_path / "chunk_0001.json").write_text(json.dumps([f(1, "images/b.jpg", 5)]))
    (tmp_path / "chunk_0002.json").write_text("[{broken")
    (tmp_path / "chunk_0003.json").write_text("[]")
    schema = "frame_index long, image_path string, timestamp long"
    got = {r["stem"]: (r["frame_index"], r["timestamp"]) for r in maps.frame_metadata(spark, str(tmp_path), schema).collect()}
    assert got == {"a": (2, 2), "b": (1, 5)}  # the last place wins although its index is less
    assert [(r["chunk_file"], r["place"]) for r in maps.chunk_frames(spark, str(tmp_path), schema).orderBy("chunk_file", "place").collect()] == [("chunk_0000.json", i) for i in range(4)] + [("chunk_0001.json", 0)]


def test_image_listing(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt", "d.jpeg"):
        (tmp_path / n).write_bytes(b"123")
    assert [r["stem"] for r in maps.image_files(spark, str(tmp_path)).collect()] == ["a", "b", "d"]
