"""What the findings of round 4 were about."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from waymark.operators import localize, mapping
from waymark.plans.catalog import ORACLE_SQL, QUERIES

from .test_round3 import against_sql


def floor_tables(lines: list[tuple], **more) -> dict:
    """Sixty maps in 25 buildings, thirty images, and lines (image, map, discount, quantity)."""
    columns = lambda names, rows: dict(zip(names, map(list, zip(*rows))))
    supplier = [(m, m % 25) for m in range(60)] + more.get("maps", [])
    orders = [(i, i % 50) for i in range(30)] + more.get("images", [])
    return {
        "supplier": columns(("s_suppkey", "s_nationkey"), supplier),
        "orders": columns(("o_orderkey", "o_custkey"), orders),
        "lineitem": columns(("l_orderkey", "l_suppkey", "l_discount", "l_quantity"), lines),
    }


def test_floors_are_looked_up_and_not_paired_with_images(spark, tmp_path):
    """Every image with every map of its building is the square of a table that grows: results that are there are looked up."""
    r = random.Random(1)
    lines = [(r.randrange(30), r.randrange(60), r.choice([0.0, 0.02, 0.03, 0.05]), float(r.randrange(1, 6))) for _ in range(3000)]
    got, want = against_sql(spark, tmp_path, "floors_of_requests", floor_tables(lines))
    assert got == want and len({x[-1] for x in got}) > 1
    plan = QUERIES["floors_of_requests"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    by_building = [x for x in plan.split("\n") if "Join Inner" in x and "building#" in x]
    assert by_building and all("image#" in x for x in by_building)
    # those of another building's maps don't count, however they come, and floors without a result have their row
    requests = spark.createDataFrame([(1, 7, 3), (None, 7, 4), (2, 8, 3), (3, None, 3)], "request long, building int, image long")
    floors = spark.createDataFrame([(7, 0, 70), (7, None, 71), (8, 0, 80), (None, 0, 90)], "building int, level long, map long")
    found = spark.createDataFrame([(m, i, m + i, None if m == 70 and i == 3 else 0.5) for m in (70, 71, 90) for i in (3, 4)], "map long, image long, num_matches long, confidence double")
    per = localize.floor_results(requests, floors.withColumn("building", floors["building"].cast("long")), lambda _: found)
    rows = {(x["request"], x["building"], x["level"]): (x["map"], x["image"], x["num_matches"]) for x in per.collect()}
    assert dict(per.dtypes)["building"] == "int"  # as requests have it
    none = (None, None, None)
    assert rows == {(1, 7, 0): none, (1, 7, None): (71, 3, 74), (None, 7, 0): (70, 4, 74), (None, 7, None): (71, 4, 75), (2, 8, 0): none}


def test_floors_over_odd_tables(spark, tmp_path):
    """Halves are rounded as SQL rounds them, and no building is said to have no map where one is missing."""
    r = random.Random(2)
    lines = [(r.randrange(30), r.randrange(60), r.choice([0.02, 0.03, 0.05]), r.randrange(2, 12) / 2) for _ in range(3000)]
    cases = {"halves": {}, "no customer": {"images": [(7, None), (None, 5)]}, "no nation": {"maps": [(3, 5), (4, None), (None, 4)]}, "copies": {"images": [(7, 7), (7, 7)], "maps": [(3, 3), (3, 3)]}}
    for name, more in cases.items():
        (tmp_path / name).mkdir()
        got, want = against_sql(spark, tmp_path / name, "floors_of_requests", floor_tables(lines, **more))
        assert got == want and len(got) >= 30, name


def test_upserts_over_files_take_the_first_row_of_the_first_file(spark, tmp_path):
    """Rows' numbers begin anew in each file; lines without a number, suppliers of one key and without one, as SQL has them.

    With several threads SQL itself takes one or the other of such lines, so it has one here.
    """
    r = random.Random(3)
    some = lambda x: None if r.random() < 0.05 else x
    line = [(some(r.randrange(60)), some(r.randrange(6)), some(r.choice([3, 7])), some(r.choice("ANR")), some(float(k))) for k in range(3000)]
    line += [(s, 9, 7, "AR"[k // 40 % 2], float(k)) for k in range(80) for s in [100 + k % 40]]  # none of these is missing
    supplier = [(s, f"s{i}", i / 2) for i, s in enumerate([*range(150), 3, 3, 120, None, None])]
    db = duckdb.connect()
    db.execute("SET threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    names = ("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    cuts = [0, 1700, 1710, 3033, len(line)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        pq.write_table(pa.table(dict(zip(names, map(list, zip(*line[a:b]))))), tmp_path / "lineitem.parquet" / f"part-{i:04d}.parquet")
    pq.write_table(pa.table(dict(zip(("s_suppkey", "s_name", "s_acctbal"), map(list, zip(*supplier))))), tmp_path / "supplier.parquet")
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'; CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted(db.execute(ORACLE_SQL["upserted_sessions"]).fetchall(), key=key)
    assert sorted(map(tuple, QUERIES["upserted_sessions"](spark, str(tmp_path)).collect()), key=key) == want
    assert len(want) == len(supplier) and (100, "A", 0.0) in want and (107, "A", 7.0) in want


def test_upserts_keep_rows_of_one_key_apart(spark):
    base = spark.createDataFrame([(1, "a", 1), (1, "b", None), (None, "c", 3), (2, None, 4)], "k long, v string, n long")
    updates = spark.createDataFrame([(1, 4, None, 7), (1, 5, None, 8), (None, 1, "x", None), (5, None, "new", None), (2, None, "late", None)], "k long, at long, v string, n long")
    got = sorted(map(tuple, mapping.upserted(base, updates, "k", "at").collect()), key=str)
    assert got == sorted([(1, "a", 8), (1, "b", 8), (None, "c", 3), (None, "x", None), (2, "late", 4), (5, "new", None)], key=str)
