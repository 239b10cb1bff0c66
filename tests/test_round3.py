"""What the findings of round 3 were about."""

import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.functions import geometry
from waymark.llm import language, leaks, tokens
from waymark.llm.common import shared_dir, slices
from waymark.operators import localize, mapping, matching, navigation, places, trajectories
from waymark.plans.catalog import ORACLE_SQL, QUERIES


def against_sql(spark, folder, name: str, tables: dict) -> tuple[list, list]:
    """The rows of a query and of its SQL over small tables."""
    db = duckdb.connect()
    for k, rows in tables.items():
        pq.write_table(pa.Table.from_pydict(rows), f"{folder}/{k}.parquet")
        db.execute(f"CREATE VIEW {k} AS SELECT * FROM '{folder}/{k}.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()), key=key), sorted(db.execute(ORACLE_SQL[name]).fetchall(), key=key)


def test_upserts_of_one_number_take_the_first_row(spark, tmp_path):
    n = 40  # suppliers with three lines of one order and number each
    line = [(s, 5, 7, "ARN"[(s + i) % 3], float(s + i)) for i in range(3) for s in range(n)]
    lineitem = dict(zip(("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), map(list, zip(*line))))
    supplier = {"s_suppkey": list(range(n + 1)), "s_name": [f"s{i}" for i in range(n + 1)], "s_acctbal": [0.5] * (n + 1)}
    got, want = against_sql(spark, tmp_path, "upserted_sessions", {"lineitem": lineitem, "supplier": supplier})
    assert got == want and len(got) == n + 1
    base = spark.createDataFrame([(1, "a")], "k long, v string")
    updates = spark.createDataFrame([(1, 4, 2, "late"), (1, 4, 1, "early"), (1, 4, 0, None), (1, 3, 0, "before")], "k long, at long, row long, v string")
    assert mapping.upserted(base, updates, "k", "at", "row").collect() == [(1, "early")]


def test_of_an_images_equal_maps_the_least_counts(spark):
    requests = spark.createDataFrame([(1, 7, 3)], "request long, building int, image long")
    floors = spark.createDataFrame([(7, 0, m) for m in range(40)], "building int, level long, map long")
    run = lambda pairs: pairs.withColumn("num_matches", F.when(F.col("map") > 2, F.lit(9))).withColumn("confidence", F.col("map") / 100)
    assert [(r["map"], r["num_matches"], r["confidence"]) for r in localize.floor_results(requests, floors, run).collect()] == [(3, 9, 0.03)]


def test_crowded_places_around_positions(spark, monkeypatch):
    """Cubes halved several times, against a plain loop; ties, copies, places all on one side, and positions without any."""
    monkeypatch.setattr(places, "FEW", 2)
    rng = random.Random(5)
    there = [(i, None if i % 50 == 9 else "p", float(rng.randrange(-3, 6)), rng.choice([1.25, rng.uniform(0, 4)]), float(i % 3)) for i in range(1200)]
    there += [(2000 + i, "p", 0.5, 2.0, 1.0) for i in range(30)] + [(3000, "p", None, 0.0, 0.0), (3001, "p", -50.0, 0.0, 0.0)]
    asked = [(i, float(rng.randrange(-4, 8)), rng.uniform(-4, 8), float(i % 3)) for i in range(60)] + [(70, 0.5, 2.0, 1.0), (71, 0.5, 2.0, 1.0), (72, None, 0.0, 0.0), (73, -50.5, 1.0, 1.0), (74, 900.0, 0.0, 0.0)]
    want = set()
    for q, *a in asked:
        near = sorted((math.dist(a, b), p) for p, name, *b in there if name and None not in a and None not in b and math.dist(a, b) <= 3.0)
        want |= {(q, p, round(d, 9), k + 1) for k, (d, p) in enumerate(near[:5])}
    q, p = spark.createDataFrame(asked, "q long, x double, y double, z double"), spark.createDataFrame(there, "p long, name string, x double, y double, z double")
    joined = places.nearby(q, p, "q", "p", 3.0, 5)
    assert {(r["q"], r["p"], round(r["distance"], 9), r["rank"]) for r in joined.collect()} == want and len(want) > 200


def test_long_recordings_are_turned_in_parts(spark):
    """Sessions over several ranges and batches, ties, nulls and a session without an id, as the fold of one array has them."""
    rng = random.Random(3)
    rows = [(s, rng.choice([None, *range(4)] if s == 3 else range(900)) , rng.uniform(-2, 2), rng.uniform(-2, 2), 0.3) for s in (1, 2, 3, None) for _ in range(700)]
    rows = [(s, None if t is None else t / 100, *r) for s, t, *r in rows] + [(4, 0.5, 1.0, 1.0, 1.0), (5, 0.5, 1.0, 1.0, 1.0), (5, 0.7, 1.0, None, 1.0), (5, 0.8, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s long, t double, x double, y double, z double").repartition(3)
    folded = df.groupBy("s").agg(F.collect_list(F.struct("t", "x", "y", "z")).alias("a")).select("s", geometry.turned_by_gyro(F.col("a")).alias("q"))
    want = {r["s"]: r["q"] for r in folded.collect()}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = trajectories.turned_by_gyro(df, "s", "t", ["x", "y", "z"]).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == 6 and want[5] is not None
    for r in got:
        assert r["q"] is None and all(x is None for x in want[r["s"]]) or max(abs(a - b) for a, b in zip(r["q"], want[r["s"]])) < 1e-9


def test_sessions_of_many_batches_are_navigated_in_one_fold(spark):
    """Batches end inside sessions; the answers are those of a route stepped over all positions, and no frame holds a session."""
    rng = random.Random(8)
    rows = [(s, i, rng.uniform(0, 100), rng.uniform(0, 50), 0.0, 0.0, 0.0, 0.0, 100.0, 50.0, 0.0) for s in (1, 2, None) for i in range(150)]
    rows += [(3, i, float(i), i / 2, 0.0, 0.0, 0.0, 0.0, 100.0, 50.0, 0.0) for i in range(103)]
    df = spark.createDataFrame(rows, "s long, i long, x double, y double, z double, sx double, sy double, sz double, gx double, gy double, gz double").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    done = navigation.navigate(df, "s", "i")
    got = sorted(map(tuple, done.collect()), key=lambda r: (r[0] or 0, r[1]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = []
    for s in (None, 1, 2, 3):
        route = navigation.Route(np.zeros(3), np.array([100.0, 50.0, 0.0]))
        want += [(s, r[1], *route.step(np.array(r[2:5]))) for r in rows if r[0] == s]
    assert got == want and got[-1][-1] == "completed" and "FlatMapGroupsInPandas" not in done._jdf.queryExecution().toString()


def test_no_model_comes_from_a_sample(spark):
    """A language's words count in whichever of its many documents they stand; the latent space has all items and nothing else."""
    rows = [(i, "der hund und die katze" if i % 2 else "the dog and a cat", "de" if i % 2 else "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(docs)
    counts = np.zeros((language.BUCKETS, 2))
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for buckets in language.features(text)[:2]:
                np.add.at(counts[:, ["de", "en"].index(lang)], buckets, 1)
    grams = counts + 0.5
    assert model.languages == ["de", "en"] and np.allclose(model.weight, np.log(grams / grams.sum(axis=0)), atol=1e-5)
    rng = np.random.default_rng(2)
    items = [(i, [f"w{k}".encode() for k in rng.integers(0, 500, 20)]) for i in range(30)]
    idf = leaks.idf_weights(np.full(leaks.BUCKETS, 3), 100)
    space = leaks.build_space(spark, items, idf)
    assert (space.row >= 0).sum() == len({b for _, w in items for b in leaks.terms(b" ".join(w).decode()).tolist()})
    for i, w in items:  # of an item's own direction nothing is lost
        t, weight = leaks.vector(w, idf)
        assert np.allclose(space.basis[space.row[t]] @ space.items[i], weight / np.linalg.norm(weight), atol=1e-3)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    for _ in range(60):
        s = rng.normal(0, 6, (6, 3))
        total = lambda labels: sum(s[t, j] for t, j in enumerate(labels)) - 12.0 * sum(a != b for a, b in zip(labels, labels[1:]))
        assert abs(total(language.viterbi(s)) - max(map(total, itertools.product(range(3), repeat=6)))) < 1e-9


def test_small_groups_share_cells(spark, monkeypatch):
    """Many small groups and a large one, of unlike lengths of vectors, against a plain loop; and few of Python's calls for them."""
    rng = random.Random(6)
    size = lambda g: 2 + g % 2
    rows = [(f"g{g}", i, [float(rng.randrange(4)) for _ in range(size(g))]) for g in range(300) for i in range(200 if g == 7 else 4)]
    df = spark.createDataFrame(rows, "g string, query_id long, vec array<double>")
    got = {(r["g"], r["query_id"], r["rank"]): (r["point_id"], r["dist"]) for r in matching.nearest(df, df.withColumnRenamed("query_id", "point_id"), 2, within=["g"]).collect()}
    by = {}
    for g, i, v in rows:
        by.setdefault(g, []).append((i, v))
    want = {(g, i, k + 1): (p, d) for g, own in by.items() for i, v in own for k, (d, p) in enumerate(sorted((math.dist(v, w), p) for p, w in own)[:2])}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-12 for x in want)


def test_equal_distances_are_computed_in_slices(monkeypatch):
    most, exact = [], matching._exact
    monkeypatch.setattr(matching, "_exact", lambda q, p, metric: most.append(len(q)) or exact(q, p, metric))
    same = np.ones((1024, 4))
    row, dist, ids = matching.nearest_of(np.arange(1024), same, np.arange(1024)[::-1].copy(), same, 2, "l2", True)
    assert max(most) <= 1 << 16 and len(row) == 2048 and set(ids[row == 5]) == {0, 1} and set(ids[row == 0]) == {1, 2} and not dist.any()


def test_poses_of_many_images_are_solved_together(spark, monkeypatch):
    images, k = [], (400.0, 400.0, 200.0, 200.0)
    for seed in range(60):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(3, 60))
        points, r, t = rng.uniform(-3, 3, (n, 3)), localize.turned(rng.normal(size=3) * 0.4), np.array([0.3, -0.2, 9.0])
        places = localize.project(points, r, t) + rng.normal(size=(n, 2)) * 0.0005
        places[: n // 3] += rng.uniform(0.05, 0.2, (n // 3, 2))
        images.append((points, rng.uniform(-1, 1, (n, 2)) if seed % 10 == 9 else places))
    one_by_one = [localize.solve(*image, 0.0125, 300) for image in images]
    calls, plain = [], localize.minimal_poses
    monkeypatch.setattr(localize, "minimal_poses", lambda *a: calls.append(1) or plain(*a))
    together = localize.solve_all(images, 0.0125, 300)
    assert len(calls) < 12  # once a lot of samples, not once a sample of an image
    for a, b in zip(together, one_by_one):
        assert (a is None) == (b is None) and (a is None or all(np.allclose(x, y) for x, y in zip(a, b)))
    # the same by Spark, over small batches, a null and a composed key, with rows in any order
    rows = [(None if i == 7 else f"m{i % 3}", i, *map(float, q * 400 + 200), *map(float, p)) for i, (points, places) in enumerate(images) for p, q in zip(points, places)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "map string, image long, u double, v double, x double, y double, z double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        solved = localize.solve_poses(df, ["map", "image"], k, min_inliers=6)
        assert "FlatMapGroupsInPandas" not in solved._jdf.queryExecution().executedPlan().toString()
        got = {(g["map"], g["image"]): (g["num_inliers"], g["num_correspondences"]) for g in solved.collect()}
        assert localize.solve_poses(df.where("false"), "image", k).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {i: (int(g[2].sum()), len(images[i][0])) for i, g in enumerate(one_by_one) if g is not None and g[2].sum() >= 6}
    assert got == {(None if i == 7 else f"m{i % 3}", i): n for i, n in want.items()} and len(got) > 30


def test_new_words_are_encoded_together(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder, r = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(8)
    letters = [*"aeinrst" * 4, *"bdéüÖ中ё.,'()1903\n"]
    odd = ["", "", "\t", " ", "　x", "a\n", "\n\nb", "😀", "\x00", "Āā", "'s", "don't", "<|endoftext|>", "x" * 80, "ſ", "\x1c", "a\x00b"]
    word = lambda: r.choice(odd) if r.random() < 0.02 else "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    texts = ["", " ", "a", "\n", *(" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(600))]
    calls, plain = [], tokens.Encoder.whole
    monkeypatch.setattr(tokens.Encoder, "whole", lambda self, text: calls.append(text) or plain(self, text))
    monkeypatch.setattr(tokens, "CACHE_BYTES", 200_000)  # tables start anew many times
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    for size in (1, 7, 200):
        calls.clear()
        column = pa.array(["before", *texts])[1:]
        got = [x for lo in range(0, len(texts), size) for x in encoder.encode_column(column[lo : lo + size], np.uint32(2).tobytes()).to_pylist()]
        assert got == [[*w, 2] for w in want]
    words = len({w for x in texts for w in x.split(" ")})
    assert words > 10_000 and len(calls) < 2 * len(texts)  # by themselves: first words, odd words, and texts with odd spacing


def test_token_report_sends_no_ids_back(spark):
    """Ids go to Python for their sums, and only the sums come back."""
    path = shared_dir(spark)
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    tokens.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    report = tokens.token_report(spark, path)
    step = [x for x in report._jdf.queryExecution().executedPlan().toString().split("\n") if "MapInArrow" in x]
    assert len(step) == 1 and "ids_crc32#" in step[0]
    assert " tokens#" not in step[0][step[0].rindex("[") :], step  # the columns that the step returns
    assert report.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and report.count() == 3


def test_words_of_the_table_before_are_not_encoded_again(monkeypatch):
    """Texts are encoded 2 MB at a time; words that a table or the one before it has aren't encoded again, and tables stay bounded."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(6, 9)))
    words = [word() for _ in range(2000)]
    texts = pa.array(["x " + " ".join(r.sample(words, 1000)) for _ in range(600)])
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 500_000)  # a slice's words fill a table
    parts, plain = [], tokens.Encoder._parts
    monkeypatch.setattr(tokens.Encoder, "_parts", lambda self, some: parts.extend(some) or plain(self, some))
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    some = list(slices([batch], tokens.TEXT_BYTES))
    assert len(some) > 1
    got, again = [], []
    for x in some:
        parts.clear()
        got += encoder.encode_column(x.column(0)).to_pylist()
        again.append(len(parts))
        fresh = [f"{word()}q" for _ in range(1500)]
        encoder.encode_column(pa.array(["x " + " ".join(fresh)]))
        assert encoder.words.n < 5000 and encoder.before.n < 5000
    assert again[0] == len(set(words)) and set(again[1:]) == {0}
    assert got == [e.ids for e in library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
