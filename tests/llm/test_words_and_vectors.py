"""Spelling variants, collocations and vectors against plain versions and SQL."""

import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import collocations, common, queries, spelling, vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id long, text string, lang string, word string, n int, mask int, block int, codes string, rank int, phrase string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, 3, "c", 4, "p") for i, t, lang in rows], CLASH)


def texts(seed, n, size):
    """Words of few letters, so that many are near each other, in all cases and with marks and accents."""
    rng = np.random.default_rng(seed)
    stock = ["".join(rng.choice(list("aabcdé"), rng.integers(1, 9))) for _ in range(150)] + ["Straße", "ÀÉî", "x", "naïve", "÷×÷×÷"]
    out = []
    for _ in range(n):
        words = [stock[min(int(rng.exponential(30)), len(stock) - 1)] for _ in range(size)]
        words = [w.upper() if rng.random() < 0.1 else w for w in words]
        out.append("".join(w + str(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b", ";-", "\x1c", " 7 "])) for w in words))
    return out


def corpus(seed=1):
    body = texts(seed, 60, 120)
    rows = [(k, t, (None, "aa", "bb", "und")[k % 4]) for k, t in enumerate(body)]
    return rows + [(None, body[0], "aa"), (7, body[1], "aa"), (7, body[1], "aa"), (100, None, "aa"), (101, "", None), (102, "...!?", "bb"), (103, "abcde" * 3000 + " abcde", "aa"), (104, " \t\n", "cc"), (105, "one two three four. " * 12 + "one two; " * 40, "aa")]


# ---------------------------------------------------------------- spelling variants


def slow_variants(rows, one_in=97):
    counts = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % one_in == 0 else w] += 1
    v = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near, cut = defaultdict(set), defaultdict(set)
    for w in v:
        for k in range(len(w)):
            s = w[:k] + w[k + 1 :]
            cut[k, s].add(w)
            if s in v:
                near[w].add(s)
                near[s].add(w)
    for g in cut.values():
        for w in g:
            near[w] |= g - {w}
    form = {}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        if best and v[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), v.get(form.get(w))) for w, n in v.items())


def in_order(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_variants_of_awkward_texts(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "HELD_WORDS", 40)
    rows = corpus()
    got = spelling.spelling_variants(table_of(spark, rows), one_in=97).select("word", "form", "root", "n", "n_near", "form_n")
    want = slow_variants(rows)
    assert in_order(got) == sorted(want, key=str) and sum(w[1] is not None for w in want) > 10 and any(w[1] != w[2] for w in want if w[1])


def test_near_words_in_blocks_meet_once(spark):
    rows = corpus(3)
    words = sorted({w.translate(LOWER) for _, t, _ in rows for w in re.findall("[A-Za-zÀ-ÿ]+", t or "")})
    words = [w for w in words if len(w) >= 3]
    df = common.materialize(spark.createDataFrame([(i, w, i % 7 + 1) for i, w in enumerate(words)], "id long, word string, n long"))
    want = {r["id"]: (r["n_near"], r["other"], r["other_n"]) for r in spelling.near_words(df).collect()}
    assert {r["id"]: (r["n_near"], r["other"], r["other_n"]) for r in spelling.near_words(df, points=5, queries=3).collect()} == want
    plain = Counter()
    for a in words:
        for b in words:
            small, large = sorted((a, b), key=len)
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(large) - len(small) == 1 and any(large[:k] + large[k + 1 :] == small for k in range(len(large))):
                plain[a] += 1
    assert {words[i]: n for i, (n, _, _) in want.items()} == plain and len(plain) > 50


def test_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("z", "w5")], "word string, form string")
    assert {r["root"] for r in spelling.roots(links).collect()} == {"w37"}


def test_a_word_of_all_letters_and_a_very_long_one(spark):
    long = "ab" * 40000
    every = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
    rows = [(long, 5), (long + "c", 50), ("x" + long, 6), (every, 9), (every[:40] + every[41:], 30), (None, 9), ("abcd", 99)]
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {long: (long + "c", 2), long + "c": (None, 1), "x" + long: (None, 1), every: (every[:40] + every[41:], 1), every[:40] + every[41:]: (None, 1)}


# ---------------------------------------------------------------- collocations


def slow_phrases(rows, least, kept, most_words):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        over = Counter()
        for p, a in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        over[p[i:j]] = max(over[p[i:j]], a)
        rows_ = []
        for p, a in good.items():
            if not (over[p] and 100 * over[p] >= 50 * a):
                s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:kept])]
    return sorted(out)


@pytest.mark.parametrize("block_words, part, most_words, kept", [(1 << 20, 1 << 20, 3, 2000), (200, 64, 3, 2000), (50, 1 << 20, 4, 30)])
def test_phrases_of_awkward_texts(spark, monkeypatch, block_words, part, most_words, kept):
    monkeypatch.setattr(collocations, "PART", part)
    rows = corpus(5)
    got = collocations.collocations(table_of(spark, rows).repartition(5), least=4, most_words=most_words, kept=kept, block_words=block_words)
    want = slow_phrases(rows, 4, kept, most_words)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50 and any(w[2].count(" ") == most_words - 1 for w in want)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(3_000_000_000_000, 3_000_000_000_001, 7_000_000_000_007), (10, 10, 10), (999_999_999_999, 10**12, 10**12)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert {r["a"]: r["s"] for r in df.collect()} == {a: int(Decimal(10**6) * a * a // (Decimal(l) * r)) if a < 10**6 else 10**6 * a * a // (l * r) for a, l, r in rows}


# ---------------------------------------------------------------- vectors


def slow_links(rows, cosine=0.98):
    """(vec_id, links, component) of rows (vec_id, vector, label) by all pairs."""
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    links = [0] * len(rows)
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    u = [np.array(v) / np.abs(v).max() if good else None for (_, v, _), good in zip(rows, ok)]
    u = [v if v is None else v / np.linalg.norm(v) for v in u]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    return sorted(((r[0], links[i], min(ids[find(i)], default=None)) for i, r in enumerate(rows)), key=str)


def clusters(seed=2, dim=64):
    """Vectors in clusters: chains of near ones, a dense group, copies; and rows that link with nothing."""
    rng = np.random.default_rng(seed)
    rows = []

    def near(v, c):
        o = rng.normal(size=dim)
        o -= (o @ v) * v
        return c * v + np.sqrt(1 - c * c) * o / np.linalg.norm(o)

    for k in range(60):
        v = rng.normal(size=dim)
        v /= np.linalg.norm(v)
        for _ in range(rng.integers(1, 7)):
            rows.append((v * rng.uniform(0.1, 50), k % 3))
            v = near(v / np.linalg.norm(v), rng.uniform(0.97, 0.9999))
    centre = rows[0][0] / np.linalg.norm(rows[0][0])
    rows += [(near(centre, 0.997), 0) for _ in range(120)] + [(rows[5][0], rows[5][1])] * 30 + [(rows[7][0], 2), (rows[7][0], None)]
    out = [(1000 + 7 * i % 997, [float(x) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    out += [(None, out[9][1], out[9][2]), (5, out[9][1], out[9][2]), (5, out[20][1], out[20][2]), (6, None, 1), (7, [], 1), (8, [0.0] * dim, 1), (9, [None] + [1.0] * (dim - 1), 1), (10, [float("nan")] * dim, 1), (11, [float("inf")] + [0.0] * (dim - 1), 1)]
    return out + [(12, out[9][1][:-1], out[9][2]), (13, [1e200] * dim, 2), (14, [1e-200] * dim, 2), (None, None, None)]


def test_vectors_against_all_pairs(spark):
    rows = clusters()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("node", F.lit(2))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()]
    want = slow_links(rows)
    assert sorted((g[:3] for g in got), key=str) == want and sum(w[1] for w in want) > 10000
    assert all(g[3] == (g[0] is not None and g[0] == g[2]) for g in got)


def test_large_cells_are_split_and_pairs_count_once(spark):
    rows = clusters(4)
    df = common.materialize(spark.createDataFrame([(i, lab, len(v), np.array(v, "<f4").tobytes(), False, 1) for i, (_, v, lab) in enumerate(rows[:300]) if lab is not None], "node long, label int, dim int, vec binary, wide boolean, n long"))
    links, hubs = vectors.link_vectors(df)
    whole = {r["node"]: r["links"] for r in links.collect()}
    links, hubs = vectors.link_vectors(df, points=7, queries=5)
    assert {r["node"]: r["links"] for r in links.collect()} == whole and len(whole) > 100


def test_recall_at_the_boundary(spark):
    """Pairs of cosine 0.98 to 0.985 among many others, in few and in many dimensions."""
    for dim in (8, 64, 100):
        rng = np.random.default_rng(dim)
        base = rng.normal(size=(1500, dim))
        base /= np.linalg.norm(base, axis=1)[:, None]
        o = rng.normal(size=base.shape)
        o -= (o * base).sum(axis=1)[:, None] * base
        o /= np.linalg.norm(o, axis=1)[:, None]
        c = rng.uniform(0.98, 0.985, len(base))[:, None]
        x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * o])
        u = x / np.linalg.norm(x, axis=1)[:, None]
        want = int((np.triu(u @ u.T, 1) >= 0.98).sum())
        df = spark.createDataFrame([(i, [float(a) for a in v], "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
        got = vectors.near_duplicates(df).agg(F.sum("n_links")).first()[0] / 2
        assert 0.99 * want <= got <= want


def test_codes_are_balanced_and_follow_the_angle():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64)) + 3  # far from the origin: the mean is taken out
    codes = vectors.Codes(x)
    bits = np.unpackbits(codes.of(x).view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert abs(bits - 0.5).max() < 0.1
    assert np.allclose(codes.planes.T @ codes.planes, np.eye(64), atol=1e-9)


# ---------------------------------------------------------------- SQL, and nothing


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_collocations", "op13_rotated_codes"])
def test_queries_against_sql(spark, tmp_path, name):
    docs, rows = corpus(8), [(i, v, lab) for i, (_, v, lab) in enumerate(clusters(6)[:-14]) if v and None not in v]
    table_of(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    assert in_order(got.select(want.columns)) == sorted(want.fetchall(), key=str)
