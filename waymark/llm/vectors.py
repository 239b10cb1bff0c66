"""Operator 13: near duplicates of embeddings by iterative quantisation.

A rotation is learned that turns vectors into balanced 64-bit codes whose Hamming distance follows the angle.  Codes meet
in eight tables, one for each byte: vectors whose codes differ in at most seven bits agree in a byte, and those that differ
in more nearly always do.  A table's cell tells by the codes which of its vectors have a candidate there; only those
are fetched, and the original vectors decide.  A pair counts in the first table it meets in, so counts need no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_KEYS, forget, groups, in_blocks, materialize, small_batches, split_join, table
from .components import components
from .simhash import Forest

COSINE = 0.98
BITS, TABLES = 64, 8
#: Codes within so many bits are candidates: at a cosine of 0.98 about 4 bits differ, and more than 11 in 1 pair of 1500.
RADIUS = 11
#: Distinct vectors that the rotation is learned from, and its rounds.
SAMPLE, ROUNDS = 20_000, 30
#: Vectors of a cell in one task: searched, and asking.
CELL_POINTS, CELL_QUERIES = 8192, 8192
#: Rows and columns compared at once.
ROWS, COLUMNS = 256, 2048


class Codes:
    """Mean, projection and rotation: ``BITS`` signs for each vector, by as many rotations as that takes."""

    def __init__(self, sample: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        x = unit(sample)
        self.dim = x.shape[1]
        self.mean = x.mean(axis=0) if len(x) else np.zeros(self.dim)
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :BITS]  # the directions of greatest variance
        turned = [axes @ rotation(x @ axes, rng) for _ in range(-(-BITS // axes.shape[1]))]
        self.planes = np.concatenate(turned, axis=1)[:, :BITS]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        signs = (unit(vectors) - self.mean) @ self.planes > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()


def rotation(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The rotation that takes ``v`` nearest to its own signs: signs and rotation fitted to each other in turn."""
    r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(ROUNDS):
        a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (a @ b).T
    return r


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that no square overflows."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def numbers(blobs: pa.ChunkedArray | pa.Array, wide: np.ndarray, dim: int | None = None) -> np.ndarray:
    """Packed vectors as rows of doubles, zeros behind the shorter ones."""
    rows = [np.frombuffer(b, dtype="<f8" if w else "<f4") for b, w in zip(blobs.to_pylist(), wide)]
    out = np.zeros((len(rows), dim or max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def packed(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vec (packed), wide (of doubles), dim and key (digest of label and vector); the last four are null where a
    row links with nothing."""
    label = rows.schema[label_col].dataType
    schema = T.StructType([T.StructField("vec_id", rows.schema[id_col].dataType), T.StructField("label", label), T.StructField("vec", T.BinaryType()), T.StructField("wide", T.BooleanType()), T.StructField("dim", T.IntegerType()), T.StructField("key", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            wide = lists.type.value_type != pa.float32()
            ends = lists.offsets.to_numpy()
            # a zero is added so that -0.0 and 0.0 are one
            values = lists.values.to_numpy(zero_copy_only=False).astype("<f8" if wide else "<f4") + 0
            blobs: list[bytes | None] = []
            keys: list[bytes | None] = []
            for there, name, a, b in zip(lists.is_valid().to_pylist(), batch.column(1).to_pylist(), ends, ends[1:]):
                v = values[a:b]
                ok = there and name is not None and len(v) and bool(np.isfinite(v).all() and v.any())
                blobs.append(v.tobytes() if ok else None)
                keys.append(hashlib.blake2b(f"{name}\0".encode() + blobs[-1], digest_size=16).digest() if ok else None)
            dim = [None if b is None else len(b) // (8 if wide else 4) for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array([None if b is None else wide for b in blobs], pa.bool_()), pa.array(dim, pa.int32()), pa.array(keys, pa.binary())], names=schema.names)

    return rows.select(id_col, label_col, vector_col).mapInArrow(pack, schema)


def fitted(distinct: DataFrame) -> Codes:
    """Codes learned from about ``SAMPLE`` of the distinct vectors, drawn by hash."""
    many = distinct.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("d")).first()
    drawn = distinct.where(F.pmod(F.xxhash64("node"), F.lit(max(1, many["n"]))) < SAMPLE).select("vec", "wide").orderBy("vec").toArrow()
    return Codes(numbers(drawn.column("vec"), drawn.column("wide").to_numpy(), many["d"] or 1))


def earlier(x: np.ndarray, table_: int) -> np.ndarray:
    """Whether codes with these differences agree in a byte before number ``table_``."""
    out = np.zeros(x.shape, dtype=bool)
    for t in range(table_):
        out |= (x >> np.uint64(8 * t)) & np.uint64(255) == 0
    return out


def close_codes(code: np.ndarray, own: np.ndarray, asks: list[np.ndarray], table_: int) -> np.ndarray:
    """Which rows have a candidate: own ones with those that ask, which may be themselves."""
    found = np.zeros(len(code), dtype=bool)
    for other in asks:
        for lo in range(0, len(own), ROWS):
            mine = own[lo : lo + ROWS]
            for at in range(lo if other is own else 0, len(other), COLUMNS):
                theirs = other[at : at + COLUMNS]
                hit = np.flatnonzero(np.bitwise_count(code[mine][:, None] ^ code[theirs][None, :]) <= RADIUS)
                p, q = mine[hit // len(theirs)], theirs[hit % len(theirs)]
                new = (p != q) & ~(found[p] & found[q])
                p, q = p[new], q[new]
                ok = ~earlier(code[p] ^ code[q], table_)
                found[p[ok]] = found[q[ok]] = True
    return found


def linked_rows(vec: np.ndarray, code: np.ndarray, times: np.ndarray, own: np.ndarray, asks: list[np.ndarray], table_: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of vectors linked to it here, and the root of those that hang together."""
    links, forest, u = np.zeros(len(code), dtype=np.int64), Forest(len(code)), unit(vec)
    for other in asks:
        for lo in range(0, len(own), ROWS):
            mine = own[lo : lo + ROWS]
            for at in range(lo if other is own else 0, len(other), COLUMNS):
                theirs = other[at : at + COLUMNS]
                hit = np.flatnonzero(u[mine] @ u[theirs].T >= cosine)
                i, j = hit // len(theirs), hit % len(theirs)
                if other is own:
                    i, j = i[lo + i < at + j], j[lo + i < at + j]
                p, q = mine[i], theirs[j]
                ok = ~earlier(code[p] ^ code[q], table_)
                p, q = p[ok], q[ok]
                links += np.bincount(p, weights=times[q], minlength=len(code)).astype(np.int64) + np.bincount(q, weights=times[p], minlength=len(code)).astype(np.int64)
                forest.link(p, q)
    return links, forest.roots(np.arange(len(code)))


CELL = ["label", "dim", "table", "value", "cell"]


def link_vectors(distinct: DataFrame, cosine: float = COSINE, points: int | None = None, queries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``distinct`` (node, label, dim, vec, wide, n): node, links (vectors linked to it), and node, hub of those that hang
    together; nodes without links have no row."""
    small_batches(distinct.sparkSession)
    codes = fitted(distinct)
    label = distinct.schema["label"]
    key = T.StructType([label, *T._parse_datatype_string("dim int, table int, value int, cell int").fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = codes.of(numbers(batch.column(3), batch.column(4).to_numpy(zero_copy_only=False), codes.dim)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(got)], names=["label", "dim", "node", "code"])

    def roles(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
        home = cell.column("home").to_numpy()
        own = np.flatnonzero(home)
        return cell.column("code").to_numpy().view(np.uint64), own, [np.flatnonzero(~home)] + [own] * cell.column("among")[0].as_py(), cell.column("table")[0].as_py()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, len(CELL)):
            if cell.num_rows > 1:
                found = close_codes(*roles(cell))
                if found.any():
                    yield from cell.filter(pa.array(found)).combine_chunks().to_batches()

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, len(CELL)):
            if cell.num_rows > 1:
                vec = numbers(cell.column("vec"), cell.column("wide").to_numpy())
                code, own, asks, at = roles(cell)
                links, root = linked_rows(vec, code, cell.column("n").to_numpy(), own, asks, at, cosine)
                node, hit = cell.column("node").to_numpy(), links > 0
                if hit.any():
                    yield pa.RecordBatch.from_pydict({"node": node[hit], "links": links[hit], "hub": node[root[hit]]})

    coded = distinct.select("label", "dim", "node", "vec", "wide").mapInArrow(encode, T.StructType([label, *T._parse_datatype_string("dim int, node long, code long").fields]))
    byte = lambda t: F.shiftright("code", 8 * t).bitwiseAND(255).cast("int")
    rows = coded.select("label", "dim", F.posexplode(F.array(*[byte(t) for t in range(TABLES)])).alias("table", "value"), "node", "code").withColumn("home", F.lit(True))
    cells = in_blocks(rows, CELL[:4], "node", points or CELL_POINTS, queries or CELL_QUERIES)
    together = lambda df: df.repartition(*CELL).sortWithinPartitions(*CELL)
    dealt = together(cells.select(*CELL, "home", "among", "node", "code"))
    need = materialize(dealt.mapInArrow(candidates, T.StructType([*key.fields, *T._parse_datatype_string("home boolean, among boolean, node long, code long").fields])))
    fetched = need.join(distinct.select("node", "vec", "wide", "n"), "node").select(*CELL, "home", "among", "node", "code", "vec", "wide", "n")
    found = materialize(together(fetched).mapInArrow(rerank, "node long, links long, hub long"))
    forget(need)
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.select("node", "hub")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: rows of one label link at a cosine of at least ``cosine``.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the least id reachable, and a row is kept if that
    is its own.  Copies of a vector are compared once and count each.  A row links with nothing if its label or vector is
    null, or its vector is empty, zero or holds a null or a number that isn't finite; vectors of unlike lengths don't link.  Rows
    without an id link as others do but are never kept, and name no component; repeated rows stay.  An empty table gives no
    rows; other columns aren't read.  A pair of cosine ``cosine`` is missed if its codes differ in every byte: at 0.98 fewer
    than 1 in 100 (tested against brute force); none below ``cosine`` is linked.
    """
    small_batches(rows.sparkSession)
    every = materialize(packed(rows, id_col, vector_col, label_col))
    known = every.where(F.col("key").isNotNull())
    alike = known.groupBy("key").agg(*[F.first(c).alias(c) for c in ("label", "dim", "vec", "wide")], F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
    distinct = materialize(alike.withColumn("node", F.monotonically_increasing_id()))  # written, so nodes stay
    links, hubs = link_vectors(distinct, cosine)
    whole = components(hubs)
    lows = whole.join(distinct.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least"))
    least = whole.join(lows, "component").select("node", "least")
    many = max(1000, every.count() / HOT_KEYS)
    found = distinct.select("key", "node", "n", "low").join(links, "node", "left").join(least, "node", "left")
    named = materialize(found.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"), (F.col("n") > many).alias("hot")))
    forget(distinct)
    out = split_join(every.select("vec_id", "key"), named, "key", "left")
    alone = F.col("key").isNull()
    mine = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), F.coalesce(F.col("vec_id") == mine, F.lit(False)).alias("kept"))


def op13_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, id = c AS kept FROM k LEFT JOIN n ON a = id"""
