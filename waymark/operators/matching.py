"""Descriptor matching: exact k nearest neighbours, ratio test, votes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries and points of one cell of the grid: 64 float32 dimensions of both are 16 MB.
QUERY_BLOCK, POINT_BLOCK = 32_768, 32_768
#: Of these, compared at once, and pairs whose exact distances are computed at once.
ROWS, COLUMNS, PAIRS = 1024, 2048, 1 << 16
#: Groups of so many rows at most share cells: they are dealt to this many.
SMALL, SHARED = 256, 1024
#: What rounding may add to a product-form distance, as a share of the vectors' squared lengths.
ROUNDING = 1e-9
METRICS = ("l2", "cosine", "hamming")


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, zeros behind."""
    out = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(np.uint64)


def _vectors(column: pa.ChunkedArray, metric: str) -> np.ndarray:
    """Vectors as rows of doubles, or for ``hamming`` as rows of words: packed bits as they are, numbers by their signs."""
    a = column.combine_chunks()
    if pa.types.is_binary(a.type):
        values, sizes = np.frombuffer(b"".join(a.to_pylist()), dtype=np.uint8), pc.binary_length(a)
    else:
        values, sizes = a.flatten().to_numpy(zero_copy_only=False).astype(float), pc.list_value_length(a)
    if len(pc.unique(sizes)) > 1:
        raise ValueError("vectors of unlike lengths can't be compared")
    rows = values.reshape(len(a), -1)
    if metric != "hamming":
        return rows
    return _words(rows if rows.dtype == np.uint8 else np.packbits(rows > 0, axis=1))


def _rough(q: np.ndarray, p: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all pairs (of l2 the square, by one matrix product), and how far each may be off."""
    if metric == "hamming":
        d = np.zeros((len(q), len(p)), dtype=np.int32)
        for k in range(q.shape[1]):
            d += np.bitwise_count(q[:, k, None] ^ p[None, :, k])
        return d.astype(float), np.zeros((len(q), 1))
    if metric == "l2":
        a, b = (q * q).sum(axis=1), (p * p).sum(axis=1)
        return a[:, None] + b[None, :] - 2 * (q @ p.T), ROUNDING * (a + b.max())[:, None] + 1e-300
    norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1)[None, :]
    return 1 - (q @ p.T) / np.where(norm > 0, norm, np.inf), np.full((len(q), 1), ROUNDING)


def _exact(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs q[i], p[i]."""
    if metric == "hamming":
        return np.bitwise_count(q ^ p).sum(axis=1).astype(float)
    if metric == "l2":
        return np.sqrt(((q - p) ** 2).sum(axis=1))
    norm = np.linalg.norm(q, axis=1) * np.linalg.norm(p, axis=1)
    return 1 - (q * p).sum(axis=1) / np.where(norm > 0, norm, np.inf)


def _best(row: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query row, distance, point id), the k least of each row."""
    order = np.lexsort((ids, dist, row))
    row, dist, ids = row[order], dist[order], ids[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=int)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row[rank < k], dist[rank < k], ids[rank < k]


def nearest_of(qids: np.ndarray, qs: np.ndarray, pids: np.ndarray, ps: np.ndarray, k: int, metric: str, other_than_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, distance, point id) of the k nearest points of each query; ties go to the lesser id."""
    out = []
    for at in range(0, len(qs), ROWS):
        q, best = qs[at : at + ROWS], (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
        for lo in range(0, len(ps), COLUMNS):
            own, part = pids[lo : lo + COLUMNS], ps[lo : lo + COLUMNS]
            d, off = _rough(q, part, metric)
            if other_than_self:
                d[qids[at : at + ROWS, None] == own[None, :]] = np.inf
            kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1 : min(k, d.shape[1])]
            # all that rounding may have put behind the k-th; then exact distances
            i, j = np.nonzero((d <= kth + 2 * off) & np.isfinite(d))
            for at_ in range(0, len(i), PAIRS):  # equal distances may be as many as all pairs
                a, b = i[at_ : at_ + PAIRS], j[at_ : at_ + PAIRS]
                best = _best(*(np.concatenate(x) for x in zip(best, (a, _exact(q[a], part[b], metric), own[b]))), k)
        out.append((best[0] + at, *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))


def nearest(queries: DataFrame, points: DataFrame, k: int, metric: str = "l2", query_id: str = "query_id", point_id: str = "point_id", vector: str = "vec", other_than_self: bool = False, within: list[str] | None = None) -> DataFrame:
    """within, query_id, point_id, dist, rank of the k nearest points; ties go to the smaller point id.

    With ``within``, only queries and points equal in those columns are compared.  Vectors are arrays of numbers or, for
    ``hamming``, packed bits in binary columns too.  Queries and points are dealt to blocks that meet in the cells of a grid:
    each block of queries with each block of points in one task, which sends k rows for each query on.  So nothing goes through the
    driver, no task holds more than a block of each, and what is shuffled are the points once for each block of queries
    and the other way round.  Small groups share cells, so many of them cost no more than their rows.  With ``other_than_self`` a point isn't the neighbour of a query of the same id.  Rows without
    a vector, an id, or one of ``within`` are left out; an empty side gives no rows.
    """
    if metric not in METRICS:
        raise ValueError(metric)
    keys = list(within or ["_all"])
    one = {} if within else {"_all": F.lit(0)}
    side = lambda df, i: df.withColumns(one).select(*keys, F.col(i).cast("long").alias("_id"), F.col(vector).alias("_vec")).dropna()
    q, p = side(queries, query_id), side(points, point_id)
    blocks = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name), F.count(F.lit(1)).alias(f"{name}n"))
    grid = blocks(q, QUERY_BLOCK, "_q").join(blocks(p, POINT_BLOCK, "_p"), keys)
    mixed = F.xxhash64(*keys)
    grid = grid.withColumn("_b", F.when(F.col("_qn") + F.col("_pn") <= SMALL, F.pmod(mixed, F.lit(SHARED))).otherwise(mixed)).drop("_qn", "_pn")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    cell = ["_b", "_i", "_j"]
    asked = q.join(grid, keys).select(*keys, "_b", own("_q").alias("_i"), every("_p").alias("_j"), "_id", "_vec")
    # new names of the same columns, or both sides of a table compared with itself would have the same ones
    there = p.join(grid, keys).select(*[F.col(c).alias(c) for c in [*keys, "_b"]], every("_q").alias("_i"), own("_p").alias("_j"), "_id", "_vec")
    schema = T.StructType([*(q.schema[c] for c in keys), *T._parse_datatype_string("query_id long, point_id long, dist double").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        # a cell holds one group or many small ones: rows are sorted by group
        code: dict[tuple, int] = {}
        sides = []
        for x in (left, right):
            of = np.fromiter((code.setdefault(v, len(code)) for v in zip(*(x.column(c).to_pylist() for c in keys))), dtype=np.int64, count=x.num_rows)
            order = np.argsort(of, kind="stable")
            sides.append((of[order], x.column("_id").to_numpy()[order], x.column("_vec").take(pa.array(order))))
        (qof, qids, qv), (pof, pids, pv) = sides
        try:
            qs, ps = _vectors(qv, metric), _vectors(pv, metric)
        except ValueError:  # lengths may differ from group to group
            qs = ps = None
        bounds = [np.searchsorted(of, np.arange(len(code) + 1)).tolist() for of in (qof, pof)]
        names, out = list(code), []
        for g, (a, z, c, e) in enumerate(zip(bounds[0], bounds[0][1:], bounds[1], bounds[1][1:])):
            if a < z and c < e:
                own_q = qs[a:z] if qs is not None else _vectors(qv.slice(a, z - a), metric)
                own_p = ps[c:e] if ps is not None else _vectors(pv.slice(c, e - c), metric)
                row, dist, ids = nearest_of(qids[a:z], own_q, pids[c:e], own_p, k, metric, other_than_self)
                out.append((np.full(len(row), g), qids[a:z][row], ids, dist))
        if not out:
            return target.empty_table()
        of, asked_, ids, dist = map(np.concatenate, zip(*out))
        same = [pa.array([n[i] for n in names], target.field(c).type).take(pa.array(of)) for i, c in enumerate(keys)]
        return pa.Table.from_arrays([*same, pa.array(asked_), pa.array(ids), pa.array(dist)], schema=target)

    found = asked.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(scan, schema)
    rank = F.row_number().over(Window.partitionBy(*keys, "query_id").orderBy("dist", "point_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("_all")


def ratio_test(neighbours: DataFrame, ratio: float = 0.75, within: list[str] | None = None) -> DataFrame:
    """Queries whose nearest point is closer than ``ratio`` times the second: within, query_id, point_id, d1, d2."""
    two = neighbours.groupBy(*(within or []), "query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("point_id"))).alias("point_id"),
        F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("d2"),
    )
    return two.where(F.col("d1") < ratio * F.col("d2"))


def best_by_votes(matches: DataFrame, group: str | list[str], node: str, order: str) -> DataFrame:
    """group, node, votes, total: the node with most matches; ties go to the node matched first by ``order``."""
    group = [group] if isinstance(group, str) else group
    votes = matches.groupBy(*group, node).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    return votes.groupBy(*group).agg(F.max_by(node, F.struct("votes", -F.col("_first"))).alias(node), F.max("votes").alias("votes"), F.sum("votes").alias("total"))


def vote_confidence(votes: Column, features: int) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), votes / F.lit(float(features))))
