"""Operator 8: near duplicates by SimHash fingerprints in vantage-point trees.

Distinct fingerprints are dealt to shards by a tree of vantage points: a fingerprint goes left if its Hamming
distance to the node's vantage point is at most the node's radius.  By the triangle inequality a neighbour at
most ``r`` bits away can lie on the other side only if the distance is within ``r`` of the radius; such
fingerprints are sent to both sides as queries.  Each shard searches with a tree of its own.  All pairs within
``r`` bits are met, and each shard returns only which of its fingerprints hang together, so that a large group
costs a row for each member and not for each pair.

Each level of the tree that deals out the shards sends more fingerprints to both sides, so it stays shallow; a shard
that is still too full for a task is searched in cells, each a block of its own fingerprints against a block of those
that ask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, add_columns, materialize, small_batches, split_join, table, texts
from .components import components

BITS = 4
WORDS = 4
#: Fingerprints for each shard whose distances choose the vantage points and radii of the tree that deals out shards.
TREE_SAMPLE = 256
#: Fingerprints a shard should hold, and the least and greatest depth of the tree.
SHARD_ROWS = 100_000
LEAST_DEPTH, GREATEST_DEPTH = 4, 8
#: Fingerprints of a shard that one task holds: those searched, and those that ask.
CELL_POINTS, CELL_QUERIES = 100_000, 400_000
LEAF = 192

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of the text's shingles, ASCII letters in lower case; 0 without words."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not parts:
        return 0
    whole = b" ".join(parts)
    n = len(parts) - words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(whole, 42)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    first, last = (ends - size)[:n].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], 42) for a, b in zip(first, last)], dtype="<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) * 256)
    counts = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BYTE_BITS).ravel()  # bit k of byte j at 8 j + k
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, fp (signed long) of whole texts, and the columns of ``keep``; null and wordless texts have fingerprint 0."""

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            got = np.array([fingerprint(t, words) for t in texts(batch, text_col)], dtype=np.uint64)
            return {"fp": pa.array(got.view(np.int64))}

        return f

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(text_col), *(keep or []))
    return add_columns(rows, make, "fp long", keep=["doc_id", *(keep or [])])


class Tree:
    """Vantage points over a sample: arrays of points and radii; children of i are 2i+1 (near) and 2i+2 (far)."""

    def __init__(self, sample: np.ndarray, depth: int):
        inner = 2**depth - 1
        self.depth = depth
        self.point = np.zeros(inner, dtype=np.uint64)
        self.radius = np.full(inner, 32, dtype=np.int64)
        groups = {0: sample}
        for i in range(inner):
            own = groups.pop(i, sample[:0])
            if len(own):
                # of a few points, the one whose distances spread most: fewest rows near the radius
                tried = own[:: max(1, len(own) // 8)][:8]
                away = np.bitwise_count(tried[:, None] ^ own[None, :]).astype(np.int64)
                best = int(away.var(axis=1).argmax())
                self.point[i] = tried[best]
                self.radius[i] = int(np.median(away[best]))
                near = away[best] <= self.radius[i]
                groups[2 * i + 1], groups[2 * i + 2] = own[near], own[~near]

    def route(self, fps: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, whether it is its home) for the shards from its home on that may hold a neighbour.

        Of two neighbours, the one of the earlier home shard visits the other's.
        """
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.ones(len(fps), dtype=bool)
        for _ in range(self.depth):
            d = np.bitwise_count(fps[row] ^ self.point[node]).astype(np.int64)
            near = d <= self.radius[node]
            # what is at home goes to its own side; its copies only to later shards, that is from near to far
            cross = home & near & (d + r > self.radius[node])
            go_near = ~home & (d - r <= self.radius[node])
            go_far = ~home & (d + r > self.radius[node])
            row = np.concatenate([row[home], row[cross], row[go_near], row[go_far]])
            node = np.concatenate([2 * node[home] + np.where(near[home], 1, 2), 2 * node[cross] + 2, 2 * node[go_near] + 1, 2 * node[go_far] + 2])
            home = np.concatenate([np.ones(int(home.sum()), dtype=bool), np.zeros(len(row) - int(home.sum()), dtype=bool)])
        return row, node - (2**self.depth - 1), home


class Forest:
    """Union-find over the rows of one shard, fed with blocks of linked pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        top = self.up[rows]
        while True:
            above = self.up[top]
            if (above == top).all():
                self.up[rows] = top
                return top
            top = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of a[i] and b[i] for all i; each round hangs roots under smaller ones."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            self.up[hi] = lo  # of several, one wins; the others are tried again


def link_shard(points: np.ndarray, queries: np.ndarray, r: int, leaf: int = LEAF) -> np.ndarray:
    """Root of each of ``points`` then ``queries`` after linking all point-point and query-point pairs within r bits."""
    n = len(points)
    every = np.concatenate([points, queries])
    forest = Forest(len(every))
    stack = [(np.arange(n), np.arange(len(every)))]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) > leaf:
            tried = every[own[:: max(1, len(own) // 8)][:8]]
            some = every[own[:: max(1, len(own) // 256)]]
            best = np.bitwise_count(tried[:, None] ^ some[None, :]).astype(np.int64).var(axis=1).argmax()
            d = np.bitwise_count(every[own] ^ tried[best]).astype(np.int64)
            m = int(np.median(d))
            near = d <= m
            if near.all():
                m -= 1
                near = d <= m
            if near.any() and not near.all():
                a = np.bitwise_count(every[ask] ^ tried[best]).astype(np.int64)
                stack.append((own[near], ask[a - r <= m]))
                stack.append((own[~near], ask[a + r > m]))
                continue
        # equal distances to every vantage point can't be split further: compare in blocks
        for lo in range(0, len(own), 256):
            mine = own[lo : lo + 256]
            link_block(forest, every, mine, mine, r)
            for at in range(0, len(ask), 2048):
                theirs, tops = ask[at : at + 2048], forest.roots(mine)
                if (tops == tops[0]).all():  # what hangs together with all of them already needs no look
                    theirs = theirs[forest.roots(theirs) != tops[0]]
                link_block(forest, every, mine, theirs, r)
    return forest.roots(np.arange(len(every)))


def link_block(forest: Forest, every: np.ndarray, mine: np.ndarray, theirs: np.ndarray, r: int) -> None:
    """Link the pairs within r bits: first one for each row, then those that it left apart."""
    if not len(theirs):
        return
    close = np.bitwise_count(every[theirs][:, None] ^ every[mine][None, :]) <= r
    hit = close.any(axis=1)
    if not hit.any():
        return
    forest.link(theirs[hit], mine[close[hit].argmax(axis=1)])
    i, j = np.nonzero(close[hit])
    a, b = theirs[hit][i], mine[j]
    apart = forest.roots(a) != forest.roots(b)
    if apart.any():
        forest.link(a[apart], b[apart])


def cell_counts(home: int, visitors: int, points: int | None = None, queries: int | None = None) -> tuple[int, int]:
    """Into how many blocks a shard's own fingerprints and its visitors are split."""
    return max(1, -(-home // (points or CELL_POINTS))), max(1, -(-visitors // (queries or CELL_QUERIES)))


def dealt(distinct: DataFrame, tree: Tree, bits: int) -> DataFrame:
    """``distinct`` (fp, node) dealt to the shards that may hold a neighbour: shard, fp, node, home."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row, shard, home = tree.route(fp.view(np.uint64), bits)
            for lo in range(0, len(row), 50_000):
                s = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_pydict({"shard": shard[s].astype(np.int32), "fp": fp[row[s]], "node": node[row[s]], "home": home[s]})

    return distinct.select("fp", "node").mapInArrow(deal, "shard int, fp long, node long, home boolean")


def in_cells(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` of ``dealt`` with the cells of their shard that they go to: a column ``cell``, and ``home`` true where a
    row is searched there and false where it asks.

    ``counts`` has shard, own and others: the blocks of a shard's own rows and of its visitors.  Cell own * i + j
    searches block i; block j of the shard's own rows asks there if j > i, and cell own * own + i * others + v has visitors
    of block v.  So all pairs of a shard's own rows and of them with visitors meet, each in one cell.
    """
    blocks = rows.join(F.broadcast(counts), "shard")
    own = F.pmod(F.xxhash64("node"), F.col("own")).cast("int")
    other = F.pmod(F.xxhash64("node"), F.col("others")).cast("int")
    n, m = F.col("own"), F.col("others")
    number = lambda i, j: (n * i + j).cast("int")
    visited = lambda i, v: (n * n + i * m + v).cast("int")
    every, each = F.sequence(F.lit(0), n - 1), F.sequence(F.lit(0), m - 1)
    # as a point in the cells of its own block, as a query in those of the blocks before
    mine = F.concat(
        F.transform(F.filter(every, lambda j: j >= own), lambda j: F.struct(number(own, j).alias("cell"), F.lit(True).alias("home"))),
        F.transform(F.filter(every, lambda i: i < own), lambda i: F.struct(number(i, own).alias("cell"), F.lit(False).alias("home"))),
        F.transform(each, lambda v: F.struct(visited(own, v).alias("cell"), F.lit(True).alias("home"))),
    )
    theirs = F.transform(every, lambda i: F.struct(visited(i, other).alias("cell"), F.lit(False).alias("home")))
    return blocks.select("shard", "fp", "node", F.explode(F.when(F.col("home"), mine).otherwise(theirs)).alias("at")).select("shard", "at.cell", "fp", "node", "at.home")


def link_fingerprints(distinct: DataFrame, bits: int = BITS, depth: int | None = None, points: int | None = None, queries: int | None = None) -> DataFrame:
    """``distinct`` (fp, node): returns node, component of the fingerprints within ``bits`` of each other.

    A fingerprint without neighbours has no row.  ``depth`` of the tree and the greatest sizes of a cell follow from the
    number of fingerprints unless they are given.
    """
    spark = distinct.sparkSession
    small_batches(spark)
    if depth is None:
        depth = min(GREATEST_DEPTH, max(LEAST_DEPTH, int(np.ceil(np.log2(max(1.0, distinct.count() / SHARD_ROWS))))))
    sample = [r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp")).limit(TREE_SAMPLE << depth).collect()]
    tree = Tree(np.array(sample, dtype=np.int64).view(np.uint64), depth)

    def search(frame):
        import pandas as pd

        home = frame["home"].to_numpy(dtype=bool)
        order = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
        fp, node = frame["fp"].to_numpy()[order].view(np.uint64), frame["node"].to_numpy()[order]
        root = link_shard(fp[: home.sum()], fp[home.sum() :], bits)
        linked = np.bincount(root, minlength=len(root))[root] > 1
        return pd.DataFrame({"node": node[linked], "hub": node[root[linked]]})

    rows = dealt(distinct, tree, bits)
    # a row for each shard: at most 2 ** GREATEST_DEPTH
    held = rows.groupBy("shard").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v")).collect()
    counts = spark.createDataFrame([(r["shard"], *cell_counts(r["h"], r["v"], points, queries)) for r in held], "shard int, own int, others int")
    # a cell holds at most about CELL_POINTS and CELL_QUERIES fingerprints, 21 bytes each
    cells = in_cells(rows, counts)
    return components(cells.groupBy("shard", "cell").applyInPandas(search, "node long, hub long"))


def near_duplicates(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id, component_fp for each row: fingerprints link at ``bits`` or fewer differing bits.

    ``component_id`` is the least doc_id reachable; ``component_fp`` is one fingerprint of the component and tells apart
    components whose least ids are equal because an id has several texts.  Rows without an id get a fingerprint; they link nothing that
    no row with an id has, and their component is null if no row with an id shares their fingerprint.  Null, empty and
    wordless texts all have fingerprint 0 and so hang together.  Repeated rows stay, an id with several texts has a row
    for each.  Whole texts are read.  An empty table gives no rows.  ``keep`` names columns to carry along.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, keep=keep))
    by = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(by.where("rep is not null"))
    many = max(1000, fps.count() / HOT_KEYS)
    # an id may occur with several texts, so nodes are the fingerprints themselves
    linked = link_fingerprints(distinct.select("fp", F.col("fp").alias("node")), bits)
    lows = linked.join(distinct.select(F.col("fp").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    named = linked.join(lows, "component").select(F.col("node").alias("fp"), "low", "component")
    joined = distinct.join(named, "fp", "left")
    by_fp = materialize(joined.select("fp", F.coalesce("low", "rep").alias("component_id"), F.coalesce("component", "fp").alias("component_fp"), (F.col("n") > many).alias("hot")))
    out = split_join(fps, by_fp, "fp", "left")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias("fingerprint" if c == "fp" else c)
    return out.select("doc_id", digits("fp"), "component_id", digits("component_fp"), *(keep or []))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("component_fp")
