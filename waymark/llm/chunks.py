"""Operator 5: substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes is taken at each byte, and a chunk ends where the hash is least among
those of the bytes around it, so an end depends only on the bytes near it: text inserted elsewhere moves no
other end, and no natural text goes long without one.  Chunks are compared by digest over the whole corpus; of equal
chunks the first in (doc_id, text digest, position) order stays.  Elsewhere, runs of repeated chunks that are
long enough are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, add_columns, forget, fresh, materialize, small_batches, table, texts

#: A hash ends a chunk if none of REACH bytes before and after has one as small: a chunk is 31 bytes on average.
REACH = 15
MAX_CHUNK = 256
#: Least words of a run of repeated chunks.  A passage loses at most its first and last partial chunk to the
#: search, 25 words at the very most in prose, so 20 finds passages of 50 words; common short phrases stay.
MIN_WORDS = 20
#: One document in so many tells which chunks are common, and into how many groups those are dealt.
SAMPLE, SALTS = 16, 64

#: Gear values by rule: Knuth's multiplicative hash of the byte, 32 bits.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(3)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) * np.uint32(0x9E3779B1)


def least_ahead(h: np.ndarray, n: int) -> np.ndarray:
    """Of each place, the least of the next ``n`` values from it on (fewer at the end)."""
    out, have = h.copy(), 1
    while have < n:
        step = min(have, n - have)
        np.minimum(out[:-step], out[step:], out=out[:-step])
        have += step
    return out


def chunk_ends(data: bytes) -> np.ndarray:
    """Ends (exclusive byte offsets, ascending, the last is len(data)) of the chunks; never inside a character."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(data, dtype=np.uint8)
    h = GEAR[b]
    for k in (1, 2, 4, 8):  # h[i] = sum of gear << age over the last 2, 4, 8, 16 bytes
        if n <= k:
            break
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    ends = np.zeros(0, dtype=np.int64)
    if n > 2 * REACH + 1:
        # the least of REACH before, of REACH after; equal values before win, so a run of one byte has no end
        around = least_ahead(h, REACH)
        inner = h[REACH:-REACH]
        ends = np.flatnonzero((inner < around[: n - 2 * REACH]) & (inner <= around[REACH + 1 : n - REACH + 1])) + REACH + 1
        ends = forward(b, ends)
    ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MAX_CHUNK:
        starts = ends - gaps
        wide = np.flatnonzero(gaps > MAX_CHUNK)
        more = forward(b, np.concatenate([np.arange(starts[i] + MAX_CHUNK, ends[i], MAX_CHUNK) for i in wide]))
        ends = np.union1d(ends, more)
    return ends


def forward(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ends, moved on to the start of a character; those at the end of the text left out."""
    for _ in range(3):
        ends = ends[ends < len(b)]
        ends = ends + ((b[ends] & 0xC0) == 0x80)
    return np.unique(ends[ends < len(b)])


def digests(data: bytes, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of the chunks.  Equal digests of different chunks can't cut text alone: a run needs several."""
    import xxhash

    digest, at, out = xxhash.xxh64_intdigest, 0, []
    for end in ends.tolist():
        out.append(digest(data[at:end], 5))
        at = end
    return np.array(out, dtype=np.uint64).view(np.int64)


def chunk_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, and digests, starts and sizes (in bytes) of the chunks of every text that has an id."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("digests", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                dig, starts, sizes, at = [], [], [], [0]
                for t in texts(batch):
                    data = t.encode()
                    ends = chunk_ends(data)
                    dig.append(digests(data, ends))
                    sizes.append(np.diff(ends, prepend=0).astype(np.int32))
                    starts.append(ends.astype(np.int32) - sizes[-1])
                    at.append(at[-1] + len(ends))
                offsets = pa.array(np.array(at, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (dig, starts, sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("doc_id is not null and text <> ''")
    return rows.mapInArrow(run, "doc_id long, text_hash long, digests array<long>, starts array<int>, sizes array<int>")


def chunk_rows(lists: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, size, digest for every chunk."""
    rows = lists.select("doc_id", "text_hash", F.explode(F.arrays_zip("digests", "starts", "sizes")).alias("c"))
    return rows.select("doc_id", "text_hash", F.col("c.starts").alias("start"), F.col("c.sizes").alias("size"), F.col("c.digests").alias("digest"))


def measure(data: bytes) -> int:
    """Words of a run; where a script has no spaces, two characters of three bytes count as one word."""
    wide = sum(map(data.count, _THREE)) if not data.isascii() else 0
    return max(len(data.split()), wide // 2)


_THREE = [bytes([b]) for b in range(0xE0, 0xF0)]


def cut(text: str, repeated: list[tuple[int, int]], min_words: int = MIN_WORDS) -> tuple[str, list[tuple[int, int]], int]:
    """Text without its long runs of repeated (start, size) byte ranges, the (start, end) byte spans cut, their words."""
    if not repeated:
        return text, [], 0
    data = text.encode()
    at = np.array(sorted(set(repeated)), dtype=np.int64)
    first, last = at[:, 0], at.sum(axis=1)
    new = np.flatnonzero(first[1:] != last[:-1]) + 1
    spans, kept, words, done = [], [], 0, 0
    for a, b in zip(first[np.append(0, new)].tolist(), last[np.append(new - 1, len(at) - 1)].tolist()):
        n = measure(data[a:b])
        if n >= min_words:
            spans.append((a, b))
            kept.append(data[done:a])
            words, done = words + n, b
    kept.append(data[done:])
    return b"".join(kept).decode(), spans, words


def repeated_chunks(lists: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, size of every chunk but the first in (doc_id, text_hash, start) order of each digest.

    Rows are sorted by digest and order.  Chunks that hold more than a share of those of a sample of documents are common:
    at most HOT_KEYS digests.  Their rows are dealt to SALTS groups each; all but the first of a group are repeats, and the
    firsts, at most HOT_KEYS * SALTS rows, are ranked among themselves.
    """
    some = lists.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SAMPLE)) == 0)
    counts = chunk_rows(some).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    n = some.agg(F.sum(F.size("digests"))).first()[0] or 0
    hot = materialize(counts.where(F.col("n") > max(8, n / HOT_KEYS)).select(F.col("digest").alias("hot")))
    common = F.col("hot").isNotNull()
    salt = F.when(common, F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS))).otherwise(0)
    told = chunk_rows(lists).join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left").withColumn("common", common).withColumn("salt", salt)
    # equal rows are one document: dense_rank gives them one rank
    order = ["doc_id", "text_hash", "start"]
    rank = F.dense_rank().over(Window.partitionBy("digest", "salt").orderBy(*order))
    ranked = materialize(told.withColumn("r", rank).where("r > 1 or common").select(*order, "size", "digest", "r"))
    forget(hot)
    among = F.dense_rank().over(Window.partitionBy("digest").orderBy(*order))
    firsts = ranked.where("r = 1").withColumn("r", among)
    return ranked.where("r > 1").unionByName(firsts.where("r > 1")).select(*order, "size")


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text deduplicated, and removed_words, removed_bytes and removed_spans added.

    removed_spans are byte spans of the original text.  The occurrence first in (id, text digest, position) order
    stays, also inside one document.  Rows with equal id and text are one document; rows of one id with other texts are
    documents of their own.  Rows without an id, and null and empty texts, stay as they are; an empty table gives no
    rows.  Every chunk of every document is compared, and whole texts are cut.
    """
    lists = materialize(chunk_lists(docs, id_col, text_col))
    # a list is as long as its document has chunks
    own, hashed, rest = fresh(docs, "_id"), fresh(docs, "_hash"), fresh(docs, "_again")
    found = repeated_chunks(lists).groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).agg(F.collect_list(F.struct("start", "size")).alias(rest))
    ids = F.col(id_col).cast("long")
    known = docs.where(ids.isNotNull())
    joined = known.join(found, (ids == F.col(own)) & (F.xxhash64(text_col) == F.col(hashed)), "left").drop(own, hashed)
    joined = joined.unionByName(docs.where(ids.isNull()).withColumn(rest, F.lit(None).cast(joined.schema[rest].dataType)))

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in (text_col, "removed_words", "removed_bytes", "removed_spans")}
            column, lists_ = batch.column(batch.schema.get_field_index(text_col)), batch.column(batch.schema.get_field_index(rest))
            for t, again in zip(column, lists_):
                text = t.as_py()
                new, spans, words = cut(text or "", [(x["start"], x["size"]) for x in again.as_py() or []], min_words)
                out[text_col].append(None if text is None else new)
                out["removed_words"].append(words)
                out["removed_bytes"].append(sum(b - a for a, b in spans))
                out["removed_spans"].append([{"start": a, "end": b} for a, b in spans])
            return out

        return f

    added = f"`{text_col}` string, removed_words long, removed_bytes long, removed_spans array<struct<start: long, end: long>>"
    return add_columns(joined, make, added, keep=docs.columns)


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its deduplicated text and what was cut."""
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
