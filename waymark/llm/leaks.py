"""Operator 1: benchmark decontamination by latent semantic retrieval.

Passages are weighted by TF-IDF over a hashed vocabulary whose document frequencies come from the whole corpus.
A randomised SVD, its products computed by Spark tasks over a written table of passages, gives a latent space of all
items of the benchmark; no document is drawn as a sample for it.  Every stretch of every document is projected and compared with
every benchmark item by cosine; candidates are then checked by the longest common subsequence of words and, where that
is shorter, by whether the item's closing words (its answer) occur too.

The cosine is that of the item with the stretch's words that the item has: other words of the stretch count for
nothing, whether rare or many, and a stretch reaches as far as the check does.  For words that occur once the square of
that cosine is the product of item and stretch over the item's squared length, so a product with a matrix of terms and
items, scaled by each item's threshold, finds every candidate.  An item's commonest words are taken as present, up to
a small share of its weight, so that their repetitions don't make every stretch a candidate.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, forget, fresh, materialize, small_batches, sum_packed, table, texts

BUCKETS = 1 << 16
#: A window of the check, and the distance from one to the next.
WINDOW, STRIDE = 32, 16
RANK, OVERSAMPLE, POWER = 256, 16, 2
#: Items of one latent space, fewer than its rank, so that it has all their directions; and items of one pass over the corpus (a pass's spaces are broadcast together: about 5 MB for each 240 items).
SPACE_ITEMS, PASS_ITEMS = 240, 1200
COSINE = 0.5
#: Share of an item's squared weight in its commonest words that a stretch is taken to have without a look.
GRANTED = 0.5 * COSINE**2
#: Neighbouring windows looked at together before each alone.
RUN = 12
#: Items whose candidates are bounded together.
GROUP = 12
#: Share of the item's words in the common subsequence: alone, or with the answer's words.
LCS_ALONE, LCS_WITH_ANSWER = 0.7, 0.5
ANSWER_WORDS, ANSWER_FOUND = 5, 0.8


_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Marks that don't belong to a word.
PUNCTUATION = b".,;:!?\"'()[]{}*#$%&|<>-_/"


def split_words(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation at their ends."""
    return [w for w in (x.strip(PUNCTUATION) for x in text.lower().encode().split()) if w]


#: Bytes hashed at once: longer texts are cut at white space.
PIECE = 1 << 16
#: Of each byte: 0 white space, 1 punctuation, 2 any other.
KIND = np.full(256, 2, dtype=np.uint8)
KIND[list(PUNCTUATION)] = 1
KIND[list(b" \t\n\r\x0b\x0c")] = 0
#: An odd factor and its inverse modulo 2**32, for the words' polynomial hashes.
FACTOR = 0x9E3779B1
INVERSE = pow(FACTOR, -1, 1 << 32)


@functools.lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of FACTOR and of INVERSE modulo 2**32."""
    out = np.empty((2, n), dtype=np.uint32)
    for row, x in zip(out, (FACTOR, INVERSE)):
        row[0], row[1:] = 1, np.uint32(x)
        np.multiply.accumulate(row, out=row)
    return out[0], out[1]


def terms(text: str) -> np.ndarray:
    """Bucket of each word of ``split_words``: array hashes of the words' bytes, without a Python object a word."""
    return located(text.lower().encode())[0]


def located(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of lower-case ``data``, and where each begins and ends."""
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            cut = _SPACE.search(data, at + PIECE)
            end = cut.start() if cut else end
        out.append(_piece(np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at), at))
        at = end
    if len(out) == 1:
        return out[0]
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, dtype=np.int64),) * 3


def _piece(raw: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = KIND[raw]
    inner = np.flatnonzero(kind == 2).astype(np.int32)
    if not len(inner):
        return (np.zeros(0, dtype=np.int64),) * 3
    word = np.cumsum(kind == 0, dtype=np.int32)[inner]
    new = np.flatnonzero(word[1:] != word[:-1])
    first, last = inner[np.append(0, new + 1)], inner[np.append(new, len(inner) - 1)]
    up, down = powers(1 << max(PIECE.bit_length(), len(raw).bit_length()))
    total = np.empty(len(raw) + 1, dtype=np.uint32)
    total[0] = 0
    np.cumsum(raw * up[: len(raw)], out=total[1:], dtype=np.uint32)
    h = (total[last + 1] - total[first]) * down[first]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64), first.astype(np.int64) + at, last.astype(np.int64) + 1 + at


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents; over the whole corpus.

    Each task returns packed counts; they are summed in two steps, so no group holds more than a share of the
    tasks.
    """
    small_batches(docs.sparkSession)
    part = 1024

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for t in texts(batch):
                df[np.unique(terms(t))] += 1
                n += 1
        if n:
            rows = [df[i : i + part].tobytes() for i in range(0, BUCKETS, part)] + [np.int64(n).tobytes()]
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(rows), dtype=np.int32)), "data": pa.array(rows, pa.binary())})

    got = sum_packed(docs.select(F.col(text_col).alias("text")).mapInArrow(count, "at int, data binary"))
    if not got:
        return np.zeros(BUCKETS, dtype=np.int64), 0
    return np.concatenate([got[i] for i in range(BUCKETS // part)]), int(got[BUCKETS // part][0])


def idf_weights(df: np.ndarray, n: int) -> np.ndarray:
    """ln(1 + n / df), which is positive for any term: an item stays findable however many documents have it."""
    return np.log1p(max(n, 1) / (df + 0.5)).astype(np.float32)


@dataclass
class Space:
    """Latent space: a row of ``basis`` for each bucket in ``row`` (-1: outside), and the items' unit vectors and lengths."""

    idf: np.ndarray
    row: np.ndarray
    basis: np.ndarray
    items: np.ndarray
    norms: np.ndarray
    ids: list
    words: list[list[bytes]]


def vector(words: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of a passage as (buckets, weights)."""
    t, tf = np.unique(terms(b" ".join(words).decode()), return_counts=True)
    return t, (tf * idf[t]).astype(np.float32)


def passage_table(passages: DataFrame, idf: np.ndarray) -> DataFrame:
    """``passages`` (text) as unit TF-IDF rows: cols, weights (packed); written to the shared folder."""
    shared = passages.sparkSession.sparkContext.broadcast(idf)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [vector(split_words(t), shared.value) for t in texts(batch)]
            cols = [t.astype(np.int32).tobytes() for t, _ in got]
            unit = [(w / max(float(np.linalg.norm(w)), 1e-12)).astype(np.float32).tobytes() for _, w in got]
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.binary()), pa.array(unit, pa.binary())], names=["cols", "weights"])

    out = materialize(passages.select("text").mapInArrow(rows, "cols binary, weights binary"))
    shared.destroy()
    return out


def used_columns(matrix: DataFrame) -> np.ndarray:
    """The columns that a table of rows uses, ascending: at most BUCKETS."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for c in batch.column(0):
                n[np.frombuffer(c.as_py(), dtype=np.int32)] += 1
        yield pa.RecordBatch.from_pydict({"at": pa.array([0], pa.int32()), "data": pa.array([n.tobytes()], pa.binary())})

    got = sum_packed(matrix.select("cols").mapInArrow(seen, "at int, data binary"))
    return np.flatnonzero(got[0]) if got else np.zeros(0, dtype=np.int64)


#: Columns of one packed block of a product.
BLOCK = 2048


def randomised_svd(matrix: DataFrame, used: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (len(used), <= rank) of a table of sparse rows (cols, weights) over columns ``used``.

    A task multiplies its rows, A'(A X), into one sum; the sums of tasks are added by Spark block by block, so the driver
    gets one matrix of the size of X for each product.
    """
    spark, width = matrix.sparkSession, len(used)
    wide = min(rank + OVERSAMPLE, max(1, min(width, matrix.count())))
    row = np.full(BUCKETS, -1, dtype=np.int32)
    row[used] = np.arange(width)

    def gram(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((row, x))

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (row_, x_), y = shared.value, None
            for batch in batches:
                y = np.zeros_like(x_) if y is None else y
                for c, w in zip(*(batch.column(i).to_pylist() for i in range(2))):
                    c, w = row_[np.frombuffer(c, dtype=np.int32)], np.frombuffer(w, dtype=np.float32)
                    y[c] += w[:, None] * (w @ x_[c])
            for at in range(0, width, BLOCK) if y is not None else ():
                yield pa.RecordBatch.from_pydict({"at": pa.array([at // BLOCK], pa.int32()), "data": pa.array([y[at : at + BLOCK].astype(np.float32).tobytes()], pa.binary())})

        got = sum_packed(matrix.mapInArrow(f, "at int, data binary"), np.float32)
        shared.destroy()
        return np.concatenate([got[i] for i in sorted(got)]).reshape(x.shape)

    x = np.random.default_rng(seed).standard_normal((width, wide)).astype(np.float32)
    for _ in range(POWER):
        x = np.linalg.qr(gram(x))[0].astype(np.float32)
    small = x.T @ gram(x)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-6 * max(values.max(), 1e-12)]
    return (x @ turn[:, order]).astype(np.float32)


def build_space(spark: SparkSession, items: list[tuple], idf: np.ndarray) -> Space:
    """Fit the latent space on all of the items (id, words)."""
    matrix = passage_table(spark.createDataFrame([(b" ".join(w).decode(),) for _, w in items], "text string"), idf)
    used = used_columns(matrix)
    basis = randomised_svd(matrix, used, RANK)
    forget(matrix)
    row = np.full(BUCKETS, -1, dtype=np.int32)
    row[used] = np.arange(len(used))
    got, norms = np.zeros((len(items), basis.shape[1]), dtype=np.float32), np.zeros(len(items))
    for i, (_, words) in enumerate(items):
        t, w = vector(words, idf)
        got[i], norms[i] = w @ basis[row[t]], np.linalg.norm(w)
    size = np.linalg.norm(got, axis=1, keepdims=True)
    return Space(idf, row, basis, got / np.where(size > 0, size, 1), norms, [i for i, _ in items], [w for _, w in items])


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence of words, bit by bit over ``a``."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = at.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Search:
    """Which items a document's stretches may hold, by their cosine in one latent space."""

    def __init__(self, s: Space):
        self.space = s
        # items by class of length: how many blocks their stretches reach on both sides
        reach = np.array([-(-len(w) // STRIDE) for w in s.words])
        self.order = np.argsort(reach, kind="stable")
        self.reach = reach[self.order]
        self.product = np.zeros((len(s.basis) + 1, len(self.order)), dtype=np.float32)
        self.product[:-1] = np.maximum(s.basis @ s.items[self.order].T, 0)
        self.product[:-1] *= s.idf[s.row >= 0][:, None]
        # of each item, its words with their count and share of the squared weight
        self.squares = []
        place = np.argsort(self.order)
        for j, w in enumerate(s.words):
            n = Counter(w)
            own = dict(zip(n, terms(b" ".join(n).decode()).tolist()))
            square = {x: float(k * s.idf[own[x]]) ** 2 for x, k in n.items()}
            total = sum(square.values())
            self.squares.append({x: (n[x], v / total) for x, v in square.items()})
            granted = 0.0
            for x, v in sorted(square.items(), key=lambda x: (s.idf[own[x[0]]], x[0])):
                if granted + v / total > GRANTED:
                    break
                granted += v / total
                self.product[s.row[own[x]], place[j]] = 0
            self.product[:, place[j]] /= (COSINE**2 - granted) * s.norms[j]
        self.row = np.where(s.row >= 0, s.row, len(s.basis)).astype(np.int32)
        # groups of items of one class, and what a term can add to the candidate value of any item of each
        self.groups = [(r, j, min(j + GROUP, j1)) for r in np.unique(self.reach).tolist() for j0, j1 in [np.searchsorted(self.reach, [r, r + 1]).tolist()] for j in range(j0, j1, GROUP)]
        self.bound = np.stack([self.product[:, j0:j1].max(axis=1) for _, j0, j1 in self.groups], axis=1)
        self.counts = self.bound.max(axis=1) > 0

    def candidates(self, b: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, windows and candidate values from 1 on, for words with buckets ``b`` in blocks ``at`` of ``n``.

        Window k is blocks k and k + 1.  Texts must lie more than ``gap`` blocks apart.
        """
        row = self.row[b]
        told = np.flatnonzero(self.counts[row])  # words that no item has, or all have, add nothing
        row, at = row[told], at[told]
        coarse, out = _by_block(self.bound, row, at, n), []
        for g, (reach, j0, j1) in enumerate(self.groups):
            live = np.flatnonzero(_sums(coarse[:, g : g + 1], reach)[:, 0] >= 0.999)
            if not len(live):
                continue
            # the blocks that live windows reach, runs of them set apart
            edges = np.bincount(np.maximum(live - reach, 0), minlength=n + 1) - np.bincount(np.minimum(live + 2 + reach, n), minlength=n + 1)
            need = np.cumsum(edges[:n]) > 0
            place = np.cumsum(need) - 1 + (np.cumsum(need & ~np.append(False, need[:-1])) - 1) * (reach + 2)
            own = need[at]
            got = _sums(_by_block(self.product[:, j0:j1], row[own], place[at[own]], int(place[-1]) + 1), reach)[place[live]]
            i, j = np.nonzero(got >= 0.999)
            out.append((self.order[j0 + j], live[i], got[i, j]))
        if not out:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(map(np.concatenate, zip(*out)))

    def may_hold(self, j: int, near: list[bytes]) -> float:
        """The squared cosine of an item with a stretch, 0 if it has too few of the item's words for the check."""
        present = set(near)
        shared = [x for x in self.squares[j] if x in present]
        if sum(self.squares[j][x][0] for x in shared) < LCS_WITH_ANSWER * len(self.space.words[j]):
            return 0.0
        return sum(self.squares[j][x][1] for x in shared)

    def check(self, j: int, near: list[bytes], start: int) -> dict | None:
        """The leak of an item in a stretch of words, or None: its cosine, subsequence and answer."""
        s, item, like = self.space, self.space.words[j], self.may_hold(j, near)
        if like < COSINE**2:
            return None
        share, answer, present = lcs(item, near) / len(item), item[-ANSWER_WORDS:], set(near)
        found = sum(w in present for w in answer) / len(answer)
        if share >= LCS_ALONE or share >= LCS_WITH_ANSWER and found >= ANSWER_FOUND:
            return {"item_id": s.ids[j], "cosine": min(1.0, like**0.5), "lcs": share, "answer": found, "start_word": start}
        return None


def _by_block(table_: np.ndarray, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of a table over the words of each of ``n`` blocks; ``at`` is each word's block, ascending."""
    out = np.zeros((n, table_.shape[1]), dtype=np.float32)
    if len(at):
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[new]] = np.add.reduceat(table_[row], new, axis=0)
    return out


def _sums(blocks: np.ndarray, reach: int) -> np.ndarray:
    """Of each window (two blocks), the sums over it and ``reach`` blocks on both sides."""
    n = len(blocks)
    total = np.zeros((n + 2 * reach + 2, blocks.shape[1]))
    np.cumsum(blocks, axis=0, dtype=np.float64, out=total[reach + 1 : reach + 1 + n])
    total[reach + 1 + n :] = total[reach + n]
    return total[2 * reach + 2 :] - total[:n] if n else blocks


class Finder:
    """Leaks in documents, a batch of them at a time."""

    def __init__(self, spaces: list[Space]):
        self.searches = [Search(s) for s in spaces if s.ids]
        self.gap = max((int(x.reach[-1]) for x in self.searches), default=0) + 2

    def find(self, texts_: list[str]) -> list[list[dict]]:
        """The leaks of each text."""
        out: list[list[dict]] = [[] for _ in texts_]
        data = [t.lower().encode() for t in texts_]
        places = [located(x) for x in data]
        n = np.array([len(b) for b, _, _ in places], dtype=np.int64)
        if not self.searches or not n.sum():
            return out
        size = -(-n // STRIDE) + self.gap
        first = np.cumsum(size) - size
        b = np.concatenate([x for x, _, _ in places])
        of = np.repeat(np.arange(len(n)), n)
        at = first[of] + (np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n)) // STRIDE
        for search in self.searches:
            item, window, value = search.candidates(b, at, int(size.sum()))
            text = np.searchsorted(first, window, side="right") - 1
            k = window - first[text]
            ok = k < np.maximum(1, -(-(n[text] - STRIDE) // STRIDE))  # the others reach no further than these
            order = np.lexsort((k[ok], item[ok], text[ok]))
            text, item, k, value = (x[ok][order] for x in (text, item, k, value))
            new = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
            for lo, hi in zip(np.append(0, new).tolist(), np.append(new, len(text)).tolist()) if len(text) else ():
                i = int(text[lo])
                if leak := self._first(search, int(item[lo]), k[lo:hi], value[lo:hi], data[i], places[i]):
                    out[i].append(leak)
        return out

    @staticmethod
    def _first(search: Search, j: int, windows: np.ndarray, value: np.ndarray, data: bytes, place: tuple) -> dict | None:
        """The leak of an item in the windows (ascending) of one text: those of greatest value first, until one passes."""
        _, first, last = place
        length, n = len(search.space.words[j]), len(first)
        near = lambda a, z: [data[x:y] for x, y in zip(first[max(0, a) : z].tolist(), last[max(0, a) : z].tolist())]
        # a run of windows can't hold more than all its words together
        kept = []
        for run in np.split(np.arange(len(windows)), np.flatnonzero((np.diff(windows) > 1) | (np.arange(1, len(windows)) % RUN == 0)) + 1):
            if search.may_hold(j, near(int(windows[run[0]]) * STRIDE - length, int(windows[run[-1]]) * STRIDE + WINDOW + length)) >= COSINE**2:
                kept.extend(run.tolist())
        for i in sorted(kept, key=lambda i: (-value[i], i)):
            start = int(windows[i]) * STRIDE
            if leak := search.check(j, near(start - length, min(start + WINDOW, n) + length), start):
                return leak
        return None


_HELD: dict[str, Finder] = {}


def held_finder(shared) -> Finder:
    """The finder of a broadcast list of spaces, kept by a Python worker from task to task until it gets another."""
    key, spaces = shared.value
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Finder(spaces)
    return _HELD[key]


LEAK = "array<struct<item_id: long, cosine: double, lcs: double, answer: double, start_word: long>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``leaks`` added: the benchmark items found in each whole text.

    The benchmark is the query set.  It goes through in passes of about PASS_ITEMS items: only one pass's items and
    latent spaces are read, fitted and broadcast at a time, and with several passes each is written before the next.
    Null and empty texts have no leaks; an empty benchmark, and an item without a word, finds none; repeated items and
    rows are found each under its id; an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    n_passes = max(1, -(-items.count() // PASS_ITEMS))
    df, n = document_frequencies(docs, text_col)
    idf = idf_weights(df, n)
    out = docs.drop(*[c for c in docs.columns if c.lower() == "leaks"])
    columns, name = out.columns, fresh(out, "_leaks")
    written = None
    for k in range(n_passes):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_passes)) == k).collect() if n_passes > 1 else items.collect()
        block = [(i, w) for i, w in sorted(((r["i"], split_words(r["t"])) for r in rows), key=lambda x: (x[0] is not None, x)) if w]
        spaces = [build_space(spark, block[i : i + SPACE_ITEMS], idf) for i in range(0, len(block), SPACE_ITEMS)]
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, spaces))

        def make(shared=shared):
            finder = held_finder(shared)
            return lambda batch: {name: finder.find(list(texts(batch, text_col)))}

        out = add_columns(out, make, f"{name} {LEAK}").select(*columns, F.concat(*(["leaks"] if k else []), name).alias("leaks"))
        if n_passes > 1:
            out = materialize(out)
            if written is not None:
                forget(written)
            shared.destroy()
            written = out
    return out


def op1_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
