"""Operator 2: token ids as Parquet list columns.

Documents are dealt by ranges of their id, sorted, encoded and written by Spark's Parquet writer: dictionary
encoding for the token lists (a 50k vocabulary fits one dictionary page), row groups and pages of set sizes,
and the page indexes the writer adds.  Reading the ids, or only ``doc_id`` and ``n_tokens``, or one id range
touches just those columns and pages.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, small_batches, table

END_ID = 2
#: Memory that each of a worker's tables of words and their ids may take, by estimate; beyond it the table starts anew.  There
#: are four: of parts, of words without a space before, of words with one, and the one before that.
CACHE_BYTES = 32 << 20
#: Parts that the model takes in a row.
ROW = 200
#: New words that are encoded at once.
AT_ONCE = 8192
#: Bytes of texts that are encoded at once: the more, the fewer words are looked up again.
TEXT_BYTES = 2 << 20
#: Longer words are encoded again each time.
LONGEST = 64
#: The writer's layout.
WRITER = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "snappy",
}


#: The byte-level pre-tokenizer's alternatives in its order, over characters whose class is beyond doubt.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЁА-яёぁ-んァ-ヶ一-龥"
MARKS = "!-/:-@\\[-`{-~"
TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\n(?=[{LETTERS}0-9{MARKS}])")
#: What no run of words that TOKENS covers has: such words are apart from their neighbours, too.
DOUBTFUL = re.compile(rf"[^{LETTERS}0-9{MARKS}\n]|^\n|\n(?![{LETTERS}0-9{MARKS}])")
#: The character that stands for a space in a byte-level vocabulary.
SPACE = "\u0120"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    at = dict(zip(seen, seen)) | {b: 256 + i for i, b in enumerate(rest)}
    return [chr(at[b]) for b in range(256)]


class OddSpacing(Exception):
    """A word that is empty or begins or ends with white space: it may share a pre-token with its neighbours."""


def apart(word: str) -> bool:
    """Whether a pre-token surely starts at the space before a word and at the one behind it."""
    return bool(word) and word[0].isprintable() and word[-1].isprintable() and not word[0].isspace() and not word[-1].isspace()


class Heads(dict):
    """Ids of the words that texts begin with, each found out when it is first asked for; a full table starts anew."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.held = encoder, 0

    def __missing__(self, word: str) -> bytes:
        if not apart(word):
            raise OddSpacing
        ids = self.encoder.whole(word)
        if len(word) <= LONGEST:
            self[word] = ids
            self.held += 220 + len(ids)  # a string, its ids and their place in the table
        return ids

    def renew(self) -> None:
        if self.held > CACHE_BYTES:
            self.held = 0
            self.clear()


class Table:
    """Ids of strings, in one array; ``row`` tells which of its lists a string has.  List 0 is empty: that of unknown strings."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.n, self.at, self.ids = 1, np.zeros(1 << 12, dtype=np.int32), np.empty(1 << 14, dtype=np.int32)

    def full(self) -> bool:
        return 220 * self.n + 4 * int(self.at[self.n]) > CACHE_BYTES  # a string, its ids and their place in the table

    def rows(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.get, strings, itertools.repeat(0)), dtype=np.int32, count=len(strings))

    def take(self, rows: np.ndarray) -> pa.ListArray:
        at = self.at[: self.n + 1]
        return pa.ListArray.from_arrays(pa.array(at), pa.array(self.ids[: at[-1]])).take(pa.array(rows))

    def put(self, strings: list[str], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Add strings that aren't held; ``ends``: where the ids of each end.  Returns their lists."""
        n, held = self.n + len(strings), int(self.at[self.n])
        if n >= len(self.at):
            self.at = np.append(self.at, np.zeros(n, dtype=np.int32))
        if held + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.empty(held + len(ids), dtype=np.int32))
        self.at[self.n + 1 : n + 1] = held + ends
        self.ids[held : held + len(ids)] = ids
        self.row.update(zip(strings, range(self.n, n)))
        self.n = n
        return np.arange(n - len(strings), n, dtype=np.int32)


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    """Where runs end of which ``n`` start where ``starts`` says, the first one at once."""
    at = np.flatnonzero(starts)
    if len(at) != n:
        raise ValueError("not a byte-level BPE tokenizer with the usual pre-tokenizer")
    return np.append(at, len(starts))[1:]


class Encoder:
    """Whole-text ids by the tokenizers library, each distinct word encoded once.

    The library's byte-level pre-tokenizer always starts a token at a space that stands between two
    non-space characters, and BPE never crosses it, so a text is the concatenation of its space-led words.
    The words of some texts that aren't known yet are written in a row and cut there by TOKENS, which covers them without a
    gap, just as the pre-tokenizer cuts them; the library's model encodes the parts that aren't known, in one call.  A space is
    only ever in the first token of a word, which tells whose ids are whose.  Any other word goes through the library by
    itself, and texts with any other spacing go through it whole; so do texts with the string of an added token, which the
    library cuts out before all else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.shown = dict(enumerate(byte_characters()))
        vocabulary = self.library.get_vocab()
        self.model = Tokenizer(self.library.model)  # alone: it takes parts as the vocabulary shows them, with a zero byte between
        self.zero = vocabulary.get(self.shown[0])
        if sum(self.shown[0] in t for t in vocabulary) != 1:
            raise ValueError("the tokenizer has no token for the zero byte, or others with it")
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.heads, self.parts, self.words, self.before = Heads(self), Table(), Table(), Table()
        probe = "It's one, two.\nÀ 1995 (x)!"
        if self.encode(probe) != self.whole(probe) or "two.\nÀ" not in self.words.row:
            raise ValueError("not a byte-level BPE tokenizer with the usual pre-tokenizer")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> np.ndarray:
        """Find out the ids of distinct words that aren't known yet, many at once.  Returns their lists: 0 for those left out."""
        rows = self.before.rows(words)
        if len(old := np.flatnonzero(rows)):
            lists = self.before.take(rows[old])
            rows[old] = self.words.put([words[i] for i in old.tolist()], lists.values.to_numpy(), lists.offsets.to_numpy()[1:])
        new = [i for i in np.flatnonzero(rows == 0).tolist() if 0 < len(words[i]) <= LONGEST]
        for lo in range(0, len(new), AT_ONCE):
            at = new[lo : lo + AT_ONCE]
            some = [words[i] for i in at]
            parts = TOKENS.findall(row := " " + " ".join(some))
            if sum(map(len, parts)) != len(row):
                at = [i for i in at if not DOUBTFUL.search(words[i])]
                some = [words[i] for i in at]
                parts = TOKENS.findall(" " + " ".join(some)) if some else []
            ids = self._parts(parts)
            rows[at] = self.words.put(some, ids, _ends(self.leads[ids], len(some)))
        return rows

    def _parts(self, parts: list[str]) -> np.ndarray:
        """The ids of parts, one behind the other."""
        if self.parts.full():
            self.parts = Table()
        rows = self.parts.rows(parts)
        if len(at := np.flatnonzero(rows == 0)):
            some = [parts[i] for i in at.tolist()]
            new = list(dict.fromkeys(some))
            # each part as the vocabulary shows its bytes; none has a zero byte, and no merge crosses one
            texts = ["\0".join(new[i : i + ROW]).encode().decode("latin-1").translate(self.shown) for i in range(0, len(new), ROW)]
            lists = [x for e in self.model.encode_batch_fast(texts, add_special_tokens=False) for x in ([self.zero], e.ids)]
            ids = np.array(list(itertools.chain.from_iterable(lists)), dtype=np.int32)
            ends = _ends(ids == self.zero, len(new)) - np.arange(1, len(new) + 1)
            self.parts.put(new, ids[ids != self.zero], ends)
            rows[at] = self.parts.rows(some)
        return self.parts.take(rows).values.to_numpy()

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.ListArray:
        """Ids of each text, ``end`` behind them; no text is null.  A word is looked up once, however often the texts have it."""
        self.heads.renew()
        if self.words.full():
            self.words, self.before = Table(), self.words
        n, cut = len(texts), pc.split_pattern(texts, " ")
        first, stop = cut.offsets.to_numpy()[:-1], cut.offsets.to_numpy()[1:]
        coded = cut.flatten().dictionary_encode()
        code, distinct = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        led = np.ones(len(code), dtype=bool)
        led[first] = False
        used = np.bincount(code[led], minlength=len(distinct)) > 0
        rows, odd, more = self.words.rows(distinct), np.zeros(len(distinct), dtype=bool), {}
        new = np.flatnonzero(used & (rows == 0))
        rows[new] = self.learn([distinct[i] for i in new.tolist()])
        for i in np.flatnonzero(used & (rows == 0)).tolist():
            if apart(distinct[i]):
                more[i] = self.whole(" " + distinct[i])
            else:
                odd[i] = True
        if short := [i for i in more if len(distinct[i]) <= LONGEST]:
            data = b"".join(map(more.get, short))
            self.words.put([distinct[i] for i in short], np.frombuffer(data, dtype="<i4"), np.cumsum([len(more[i]) // 4 for i in short]))
        whole = np.logical_or.reduceat(odd[code] & led, first) if odd.any() else np.zeros(n, dtype=bool)
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        starts = []
        for i, k in enumerate(code[first].tolist()):
            try:
                starts.append(None if whole[i] else self.heads[distinct[k]])
            except OddSpacing:
                whole[i] = True
                starts.append(None)
        for i in np.flatnonzero(whole).tolist():
            starts[i] = self.whole(texts[i].as_py())
        # the table of entries: known words, what the texts begin with, nothing (in place of the words of texts encoded whole), the
        # end, words encoded by themselves
        m, known = len(distinct), self.words.take(rows)
        if more:
            to = np.arange(m, dtype=code.dtype)
            to[list(more)] = m + n + 2 + np.arange(len(more))
            code = to[code]
        code[first] = m + np.arange(n)
        if whole.any():
            code[led & np.repeat(whole, stop - first)] = m + n
        code = np.insert(code, stop, m + n + 1)
        others = [*starts, b"", end, *more.values()]
        at = np.append(known.offsets.to_numpy(), len(known.values) + np.cumsum([len(x) // 4 for x in others])).astype(np.int32)
        ids = np.append(known.values.to_numpy(), np.frombuffer(b"".join(others), dtype="<i4"))
        size = np.add.reduceat(np.diff(at)[code], first + np.arange(n))
        held = pa.ListArray.from_arrays(pa.array(at), pa.array(ids))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), held.take(pa.array(code)).flatten())

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_column(pa.array([text])).values.to_numpy().tobytes()


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` and write files in ascending id order under ``path``.

    Columns: doc_id, part (number of the file's range), start_in_part, n_tokens, tokens.  A null text is empty
    and gets the end id alone.  Rows of one id are ordered by their text; null ids come first.  An empty table
    gives files without rows.  Whole texts are encoded as the library does by default: the string of an added
    token in a text becomes that token.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, part = shared_encoder(tokenizer), 0, TaskContext.get().partitionId()
        for some in slices(batches, TEXT_BYTES):
            tokens = encoder.encode_column(some.column(1), end)
            ends = tokens.offsets.to_numpy()[1:].astype(np.int64)
            n = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(at + ends - n), pa.array(n), tokens], schema=schema)
            at += int(ends[-1])

    rows.mapInArrow(encode, "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>").write.options(**WRITER).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start, n_tokens: reads no token page.  ``start`` counts the ids of all documents before."""
    rows = spark.read.parquet(path).select("doc_id", "part", "start_in_part", "n_tokens")
    return _with_start(spark, path, rows)


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Rows with their tokens; an id range is pushed to the page indexes."""
    rows = spark.read.parquet(path)
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return _with_start(spark, path, rows)


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    # one row for each written range (never more than the writer's partitions): its offset is broadcast
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    offsets, at = [], 0
    for r in sums:
        offsets.append((r["part"], at))
        at += r["n"]
    return rows.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part").withColumn("start", F.col("offset") + F.col("start_in_part"))


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids, read back from the files."""
    small_batches(spark)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.values.to_numpy().view("<u4"), lists.offsets.to_numpy().tolist()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "tokens").mapInArrow(report, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_report(spark, path)
