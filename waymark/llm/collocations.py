"""Operator 12: phrase collocations by hierarchical pair naming.

Texts become blocks of word codes.  Counts of a block's words are summed over all blocks, frequent words get ids by a
join, and the ids go back to the blocks; there two adjacent ids make a pair, whose counts, ids and return are the same
again.  A pair of adjacent ids of k-1 words is a phrase of k words, and the two ids are its parent pointers: they give
the counts of its cuts and tell what a longer phrase subsumes.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialize, small_batches, table

LEAST, MOST_WORDS, KEPT = 10, 3, 2000
#: A phrase goes if a longer one that holds it has this percentage of its occurrences.
SUBSUMED = 50
UNKNOWN = "und"
#: Words of a block, and bytes of a text that are cut at once.
BLOCK_WORDS, PART = 1 << 20, 1 << 20
#: Blocks that a task may make.
TASK_BLOCKS = 1 << 12

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: A byte that no UTF-8 text has stands for a separator; tabs become spaces, so that split() cuts at spaces alone.
STOP = b"\xff"
TABLE = bytes.maketrans(SEPARATORS + b"\t", STOP * len(SEPARATORS) + b" ")
STOPS = re.compile(b"[" + re.escape(SEPARATORS) + b"]")

BLOCKS = "block long, codes binary, grams array<struct<lang: string, word: string, n: long>>"
PAIRS = "block long, codes binary, grams array<struct<a: long, b: long, n: long>>"


def parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``PART`` bytes, cut at separators only."""
    at = 0
    while at < len(text):
        m = STOPS.search(text, at + PART)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def word_blocks(docs: DataFrame, lang_col: str, text_col: str, block_words: int) -> DataFrame:
    """Blocks of whole texts: ``codes`` (int32; 0 between pieces) and the words of code 1, 2, ... with their language and count.

    A block holds about ``block_words`` words and cuts no piece, so a piece without separators is held whole.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * TASK_BLOCKS
        numbers = iter(range(first, first + TASK_BLOCKS))
        known: dict[str, defaultdict[bytes, int]] = {}
        codes: list[np.ndarray] = []
        count, held = itertools.count(1), 0

        def block() -> pa.RecordBatch:
            words = sorted((code, lang, word) for lang, d in known.items() for word, code in d.items() if code)
            every = np.concatenate(codes)
            n = np.bincount(every, minlength=len(words) + 1)[1:]
            rows = pa.StructArray.from_arrays([pa.array([w[1] for w in words], pa.string()), pa.array([w[2].decode() for w in words], pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), pa.array([every.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), rows)], names=["block", "codes", "grams"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                lang = UNKNOWN if lang is None else lang
                for part in parts((text.as_py() or "").encode().lower()):  # bytes: only A-Z change
                    if lang not in known:
                        known[lang] = defaultdict(count.__next__, {STOP: 0})
                    words = part.translate(TABLE).replace(STOP, b" " + STOP + b" ").split()
                    codes += [np.fromiter(map(known[lang].__getitem__, words), dtype=np.int32, count=len(words)), np.zeros(1, dtype=np.int32)]
                    held += len(words)
                    if held >= block_words:
                        yield block()
                        known, codes, count, held = {}, [], itertools.count(1), 0
        if codes:
            yield block()

    return docs.select(F.col(lang_col).cast("string"), text_col).mapInArrow(cut, BLOCKS)


def named(blocks: DataFrame, keys: list[str], least: int) -> DataFrame:
    """block, code, id, keys, f, first: the grams of each block that occur ``least`` times in all, and their global ids.

    A gram has a row for each block that holds it, with its count there, so a group grows with the number of blocks and not
    of occurrences.  Its id is the place of its first row in block order, which is fixed since blocks are written.
    """
    rows = blocks.select("block", F.posexplode("grams").alias("_i", "_g")).select((F.shiftleft("block", 31) + F.col("_i") + 1).alias("_u"), "_g.*")
    w = Window.partitionBy(*keys)
    every = rows.withColumn("f", F.sum("n").over(w)).withColumn("id", F.min("_u").over(w)).where(F.col("f") >= least)
    block, code = F.shiftright("_u", 31), F.col("_u").bitwiseAND((1 << 31) - 1)
    return every.select(block.alias("block"), code.alias("code"), "id", *keys, "f", (F.col("_u") == F.col("id")).alias("first"))


def paired(blocks: DataFrame, names: DataFrame, last: bool) -> DataFrame:
    """Blocks of the pairs of adjacent named grams: where each starts, and the ids of its two parts with its count.

    With ``last`` nothing is named any more, and the places are left out.
    """

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"block": [], "codes": [], "grams": []}
        if left.num_rows and right.num_rows:
            codes = np.frombuffer(left.column("codes")[0].as_py(), dtype=np.int32)
            own, ids = right.column("code").to_numpy(), right.column("id").to_numpy()
            order = np.argsort(own)  # shuffled rows come in any order
            own, ids = own[order], ids[order]
            local = np.full(max(int(codes.max(initial=0)), int(own[-1])) + 1, -1, dtype=np.int64)
            local[own] = np.arange(len(own))
            x = local[codes]
            at = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0))
            pairs, place, n = np.unique(x[at] * len(own) + x[at + 1], return_inverse=True, return_counts=True)
            new = np.zeros(0 if last else len(codes), dtype=np.int32)
            if not last:
                new[at] = place + 1
            rows = pa.StructArray.from_arrays([pa.array(ids[pairs // len(own)]), pa.array(ids[pairs % len(own)]), pa.array(n, pa.int64())], names=["a", "b", "n"])
            out = {"block": left.column("block").combine_chunks(), "codes": [new.tobytes()], "grams": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)}
        fields = [("block", pa.int64()), ("codes", pa.binary()), ("grams", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])))]
        return pa.table(out, schema=pa.schema(fields))

    ids = names.select("block", "code", "id")
    return blocks.select("block", "codes").groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(pair, PAIRS)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly: in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), (wide(left) * wide(right)).cast("decimal(38,0)"))


def levels(docs: DataFrame, lang_col: str, text_col: str, least: int, most_words: int, block_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """n of each language, and for 1, 2, ... words the frequent phrases: id, lang, phrase, last (word), f, heads and tails (f of
    its first and of its last 1, 2, ... words), and for two words on a and b, the ids of the phrases without the last and
    without the first word."""
    zstd = {"compression": "zstd"}
    blocks = materialize(word_blocks(docs, lang_col, text_col, block_words), **zstd)
    totals = materialize(blocks.select(F.inline("grams")).groupBy("lang").agg(F.sum("n").alias("n")))
    names = materialize(named(blocks, ["lang", "word"], least), **zstd)
    words = names.where("first").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    found = [materialize(words.withColumn("heads", F.array("f")).withColumn("tails", F.array("f")))]
    for k in range(2, most_words + 1):
        longer = materialize(paired(blocks, names, k == most_words), **zstd)
        forget(blocks)
        forget(names)
        blocks = longer
        names = materialize(named(blocks, ["a", "b"], least), **zstd)
        head = found[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("_p"), F.col("heads").alias("_h"))
        tail = found[-1].select(F.col("id").alias("b"), "last", F.col("tails").alias("_t"))
        rows = names.where("first").select("id", "a", "b", "f").join(head, "a").join(tail, "b")
        grown = lambda c: F.concat(F.col(c), F.array("f"))
        found.append(materialize(rows.select("id", "lang", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", "f", grown("_h").alias("heads"), grown("_t").alias("tails"), "a", "b")))
    forget(blocks)
    forget(names)
    return totals, found


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most_words: int = MOST_WORDS, kept: int = KEPT, subsumed: int = SUBSUMED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language, the ``kept`` phrases of 2 to ``most_words`` words that hold
    together best.

    Words are lower-cased in A-Z and never cross a separator.  A phrase occurs ``a`` >= ``least`` times; each of its cuts in
    two has floor(1000000 a a / (l r)) with the counts of both parts; the lowest counts, of equal ones the first.  Phrases
    inside a longer one with ``subsumed`` percent of their occurrences go; order is by score, a (both descending) and phrase.
    A null language counts as ``und``; null and empty texts have no words; repeated rows count again; an empty table gives no
    rows.  Other columns aren't read.
    """
    totals, found = levels(docs, lang_col, text_col, least, most_words, block_words)
    out = None
    for k in range(2, most_words + 1):
        rows = found[k - 1]
        if k < most_words:
            over = found[k].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("_over")).groupBy("id").agg(F.max("_over").alias("_over"))
            rows = rows.join(over, "id", "left").where(F.col("_over").isNull() | (100 * F.col("_over") < subsumed * F.col("f")))
        cut = lambda j, k=k: F.struct(score(F.col("f"), F.get("heads", j - 1), F.get("tails", k - j - 1)).alias("score"), j.alias("j"), F.get("heads", j - 1).alias("l"), F.get("tails", k - j - 1).alias("r"))
        best = F.array_min(F.array(*[cut(F.lit(j)) for j in range(1, k)])).alias("_c")
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), best).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")
        out = rows if out is None else out.unionByName(rows)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = out.withColumn("rank", rank).where(F.col("rank") <= kept)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases: lang, rank, phrase, a, l, r, n, score."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, w, unnest(range(len(w))) + 1 AS i FROM w),
f1 AS (SELECT lang, w[i] AS x, count(*) AS f FROM u GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM u WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM u WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
o AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
c2 AS (SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
LEFT JOIN o ON o.lang = c.lang AND o.x = c.x AND o.y = c.y WHERE o.f IS NULL OR 100 * o.f < 50 * c.f),
k3 AS (SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.f AS a, l1.f AS l1, r1.f AS r1, (1000000::HUGEINT * c.f * c.f) // (l1.f::HUGEINT * r1.f) AS s1, l2.f AS l2, r2.f AS r2, (1000000::HUGEINT * c.f * c.f) // (l2.f::HUGEINT * r2.f) AS s2
FROM f3 c JOIN f1 l1 ON l1.lang = c.lang AND l1.x = c.x JOIN f2 r1 ON r1.lang = c.lang AND r1.x = c.y AND r1.y = c.z JOIN f2 l2 ON l2.lang = c.lang AND l2.x = c.x AND l2.y = c.y JOIN f1 r2 ON r2.lang = c.lang AND r2.x = c.z),
e AS (SELECT lang, phrase, a, l, r, score FROM c2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM k3),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT t.lang, rank, phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score FROM t JOIN n USING (lang) WHERE rank <= 2000"""
