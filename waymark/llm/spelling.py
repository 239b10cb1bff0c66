"""Operator 11: spelling variants by bands of letter-parity masks.

A word's mask has a bit for each letter: whether the word holds it an odd number of times.  One inserted or deleted
letter flips one bit, one replaced letter at most two, so of three bands of the mask at least one stays equal (two, if
the lengths differ).  Words meet where a band, and the length or the next length, are equal; the masks are compared
there, and what is left is verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, groups, in_blocks, materialize, small_batches, table

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run in so many loses a letter: what the query plants to be found again.
MISSPELT = 97
BANDS, BAND_BITS = 3, 10
#: Words of one cell that are searched, and that ask.
CELL_POINTS, CELL_QUERIES = 8192, 16384
#: Distinct words that a task holds before it sends its counts on.
HELD_WORDS = 200_000
#: Characters of a text that are cut into runs at once.
PART = 1 << 20
#: Code points compared at once when pairs are verified.
COMPARED = 1 << 20
#: Masks compared at once.
ROWS, COLUMNS = 64, 2048

RUN = re.compile("[A-Za-zÀ-ÿ]+")
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def runs(text: str) -> Iterator[list[str]]:
    """The letter runs of a text, part by part; no run is cut."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            m = BREAK.search(text, end)
            end = m.start() if m else len(text)
        yield RUN.findall(text, at, end)
        at = end


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None) -> DataFrame:
    """word, n of all letter runs of whole texts, A-Z in lower case.

    With ``one_in``, a run loses a letter in documents for which its checksum, begun with their id, is a multiple of that.

    A task sends the counts of its own words, so a word costs a row for each task and not for each place.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        known: dict[str, tuple[str, bytes]] = {}  # of runs: the word and its bytes
        out = lambda: pa.RecordBatch.from_pydict({"word": list(held.keys()), "n": list(held.values())})
        crc32 = zlib.crc32
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text, doc = text.as_py(), doc.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in runs(text):
                    for run, n in Counter(part).items():
                        got = known.get(run)
                        if got is None:
                            word = run.lower() if run.isascii() else run.translate(LOWER)
                            got = known[run] = word, word.encode()
                        word = got[0]
                        if one_in:
                            h = crc32(got[1], seed)
                            if not h % one_in:
                                k = h % len(word)
                                word = word[:k] + word[k + 1 :]
                        held[word] = held.get(word, 0) + n
                    if len(held) >= HELD_WORDS or len(known) >= HELD_WORDS:
                        yield out()
                        held.clear()
                        known.clear()
        if held:
            yield out()

    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def letter_bits(words: DataFrame) -> dict[str, int]:
    """The bit of each letter: the commonest letters are dealt to the bands in turn, so that the bands tell words apart
    equally well.  Letters beyond the mask share bits, which can only make masks more alike.  A row for each letter."""
    found = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().orderBy(F.desc("count"), "c").collect()
    turns = [*range(BANDS), *reversed(range(BANDS))]
    return {r["c"]: turns[i % len(turns)] * BAND_BITS + i // BANDS % BAND_BITS for i, r in enumerate(found)}


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length)


def digest(x: np.ndarray) -> np.ndarray:
    """A checksum of each row; equal rows have equal ones."""
    factors = np.array([pow(0x9E3779B1, i + 1, 1 << 32) for i in range(x.shape[1])], dtype=np.uint32)
    return (x * factors).sum(axis=1, dtype=np.uint32)


def replaced_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of equal length differ at exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b``, one longer, are rows of ``a`` with one letter put in: what is equal before and after covers ``a``."""
    n = a.shape[1]
    head, tail = a == b[:, :n], (a == b[:, 1:])[:, ::-1]
    before = np.where(head.all(axis=1), n, head.argmin(axis=1))
    after = np.where(tail.all(axis=1), n, tail.argmin(axis=1))
    return before + after >= n


def near_pairs(band: int, length: int, own: list[str], own_mask: np.ndarray, ask: list[str], ask_mask: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): own[i] and ask[j] are one edit apart and agree in this band and in none before it.

    ``same``: the lists are one and the same, and i < j.  Words that ask have the length of the others, or one more.
    """
    if not own or not ask:
        return
    longer = len(ask[0]) - length
    a, b = letters(own, length), letters(ask, length + longer)
    half = length // 2
    (front, back), (ask_front, ask_back) = ((digest(x[:, :half]), digest(x[:, x.shape[1] - (length - half) :])) for x in (a, b))
    lower = [((1 << BAND_BITS) - 1) << (BAND_BITS * k) for k in range(band)]
    step, most = max(1, COMPARED // (length + 1)), 1 if longer else 2
    for lo in range(0, len(own), ROWS):  # blocks that stay in a core's cache
        mine = own_mask[lo : lo + ROWS, None]
        for at in range(lo if same else 0, len(ask), COLUMNS):
            k, theirs = slice(at, at + COLUMNS), ask_mask[None, at : at + COLUMNS]
            ok = np.bitwise_count(mine ^ theirs) <= most
            # one edit leaves the first half or the rest as it is
            ok &= (front[lo : lo + ROWS, None] == ask_front[None, k]) | (back[lo : lo + ROWS, None] == ask_back[None, k])
            hit = np.flatnonzero(ok)
            i, j = hit // theirs.shape[1] + lo, hit % theirs.shape[1] + at
            if same:
                i, j = i[i < j], j[i < j]
            x = own_mask[i] ^ ask_mask[j]
            for bits in lower:
                i, j, x = (v[(x & bits) != 0] for v in (i, j, x))
            for k in range(0, len(i), step):
                p, q = i[k : k + step], j[k : k + step]
                hit = (inserted_one if longer else replaced_one)(a[p], b[q])
                yield p[hit], q[hit]


def searched(cell: pa.Table) -> dict[str, list] | None:
    """Of a cell's words, those with near ones there: id, near (how many), other (the commonest), other_n."""
    band, length = cell.column("band")[0].as_py(), cell.column("size")[0].as_py()
    if cell.num_rows < 2:
        return None
    word, home = cell.column("word").to_pylist(), cell.column("home").to_numpy()
    mask, n, node = (cell.column(c).to_numpy() for c in ("mask", "n", "id"))
    place = np.array([len(w) for w in word])
    order = sorted(range(len(word)), key=lambda i: (-n[i], word[i]))
    rank = np.empty(len(word), dtype=np.int64)
    rank[order] = np.arange(len(word))
    best = np.full(len(word), len(word))
    pairs: list[np.ndarray] = []  # a word has few near words: one edit of a word of this alphabet
    own = np.flatnonzero(home)
    among = own if cell.column("among")[0].as_py() else own[:0]
    for ask, same in ((among, True), (np.flatnonzero(~home & (place == length)), False), (np.flatnonzero(~home & (place > length)), False)):
        for i, j in near_pairs(band, length, [word[k] for k in own], mask[own], [word[k] for k in ask], mask[ask], same):
            if len(i):
                pairs += [own[i], ask[j]]
    if not pairs:
        return None
    p, q = np.concatenate(pairs[0::2]), np.concatenate(pairs[1::2])
    p, q = np.concatenate([p, q]), np.concatenate([q, p])
    near = np.bincount(p, minlength=len(word))
    np.minimum.at(best, p, rank[q])
    hit = np.flatnonzero(near)
    other = [order[best[k]] for k in hit]
    return {"id": node[hit], "near": near[hit], "other": [word[k] for k in other], "other_n": n[other]}


def near_words(words: DataFrame, points: int | None = None, queries: int | None = None) -> DataFrame:
    """``words`` (id, word, n; distinct): id, n_near, other, other_n of those with words one edit away; of these the commonest
    (ties: the smallest) is ``other``."""
    bits = letter_bits(words)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for w in batch.column(1).to_pylist():
                m = 0
                for c in w:
                    m ^= 1 << bits[c]
                masks.append(m)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks, pa.int32())], names=[*batch.schema.names, "mask"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, 4):
            found = searched(cell)
            if found:
                yield pa.RecordBatch.from_pydict(found)

    marked = words.select("id", "word", "n").mapInArrow(mark, "id long, word string, n long, mask int").withColumn("size", F.length("word"))
    band = F.posexplode(F.array(*[F.shiftright("mask", BAND_BITS * k).bitwiseAND((1 << BAND_BITS) - 1).cast("int") for k in range(BANDS)])).alias("band", "value")
    banded = marked.select("id", "word", "n", "mask", "size", band)
    # a letter put in flips one bit: such a pair agrees in band 0 or in band 1
    role = F.when(F.col("band") < BANDS - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = banded.select("band", "value", F.explode(role).alias("_less"), "id", "word", "n", "mask", "size")
    rows = rows.withColumn("size", F.col("size") - F.col("_less")).withColumn("home", F.col("_less") == 0).drop("_less")
    cells = in_blocks(rows, ["band", "value", "size"], "id", points or CELL_POINTS, queries or CELL_QUERIES)
    keys = ["band", "value", "size", "cell"]
    dealt = cells.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "home", "among", "id", "word", "n", "mask")
    found = dealt.mapInArrow(search, "id long, near long, other string, other_n long")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other"))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("_b")).select("id", "n_near", F.col("_b.other").alias("other"), (-F.col("_b.m")).alias("other_n"))


def roots(links: DataFrame) -> DataFrame:
    """``links`` (word, form): word, root, the last word of each chain of forms.

    A round doubles the length of every jump, so a chain of n words takes log n rounds; each is written, so no plan grows.
    """
    jumps = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(jumps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = longer.where("moved").limit(1).count()
        forget(jumps)
        jumps = longer.drop("moved")
        jumps.waymark_path = longer.waymark_path
        if not moved:
            return jumps


def variants(counts: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = 2) -> DataFrame:
    """``counts`` (word, n): word, form, root, n, n_near, form_n of the words with so many letters and occurrences.

    ``n_near`` counts the words exactly one inserted, deleted or replaced code point away; ``form`` is the commonest of
    them (ties: the smallest in code-point order) if it is at least ``ratio`` times as common, else null as ``form_n``;
    ``root`` is the last word of the chain of forms.  Null words are ignored; counts of a repeated word are summed.  An empty
    table gives no rows.  Words are letters of the basic plane.
    """
    words = counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.where((F.length("word") >= least_letters) & (F.col("n") >= least_count))
    words = materialize(words.withColumn("id", F.monotonically_increasing_id()))  # written, so ids stay
    found = near_words(words)
    ok = F.col("other_n") >= ratio * F.col("n")
    linked = words.join(found, "id", "left").select("word", F.when(ok, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("other_n")).alias("form_n"))
    linked = materialize(linked)
    forget(words)
    last = roots(linked.where("form is not null"))
    return linked.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None, **options) -> DataFrame:
    """``variants`` of the words of whole texts.

    A null or empty text has no words; a null id counts as an empty one where ``one_in`` misspells words by document.
    Repeated rows count again; other columns aren't read.
    """
    return variants(word_counts(docs, id_col, text_col, one_in), **options)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    return spelling_variants(table(spark, sf_dir, "documents"), one_in=MISSPELT)


#: The checksum is that of zlib, by its table; two words of one length are near if they share a deletion at one place, and a
#: word is near to each of its deletions.
SQL = """WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM l, tab),
k AS (SELECT w, n, h, h % length(w) AS k FROM h),
c AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, k) || substr(w, k + 2) ELSE w END AS w, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1),
v AS (SELECT w, n FROM c WHERE length(w) >= 5 AND n >= 3),
d AS (SELECT w, n, i, left(w, i) || substr(w, i + 2) AS s FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
e AS (SELECT a.w, b.w AS o FROM d a JOIN d b ON a.i = b.i AND a.s = b.s AND a.w <> b.w UNION SELECT d.w, v.w FROM d JOIN v ON d.s = v.w UNION SELECT v.w, d.w FROM d JOIN v ON d.s = v.w),
g AS (SELECT e.w, count(*) AS n_near, min(struct_pack(m := -v.n, o := e.o)) AS b FROM e JOIN v ON v.w = e.o GROUP BY e.w),
f AS (SELECT v.w AS word, CASE WHEN -b.m >= 2 * n THEN b.o END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * n THEN -b.m END AS form_n FROM v LEFT JOIN g USING (w)),
p AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT p.word, f.form FROM p JOIN f ON p.at = f.word WHERE f.form IS NOT NULL),
z AS (SELECT p.word, p.at AS root FROM p JOIN f ON f.word = p.at WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(z.root, f.word) AS root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f LEFT JOIN z USING (word)"""
