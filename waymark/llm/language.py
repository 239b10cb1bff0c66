"""Operator 7: language of every document.

The Unicode script of a word narrows its candidate languages; character n-grams score the word under each of
them; a Viterbi pass with a penalty for changing language labels the words, so that mixed texts fall into spans.
The document gets the language whose spans hold most letters.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, small_batches, sum_packed, table, texts

UNKNOWN = "und"
#: Buckets of hashed character 2- and 3-grams.
BUCKETS = 1 << 16
#: Letters whose n-grams are counted together in the fit.
HELD_LETTERS = 1 << 20
#: Log-likelihood that a change of language between two words must gain.
SWITCH_PENALTY = 12.0

#: First and last code points of scripts (Unicode blocks).
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"),
    (0x08A0, 0x08FF, "Arabic"), (0xFB50, 0xFDFF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0x20000, 0x2FA1F, "Han"),
]

NAMES = ["Other", *dict.fromkeys(name for _, _, name in SCRIPTS)]


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, whether it is a letter, and its script's index in NAMES."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    script = np.zeros(0x110000, dtype=np.uint8)
    for lo, hi, name in SCRIPTS:
        script[lo : hi + 1] = NAMES.index(name)
    return letter, script


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each letter the buckets of its 2- and 3-gram, and the first letters and ends of the words.

    A word is a run of letters; what is around it counts as one mark in the n-grams.  Returns (pairs, triples,
    starts, ends): starts index the letters, ends the text.
    """
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join([c if len(c.lower()) != 1 else c.lower() for c in text])  # so that positions hold
    code = np.frombuffer(lower.encode("utf-32-le"), dtype=np.uint32)
    letter, _ = tables()
    x = np.zeros(len(code) + 2, dtype=np.uint32)
    x[1:-1] = np.where(letter[code], code, 0)
    at = np.flatnonzero(x)
    here, before, after = x[at], x[at - 1], x[at + 1]
    pairs = before * np.uint32(40503) + here * np.uint32(2654435761)
    triples = pairs * np.uint32(31) + after * np.uint32(2246822519) + np.uint32(7)
    shift = np.uint32(16)
    return pairs >> shift, triples >> shift, np.flatnonzero(before == 0), at[after == 0]


@dataclass
class Model:
    """Per language: log-probabilities of the buckets, and the scripts its words use."""

    languages: list[str]
    weight: np.ndarray  # (BUCKETS, languages)
    allowed: np.ndarray  # (scripts, languages)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the words under each language, and their starts and ends in the text."""
        pairs, triples, starts, ends = features(text)
        if not len(starts) or not self.languages:
            return np.zeros((0, len(self.languages))), ends, ends
        # the n-grams of a word overlap: their sum is scaled to one vote for each letter
        s = np.add.reduceat(self.weight[pairs] + self.weight[triples], starts, axis=0) / 2
        letters = np.diff(np.append(starts, len(pairs)))
        first = ends - letters
        script = tables()[1][np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)[first]]
        allowed = self.allowed[script]
        return np.where(allowed, s, s.min(axis=1, keepdims=True) - 50), first, ends


def labelled(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The rows a model may learn from: a label, and crc32 of the id's text not 2 modulo 4."""
    return docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) != 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all labelled documents (see ``labelled``), whole texts.

    The tasks count hashed n-grams; one array for each language reaches the driver.  Rows without a label or a text
    are left out.  With no labelled row the model has no language and predicts ``und``.
    """
    small_batches(docs.sparkSession)
    rows = labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    width = len(languages)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.ones((len(NAMES), 0), dtype=bool))
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, np.ndarray] = {}
        letter, script = tables()
        some: dict[int, list] = {}
        held = 0

        def add() -> None:
            for i, parts in some.items():
                pairs, triples, scripts = map(np.concatenate, zip(*parts))
                own = by.setdefault(i, np.zeros(BUCKETS + len(NAMES), dtype=np.int64))
                own[:BUCKETS] += np.bincount(pairs, minlength=BUCKETS) + np.bincount(triples, minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(scripts, minlength=len(NAMES))
            some.clear()

        for batch in batches:
            for t, lang in zip(texts(batch), batch.column(batch.schema.get_field_index("lang")).to_pylist()):
                code = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
                some.setdefault(index[lang], []).append((*features(t)[:2], script[code[letter[code]]]))
                held += len(t)
                if held > HELD_LETTERS:
                    add()
                    held = 0
        add()
        for i, own in by.items():
            yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int32()), "data": pa.array([own.tobytes()], pa.binary())})

    got = sum_packed(rows.select("text", "lang").mapInArrow(count, "at int, data binary"))
    counts = np.stack([got.get(i, np.zeros(BUCKETS + len(NAMES), dtype=np.int64)) for i in range(width)], axis=1).astype(np.float64)
    grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    allowed = scripts >= 0.001 * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script that no language uses rules none out
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed)


def viterbi(s: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The labels of greatest total score, a change costing ``penalty``; ties go to the first language.

    A constant labelling is best if no other language leads it by more than half the penalty over any stretch
    of words (each stretch of another language costs at least half a change); most texts end there.
    """
    n, k = s.shape
    best = int(s.sum(axis=0).argmax())
    lead = np.vstack([np.zeros((1, k)), np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)])
    if (lead - np.minimum.accumulate(lead, axis=0)).max() <= penalty / 2:
        return np.full(n, best)
    # few languages: plain numbers are quicker than arrays
    own = list(range(k))
    back, v = [own], s[0].astype(np.float64).tolist()
    for row in s[1:].astype(np.float64).tolist():
        most = max(v)
        least = most - penalty
        if min(v) < least:
            j = v.index(most)
            back.append([j if x < least else i for i, x in enumerate(v)])
            v = [(least if x < least else x) + y for x, y in zip(v, row)]
        else:
            back.append(own)
            v = [x + y for x, y in zip(v, row)]
    out = np.empty(n, dtype=np.int64)
    j = v.index(max(v))
    for t in range(n - 1, -1, -1):
        out[t] = j
        j = back[t][j]
    return out


def spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(first, end, language) stretches of a mixed text, in code points, over its words."""
    s, starts, ends = model.words(text)
    if not len(s):
        return []
    labels = viterbi(s)
    cut = np.flatnonzero(np.diff(labels)) + 1
    first, last = np.concatenate([[0], cut]), np.append(cut, len(labels)) - 1
    return [(int(starts[a]), int(ends[b]), model.languages[labels[a]]) for a, b in zip(first, last)]


def predict(text: str | None, model: Model) -> tuple[str, float]:
    """Language and score: the letters' share of the winning language's spans, times its posterior over them."""
    s, starts, ends = model.words(text) if text else (np.zeros((0, 0)), None, None)
    if not len(s):
        return UNKNOWN, 0.0
    labels = viterbi(s)
    size = (ends - starts).astype(np.float64)
    share = np.bincount(labels, weights=size, minlength=len(model.languages)) / size.sum()
    best = int(share.argmax())
    total = s[labels == best].sum(axis=0, dtype=np.float64)
    posterior = 1.0 / float(np.exp(np.minimum(total - total[best], 700)).sum())
    return model.languages[best], max(0.0, min(1.0, float(share[best]) * posterior))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``.

    Null, empty and letterless texts get ``und`` and 0; whole texts are read; of equally good languages the first by name
    is taken; repeated rows stay; an empty table gives no rows; columns named as the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        tables()

        def f(batch: pa.RecordBatch) -> dict[str, list]:
            got = [predict(t, m) for t in texts(batch, text_col)]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return f

    return add_columns(docs, make, "lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``spans``: the stretches of one language (start, end in code points, lang) of each text, empty for one without a
    letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: {"spans": [[{"start": a, "end": z, "lang": k} for a, z, k in spans(t, shared.value)] for t in texts(batch, text_col)]}

    return add_columns(docs, make, "spans array<struct<start: long, end: long, lang: string>>")


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    out = identify(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
