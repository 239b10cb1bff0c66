"""Operator 9: quality rules from zstandard compression bands.

A text's compressed size over its size says how repetitive it is.  The whole text and each fixed chunk must lie
in a band that depends on the length, since short texts always compress worse.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, table, texts

LEVEL = 3
CHUNK = 4096
#: Share of a text's bytes that may lie in chunks outside their band.
MAX_BAD_CHUNKS = 0.25
#: (bytes from, least ratio, greatest ratio).  Prose of one to a few thousand bytes compresses to 0.4 - 0.6.
BANDS = [
    (0, 0.0, 10.0),
    (64, 0.40, 1.30),
    (256, 0.40, 0.95),
    (1024, 0.34, 0.80),
    (4096, 0.30, 0.75),
    (16384, 0.25, 0.72),
    (65536, 0.20, 0.70),
]
SYMBOLS = "#*$%&|<>"

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, bad_chunks double, base_failed boolean, kept boolean"


def band(n_bytes: int) -> tuple[float, float]:
    return next((lo, hi) for at, lo, hi in reversed(BANDS) if n_bytes >= at)


def base(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words are runs of other than ASCII white space."""
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.split()] if b"\n" in data else ()
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n >= 4:
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        a = np.fromiter((ids[w] for w in words), dtype=np.int64, count=n)
        pairs = a[:-1] * len(ids) + a[1:]
        # two steps, so that a code stays below 2^63 for any text
        _, pairs = np.unique(pairs, return_inverse=True)
        windows = pairs[:-1] * len(ids) + a[2:]
        _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        if again.any():
            hit = np.zeros(n, dtype=bool)
            for k in range(3):
                hit[k : n - 2 + k] |= again
            repeat = int(hit.sum())
    return n, chars, symbols, dup_lines, repeat


def judge(data: bytes, size_of: Callable[[bytes], int]) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks out of band, and whether both rules hold."""
    if not data:
        return 0.0, 0.0, False
    n = len(data)
    ratio = size_of(data) / n
    lo, hi = band(n)
    ok, bad = lo <= ratio <= hi, 0
    if n > CHUNK:
        for at in range(0, n, CHUNK):
            part = data[at : at + CHUNK]
            a, b = band(len(part))
            bad += 0 if a <= size_of(part) / len(part) <= b else len(part)
    share = bad / n
    return ratio, share, ok and share <= MAX_BAD_CHUNKS


def quality(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the base counts, the ratios and the verdict ``kept``.

    A null or empty text has counts of 0, fails the base rules and isn't kept.  Whole texts are read, one at a
    time; a rest behind the last whole chunk is judged by the band of its own length and counts by its bytes.  Repeated rows
    stay; an empty table gives no rows; columns named as the added ones are replaced.
    """

    def make():
        import zstandard

        z = zstandard.ZstdCompressor(level=LEVEL)

        def f(batch: pa.RecordBatch) -> dict[str, list]:
            rows = []
            for t in texts(batch, text_col):
                data = t.encode()
                n, chars, symbols, dup, repeat = base(t, data)
                failed = n < 50 or 100 * repeat > 50 * n
                ratio, bad, ok = judge(data, lambda x: len(z.compress(x)))
                rows.append((n, chars, symbols, dup, repeat, ratio, bad, failed, ok and not failed))
            return dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "zstd_ratio", "bad_chunks", "base_failed", "kept"), map(list, zip(*rows)))) if rows else {k.split()[0]: [] for k in COLUMNS.split(", ")}

        return f

    return add_columns(docs, make, COLUMNS, keep)


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, the base counts, ratios and verdicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).drop("text")
