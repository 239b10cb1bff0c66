"""Copies, rests and leftovers: what earlier rounds did wrong."""

import os

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import common, components, pages, quality, shards

from .test_operators import AWKWARD, prose


def slow_verdict(text):
    """zstd_ratio, bad_chunks and the verdict of the bands by plain loops."""
    data, size = text.encode(), lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    if not data:
        return 0.0, 0.0, False

    def inside(part):
        lo, hi = [(lo, hi) for at, lo, hi in quality.BANDS if at <= len(part)][-1]
        return lo <= size(part) / len(part) <= hi

    parts = [data[k : k + 4096] for k in range(0, len(data), 4096)] if len(data) > 4096 else []
    bad = sum(len(p) for p in parts if not inside(p)) / len(data)
    return size(data) / len(data), bad, inside(data) and bad <= 0.25


def test_bands_against_plain_loops(spark):
    whole = prose(3000, 1).encode()[:4096].decode(errors="ignore")
    odd = [whole + "z" * n for n in (1, 63, 64, 255, 256, 900, 1023, 1024, 1366, 2000)] + [whole + prose(100, 2), prose(2000, 3) * 3, "a" * 100, prose(6, 4)]
    rows = [t or "" for _, t in AWKWARD] + odd
    got = quality.quality(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")).collect()
    for r in got:
        ratio, bad, ok = slow_verdict(rows[r["doc_id"]])
        assert (r["zstd_ratio"], r["bad_chunks"], r["kept"]) == (pytest.approx(ratio), pytest.approx(bad), ok and not r["base_failed"])
    # a rest of 900 equal letters counts, though it is short
    at = {rows[r["doc_id"]]: r for r in got}
    assert at[whole + "z" * 900]["bad_chunks"] == pytest.approx(900 / (len(whole.encode()) + 900)) and at[whole + prose(100, 2)]["kept"]


def test_slots_of_a_row_repeated_without_end(spark):
    rows = spark.range(20_000).select(F.lit(3).alias("shard"), F.when(F.col("id") < 15_000, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"))
    got = shards.with_slots(rows, "shard", ["doc_id"], step=1000)
    assert sorted(r["slot"] for r in got.collect()) == list(range(20_000))
    # no task numbers more than a part of the copies
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 15_000


def test_components_leave_one_table(spark):
    at = os.path.dirname(common.shared_dir(spark)).removeprefix("file:")
    before = set(os.listdir(at))
    chain = spark.createDataFrame([(k, k) for k in range(300)] + [(k + 1, k) for k in range(300)], "node long, hub long")
    got = components.components(chain)
    assert {r["component"] for r in got.collect()} == {0} and len(set(os.listdir(at)) - before) == 1


def test_near_duplicates_with_a_map_column(spark):
    text = prose(80, 5)
    docs = spark.createDataFrame([(1, text, {"a": 2}, "x"), (1, text, {"a": 1}, "y"), (2, text, None, "z"), (3, prose(80, 6), {}, "w")], "doc_id long, text string, m map<string,int>, ab string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], str(r["m"])) for r in got) == [(1, "{'a': 1}"), (3, "{}")]


# ---------------------------------------------------------------- main text of pages


def paragraph(n, seed, words=40):
    return [prose(words, 100 * seed + k) for k in range(n)]


def html_of(blocks):
    return "".join(f"<p>{b}</p>" for b in blocks)


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("unit", ["div class=comment", "article class='comment-body'", "li"])
def test_comments_longer_than_the_article_go(inside, unit):
    article, said = paragraph(3, 1), paragraph(12, 2)
    tag = unit.split()[0]
    thread = "<section class='comments'>" + "".join(f"<{unit}><b>reader</b> <time>2024-01-0{k % 9 + 1}</time><p>{t}</p></{tag}>" for k, t in enumerate(said)) + "</section>"
    page = f"<body><nav><a href=a>Menu</a></nav><article><h1>Title of it</h1>{html_of(article)}{thread if inside else ''}</article>{'' if inside else thread}<footer>c</footer></body>"
    assert pages.extract(page) == "\n\n".join(["Title of it", *article])


def test_wrappers_named_as_boilerplate_stay():
    article = paragraph(4, 3)
    for name in ("main-sidebar-wrapper", "widget", "comments-page", "newsletter content"):
        page = f"<body><nav><a href=a>Menu</a></nav><div class='{name}'><h1>Title of it</h1>{html_of(article)}<div class='comment-list'><div><p>{prose(30, 9)}</p></div></div></div></body>"
        assert pages.extract(page) == "\n\n".join(["Title of it", *article])


def test_doubtful_names_keep_their_paragraphs():
    article = paragraph(3, 4)
    for name in ("share-of-voice", "search-engine-history", "social-policy", "comment-culture", "ad-hoc-networks"):
        page = f"<body><article>{html_of(article[:1])}<div class='{name}'>{html_of(article[1:2])}</div>{html_of(article[2:])}</article></body>"
        assert pages.extract(page) == "\n\n".join(article)
        links = "".join(f"<a href=x>{w}</a> " for w in prose(30, 5).split())
        for junk in (f"<p>{links}</p>", "<p>Like us!</p>"):
            page = f"<body><article>{html_of(article[:2])}<div class='{name}'>{junk}</div>{html_of(article[2:])}</article></body>"
            assert pages.extract(page) == "\n\n".join(article)
    for name in ("share-buttons", "search-box", "social", "comment-list", "related-posts"):
        page = f"<body><article>{html_of(article)}<div class='{name}'><p>{prose(30, 6)}</p></div></article></body>"
        assert pages.extract(page) == "\n\n".join(article)


def test_short_last_blocks_in_containers_stay():
    article = paragraph(4, 7)
    page = "<body>" + "".join(f"<div class=b>{html_of([t])}</div>" for t in article) + "<div class=b><p>Short closing words.</p></div></body>"
    assert pages.extract(page) == "\n\n".join([*article, "Short closing words."])
    page = f"<body><div><div>{html_of(article)}</div><div class=b><p>Short closing words.</p></div><div><p><a href=x>Read on.</a></p></div></div></body>"
    assert pages.extract(page) == "\n\n".join([*article, "Short closing words."])
