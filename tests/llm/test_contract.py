"""The registered queries and the pipeline over awkward tables: columns, types, rows, and each stage against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import language, leaks, queries

from .test_operators import AWKWARD, prose, signed, slow_components, slow_dedup, slow_fingerprint

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, leaks int, _component string, held_out string"

COLUMNS = {
    "op1_latent_leaks": "doc_id bigint, item_id bigint",
    "op2_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_tree_scoring": "page_id bigint, url string, text string, n_chars bigint",
    "op4_licence_digests": "doc_id bigint",
    "op5_chunk_dedup": "doc_id bigint, text string, removed_words bigint",
    "op6_hash_tree_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_language_spans": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_simhash_components": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_compression_bands": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_piece_codec": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_rotated_codes": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}
#: What their rows are is tested in test_words_and_vectors.
OTHER_ROWS = ("op11_", "op12_", "op13_")
VECTORS = [(1, [1.0, 0.5], 0), (1, [1.0, 0.5], 0), (2, [1.0, 0.51], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [1.0, 0.5], None), (None, [1.0, 0.5], 0), (7, [None, 1.0], 0)]

WORDS = {"aa": "the and with that which from have this".split(), "bb": "der und mit das nicht von haben dieser".split(), "ru": "это как что для него было".split()}


def said(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


ITEMS = [(k, prose(40, 7200 + k)) for k in range(4)] + [(9, None), (9, ""), (2, prose(40, 7202))]


def corpus():
    """Rows (doc_id, text, lang): clean texts, copies, near copies, shared passages, planted items, mixed and odd texts."""
    shared, base = prose(60, 7300), prose(400, 7301)
    rows = [(1000 + k, f"{said(lang, 25, k)} {prose(70, 7400 + k)}", lang) for k, lang in enumerate(["aa", "bb"] * 20)]
    rows += [(1100 + k, said("ru", 60, 50 + k), "ru") for k in range(8)]
    rows += [(1200 + k, base, "aa") for k in range(5)] + [(1210 + k, base.replace(" ", f" x{k} ", 1), None) for k in range(4)]
    rows += [(1300 + k, f"{prose(50, 7500 + k)} {shared} {prose(40, 7600 + k)}", "aa") for k in range(6)]
    rows += [(1400 + k, f"{prose(80, 7700 + k)} {ITEMS[k][1].upper()} {prose(60, 7800 + k)}", "bb") for k in range(4)]
    rows += [(1500 + k, f"{said('aa', 30, 90 + k)} {said('ru', 20 + k, 95 + k)} {said('bb', 25, 99 + k)}", None) for k in range(6)]
    rows += [(1000, prose(90, 7900), None), (1000, prose(90, 7901), None), (None, said("aa", 40, 3), "aa"), (None, base, None)]
    return rows + [(i, t, None) for i, t in AWKWARD]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Two folders of tables: awkward rows, and none."""
    out = []
    pages = [
        (1, "u", None), (2, None, ""), (3, "u", "<p>" + prose(60, 1) + "</p>"), (3, "u", "<p>" + prose(60, 1) + "</p>"), (None, "v", "<div"),
        (4, "w", "<body><nav>Menu</nav><article><p>" + prose(9000, 2) + "</p></article></body>"),
    ]
    for rows in (corpus(), []):
        d = str(tmp_path_factory.mktemp("tables"))
        some = bool(rows)
        docs = spark.createDataFrame([(i, t, lang, None, len(t or ""), "s", 1, "c", "h") for i, t, lang in rows], DOCUMENTS)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(pages if some else [], "page_id long, url string, html string").withColumn("text", F.lit("clash")).write.parquet(f"{d}/pages.parquet")
        spark.createDataFrame(ITEMS if some else [], "item_id long, text string").withColumn("doc_id", F.lit(5)).write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame(VECTORS if some else [], "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("clash")).write.parquet(f"{d}/embeddings.parquet")
        out.append(d)
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, folders, name):
    for d in folders:
        got = queries.QUERIES[name](spark, d)
        types = dict(got.dtypes)
        for column in COLUMNS[name].split(", "):
            key, kind = column.split()
            assert types[key] == kind
        rows = got.collect()
        if name.startswith(OTHER_ROWS):
            assert bool(rows) == (d == folders[0])
            continue
        source, key = ("pages", "page_id") if name.startswith("op3") else ("documents", "doc_id")
        inputs = spark.read.parquet(f"{d}/{source}.parquet").collect()
        if name.startswith("op1_"):
            assert {(r["doc_id"], r["item_id"]) for r in rows} == ({(1400 + k, k) for k in range(4)} if inputs else set())
            continue
        if name.startswith("op4"):  # rows equal in id and text make one row
            inputs = {(r["doc_id"], r["text"]): r for r in inputs}.values()
        assert Counter(r[key] for r in rows) == Counter(r[key] for r in inputs)
        if name.startswith("op6"):
            assert {r["law"] for r in rows} <= {"key"}
            slots = Counter()
            for r in rows:
                slots[r["shard"]] += 1
            assert {(r["shard"], r["slot"]) for r in rows} == {(s, i) for s, n in slots.items() for i in range(n)}
            assert all(r["grown_shard"] in (r["shard"], 8) and 0 <= r["shard"] < 8 for r in rows)
            want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in inputs)
            assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        if name.startswith("op7"):
            for r in rows:
                assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
                assert r["lang_pred"] in ("aa", "bb", "ru", "und") and 0 <= r["score"] <= 1


# language ID by plain loops over dictionaries


def slow_words(text):
    """Of each run of letters its first character, length, and hashed 2- and 3-grams."""
    out, word, lower = [], None, [c.lower() if len(c.lower()) == 1 else c for c in text]
    code = [ord(c) if c.isalpha() else 0 for c in lower]
    at = lambda i: code[i] if 0 <= i < len(code) else 0
    for i, x in enumerate(code):
        if not x:
            word = None
            continue
        if word is None:
            word = [text[i], 0, []]
            out.append(word)
        pair = at(i - 1) * 40503 + x * 2654435761
        word[1] += 1
        word[2] += [(pair % 2**32) >> 16, ((pair * 31 + at(i + 1) * 2246822519 + 7) % 2**32) >> 16]
    return out


def slow_script(c):
    return next((name for lo, hi, name in language.SCRIPTS if lo <= ord(c) <= hi), "Other")


def slow_model(rows):
    grams, scripts = {}, {}
    for i, t, lang in rows:
        if lang is None or t is None or zlib.crc32(str("" if i is None else i).encode()) % 4 == 2:
            continue
        grams.setdefault(lang, Counter()).update(g for w in slow_words(t) for g in w[2])
        lower = [c.lower() if len(c.lower()) == 1 else c for c in t]
        scripts.setdefault(lang, Counter()).update(slow_script(c) for c in lower if c.isalpha())
    used = {k: {s for s, n in x.items() if n >= 0.001 * sum(x.values())} for k, x in scripts.items()}
    every = set().union(*used.values())
    total = {k: sum(x.values()) + 0.5 * language.BUCKETS for k, x in grams.items()}
    score = lambda k, g: math.log((grams[k][g] + 0.5) / total[k])
    return sorted(grams), score, lambda k, s: s in used[k] or s not in every


def slow_language(text, model):
    languages, score, allowed = model
    rows = []
    for c, n, grams in slow_words(text or ""):
        s = [sum(score(k, g) for g in grams) / 2 for k in languages]
        rows.append((n, [x if allowed(k, slow_script(c)) else min(s) - 50 for k, x in zip(languages, s)]))
    if not rows:
        return "und", 0.0
    best = [(x, [k]) for k, x in enumerate(rows[0][1])]
    for _, s in rows[1:]:
        best = [max(((v - language.SWITCH_PENALTY * (p[-1] != k) + s[k], [*p, k]) for v, p in best), key=lambda x: x[0]) for k in range(len(s))]
    labels = max(best, key=lambda x: x[0])[1]
    letters = Counter()
    for (n, _), k in zip(rows, labels):
        letters[k] += n
    top = max(range(len(languages)), key=lambda k: (letters[k], -k))
    total = [sum(s[k] for (_, s), j in zip(rows, labels) if j == top) for k in range(len(languages))]
    posterior = 1 / sum(math.exp(min(700, x - total[top])) for x in total)
    return languages[top], letters[top] / sum(letters.values()) * posterior


def test_language_by_plain_loops(spark, folders):
    rows = corpus()
    model = slow_model(rows)
    got = {}
    for r in language.identify(spark.read.parquet(f"{folders[0]}/documents.parquet"), language.fit(spark.read.parquet(f"{folders[0]}/documents.parquet"))).collect():
        got[r["text"]] = (r["lang_pred"], r["score"])
    for _, t, _ in rows:
        if len(t or "") > 4000:
            continue  # the plain loops copy paths
        lang, score = slow_language(t, model)
        assert got[t][0] == lang and got[t][1] == pytest.approx(score, abs=1e-3), t


# the pipeline's stages, each on its own input


def slow_leaks(rows, items):
    df = Counter(t for _, x in rows for t in set(leaks.terms(x).tolist()))
    found = set()
    for i, t in rows:
        words = leaks.split_words(t)
        for w in items:
            w = leaks.split_words(w or "")
            weight = {x: float(n * np.log1p(len(rows) / (df[int(leaks.terms(x.decode())[0])] + 0.5))) ** 2 for x, n in Counter(w).items()}
            for a in range(0, max(1, len(words) - leaks.STRIDE), leaks.STRIDE) if w else ():
                near = words[max(0, a - len(w)) : min(a + leaks.WINDOW, len(words)) + len(w)]
                have = set(near)
                if sum(v for x, v in weight.items() if x in have) < leaks.COSINE**2 * sum(weight.values()):
                    continue
                share, answer = leaks.lcs(w, near) / len(w), sum(x in have for x in w[-5:]) / len(w[-5:])
                if share >= 0.7 or share >= 0.5 and answer >= 0.8:
                    found.add((i, t))
    return found


def hashed(t):
    return signed(xxhash.xxh64_intdigest(t.encode(), 42))


def test_pipeline_stages_by_plain_loops(spark, folders):
    d = folders[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    stages = dict(corpus_pipeline.STAGES)
    before = docs.collect()

    def step(name):
        nonlocal docs, before
        out = stages[name](spark, docs, d)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        after = out.collect()
        docs = spark.createDataFrame(after, DOCUMENTS)
        was, before = before, after
        return was, after

    was, now = step("language")
    model = slow_model(corpus())
    long = {r["text"] for r in was if len(r["text"] or "") > 4000}
    told = {t: slow_language(t, model) for t in {r["text"] for r in was} - long}
    sure = {t for t, (_, s) in told.items() if abs(s - corpus_pipeline.LEAST_LANGUAGE_SCORE) > 1e-3} | {t for t, (k, _) in told.items() if k == "und"}
    want = Counter((r["doc_id"], r["text"]) for r in was if r["text"] in sure and told[r["text"]][0] != "und" and told[r["text"]][1] >= 0.5)
    assert want == Counter({k: n for k, n in key(now).items() if k[1] in sure})

    was, now = step("near_duplicates")
    group = slow_components({f: f for f in {slow_fingerprint(r["text"]) for r in was}})
    least = {}
    for r in was:
        if r["doc_id"] is not None:
            c = group[slow_fingerprint(r["text"])]
            mine = (r["doc_id"], hashed(r["text"]))
            least[c] = min(mine, least.get(c, mine))
    want = {(r["doc_id"], r["text"]): 1 for r in was if (r["doc_id"], r["text"] and hashed(r["text"])) in least.values()}
    assert key(now) == Counter(want) + key([r for r in was if r["doc_id"] is None])
    assert len({r["doc_id"] for r in now} & set(range(1200, 1220))) == 1

    was, now = step("substrings")
    cut = slow_dedup([(r["doc_id"], r["text"]) for r in was])
    left = [(r["doc_id"], cut[r["doc_id"], r["text"]]) for r in was]
    assert key(now) == Counter((i, t) for (i, t), r in zip(left, was) if t == r["text"] or re.sub(r"[ \t\n\v\f\r]+", "", t))
    assert all(r["n_chars"] == len(r["text"]) for r in now) and sum(map(len, (r["text"] for r in now))) < sum(len(r["text"]) for r in was)

    was, now = step("decontamination")
    rows = [(r["doc_id"], r["text"]) for r in was]
    bad = slow_leaks(rows, [t for _, t in ITEMS])
    assert {i for i, _ in bad} == {1400, 1401, 1402, 1403} and key(now) == Counter(x for x in rows if x not in bad)

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in now:
        ids = sp.encode(r["text"])
        want[r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids))] += 1
    fields = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(tuple(r[k] for k in fields) for r in stages["pieces"](spark, docs, d).collect()) == want
    # the whole run is its stages one after the other
    assert Counter(tuple(r[k] for k in fields) for r in corpus_pipeline.run(spark, d).collect()) == want


def test_pipeline_without_rows(spark, folders):
    assert corpus_pipeline.run(spark, folders[1]).count() == 0
