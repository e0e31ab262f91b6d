"""Whole scores against plain versions, and the cases that each operator defines: shared and null keys, clashing columns, long texts."""

import math
import random
import re
import subprocess
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ROOT, SF
from pyspark.sql import functions as F

import corpus_pipeline
from contactspark.llm import bpe, chat, common, hamming, langid, packing, quality, queries, secrets, simhash, suffix, toxicity

CLASHES = ["score", "lang_pred", "ids", "fp", "node", "component_id", "row", "decoded", "n_words", "m", "kept", "evidence", "predicted", "label", "t", "n", "sequence_id", "start", "q", "best", "runs", "found", "salt", "usable", "held"]


def clashing(df):
    """df with columns that are called as the operators' own ones are."""
    return df.withColumns({c: F.lit(f"clash-{c}") for c in CLASHES if c not in df.columns})


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty texts, ties, repeated rows, shared and null keys, and clashing columns."""
    rng = random.Random(12)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (1, b, None, None, None), (1, b, None, None, None), (None, a, "fr", None, None), (None, c, None, "s", None), (None, None, None, None, None), (2, None, "en", None, None), (3, "", None, None, 0), (4, " \n", "en", None, 2), (5, "the the", "de", None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


# --- op1


def plain_bucket(gram):
    """The bucket of one n-gram of code points, step by step in whole numbers."""
    m = (1 << 64) - 1
    h = gram[0] * 0x9E3779B97F4A7C15 & m
    for x in gram[1:]:
        h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 + x) & m
    return ((h + len(gram)) * 0x94D049BB133111EB & m) >> 64 - langid.BUCKET_BITS


def plain_grams(text):
    letters = re.sub(" +", " ", "".join(x if x.isalpha() else " " for x in text.lower())).lstrip(" ")
    codes = [ord(x) for x in letters]
    return Counter(plain_bucket(codes[i : i + n]) for n in langid.ORDERS for i in range(len(codes) - n + 1))


def test_scores_are_those_of_plain_naive_bayes(spark):
    rng = random.Random(5)
    kinds = {"aa": "abcde", "bb": "cdefé", "und": "fghiß"}
    train = [(i, words(rng, 20, letters), lang) for i, (lang, letters) in enumerate(list(kinds.items()) * 8)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == sorted(kinds)
    counts = defaultdict(Counter)
    for _, t, lang in train:
        counts[lang].update(plain_grams(t))
    size = 1 << langid.BUCKET_BITS
    test = [words(rng, 3, rng.choice([*kinds.values()])) + ". 12 Σ" for _ in range(30)] + ["é"]
    for t, got in zip(test, model.score(test), strict=True):
        logs = {x: sum(n * math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * size)) for g, n in plain_grams(t).items()) for x, c in counts.items()}
        want = np.exp(np.array([logs[x] for x in model.languages]) - max(logs.values()))
        assert np.allclose(got, want / want.sum(), atol=1e-4)


def test_long_texts_go_in_pieces(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abc dé. Σ\n") for _ in range(5000)) + "x" * 700
    whole = np.bincount(langid.grams([text])[0], minlength=1 << langid.BUCKET_BITS)
    monkeypatch.setattr(langid, "PIECE", 97)
    assert (langid.counts_of(text) == whole).all()


def test_no_language_is_lost(spark):
    """Two thousand copies of one row are one row of a language that stays, whatever its hash, and do not fill the sample."""
    for i in range(1, 7):
        rows = [(i, "waka ni ce", "hw")] * 2000 + [(100 + k, f"the word number {k}", "en") for k in range(50)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
        assert langid.fit(df, F.lit(True)).languages == ["en", "hw"]


@pytest.mark.parametrize("rows", [1, 7, 100])
def test_sample_takes_the_smallest_hashes(spark, rows):
    data = [(g, k, "t") for g, n in (("a", 3), ("b", 900), ("c", 12000)) for k in range(n)] + [("a", 1, "t")] * 500 + [(None, 1, "x")]
    df = spark.createDataFrame(data, "g string, k long, t string").repartition(6)
    hashed = df.where("g is not null").select("g", "k", F.shiftrightunsigned(F.xxhash64("k"), 11).alias("h")).distinct().collect()
    want = {(g, k) for x in "abc" for _, g, k in sorted((r["h"], r["g"], r["k"]) for r in hashed if r["g"] == x)[:rows]}
    got = common.distinct_sample(df, "g", ["k"], rows)
    assert got.columns == df.columns and sorted((r["g"], r["k"]) for r in got.collect()) == sorted(want)


def test_too_many_languages_are_an_error(spark, odd):
    with pytest.raises(ValueError):
        langid.fit(odd, F.lit(True), most_languages=2)
    assert langid.fit(odd, F.lit(True)).languages == ["de", "en", "fr"]


# --- op10


def plain_tells(a, b, n1, n0):
    """The squared share of the full ratio that a term's table of counts has."""
    n = n1 + n0
    cells = ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n - a - b), (n0 - b, n0, n - a - b))
    return min(1, max(0, 2 * sum(x * math.log(x * n / (size * of)) for x, size, of in cells if x) / toxicity.FULL_RATIO)) ** 2


def test_whole_score_is_brute_force(spark):
    """Frequencies, dense TF-IDF vectors over all terms of all texts, cosines, votes, calibration and scores, all worked out in plain Python."""
    rng = random.Random(7)
    pool = [words(rng, 1) for _ in range(60)]
    text = lambda bad: " ".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) + (", " + rng.choice(["vile", "foul"]).upper() + "!" if bad else "")
    texts = {i: text(i % 3 == 0 and rng.random() < 0.9) for i in range(90)} | {200: "zzz qqq", 201: "", 202: None}
    texts |= {300 + i: f"{pool[i]} " + " ".join(words(rng, 1) + str(i) + "." for _ in range(40)) for i in range(9)}  # nearly all of it is in no example
    labels = {i: int(i % 3 == 0) for i in range(60)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame([*labels.items()], "doc_id long, toxic int"), F.lit(True))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}

    bags = {i: Counter(re.findall("[a-z]+", (t or "").lower())) for i, t in texts.items()}
    terms = sorted({w for bag in bags.values() for w in bag})
    df = np.array([sum(w in bag for bag in bags.values()) for w in terms])
    tf = np.array([[1 + math.log(bags[i][w]) if w in bags[i] else 0 for w in terms] for i in bags])
    whole = tf * (np.log((1 + len(bags)) / (1 + df)) + 1e-3)
    whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
    row = {i: k for k, i in enumerate(bags)}
    cosine = whole @ whole.T
    assert max(cosine[row[300 + i], row[j]] for i in range(9) for j in labels) < 0.25
    n1 = sum(labels.values())
    n0 = len(labels) - n1
    counts = [[sum(w in bags[j] for j in labels if labels[j] == y) for w in terms] for y in (0, 1)]

    def near(i, out=None):
        sims = [(-round(cosine[row[i], row[j]], 9), j) for j in labels if j != out]
        return [j for s, j in sorted(sims) if s < 0][: toxicity.NEIGHBOURS]

    def vote(i, out=None):
        y = labels.get(out)
        less1, less0 = int(y == 1), int(y == 0)
        own = lambda w: w in bags[i] if out is not None else False
        tells = np.array([plain_tells(counts[1][k] - less1 * own(w), counts[0][k] - less0 * own(w), n1 - less1, n0 - less0) if w in bags[i] and counts[0][k] + counts[1][k] else 0 for k, w in enumerate(terms)])
        found = near(i, out)
        weight = {j: float((whole[row[i]] * whole[row[j]] * tells).sum()) + toxicity.LEAST_PART * cosine[row[i], row[j]] for j in found}
        share = n1 / len(labels)
        return (sum(weight[j] * labels[j] for j in found) + toxicity.PRIOR * share) / (sum(weight.values()) + toxicity.PRIOR) if found else None

    own = [(vote(i, i), labels[i]) for i in labels]
    points = sorted((v, y) for v, y in own if v is not None)
    share = n1 / len(labels)
    weigh = {1: share / n1, 0: (1 - share) / n0}
    xs = sorted({x for x, _ in points})
    fitted = {}  # the fit that never falls, by its greatest lower and least upper means
    for x in xs:
        mean = lambda lo, hi: sum(weigh[y] * y for v, y in points if lo <= v <= hi) / sum(weigh[y] for v, y in points if lo <= v <= hi)
        fitted[x] = max(min(mean(lo, hi) for hi in xs if hi >= x) for lo in xs if lo <= x)
    for i in bags:
        found = near(i)
        assert [e["doc_id"] for e in got[i]["evidence"]] == found[:3]
        assert [e["similarity"] for e in got[i]["evidence"]] == pytest.approx([cosine[row[i], row[j]] for j in found[:3]])
        v = vote(i)
        if v is not None:  # between two votes of examples by line, if the fit has a step there
            lower, upper = max((x for x in xs if x <= v - 1e-6), default=xs[0]), min((x for x in xs if x >= v + 1e-6), default=xs[-1])
            assert fitted[lower] - 1e-9 <= got[i]["score"] <= fitted[upper] + 1e-9
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5)
    assert len({got[i]["score"] for i in (200, 201, 202)}) == 1 and got[200]["evidence"] == []


def test_faint_similarity_decides_nothing(spark):
    """One known word among sixty unseen ones is next to no evidence."""
    rng = random.Random(11)
    texts = {i: f"vile {words(rng, 3)}" if i % 2 else words(rng, 4) for i in range(40)} | {99: "vile " + " ".join(words(rng, 1) + "q" * i for i in range(60))}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"), F.lit(True))
    got = {r["doc_id"]: r["evidence"] for r in toxicity.score_documents(docs, model).collect()}
    assert got[99][0]["similarity"] < 0.05 < got[1][0]["similarity"]


def test_examples_of_shared_keys_are_one_and_the_same(spark):
    docs = spark.createDataFrame([(1, "b words"), (1, "a words"), (2, "c words"), (None, "d words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    for parts in (1, 3):
        assert toxicity.fit(docs.repartition(parts), labels, F.lit(True)).vocabulary == ["a", "c", "words"]


# --- op6


def test_search_with_shared_and_null_keys(spark):
    rng = random.Random(8)
    big = 1 << 60
    rows = [(big + i, rng.getrandbits(64)) for i in range(40)] + [(7, 5), (7, 5), (None, 4), (None, 4), (8, None), (9, 1 << 63)]
    signed = [(k, None if c is None else c - (1 << 64) if c >> 63 else c) for k, c in rows]
    df = spark.createDataFrame(signed, "vec_id long, code long").repartition(3)
    asked = df.where("vec_id is null or vec_id = 7 or vec_id % 3 = 0")
    lists = defaultdict(list)
    for r in hamming.top_k(df, asked, 6).collect():
        lists[r["query_id"]].append((r["rank"], r["distance"], r["neighbour_id"]))
    for key, code in {(k, c) for k, c in rows if c is not None and (k is None or k == 7 or k % 3 == 0)}:
        copies = rows.count((key, code))
        want = sorted(((code ^ c).bit_count(), k is None, k or 0) for k, c in rows if c is not None)[:6]
        want = [(i + 1, d, None if lacks else k) for i, (d, lacks, k) in enumerate(want)]
        assert sorted(lists[key], key=str) == sorted(want * copies, key=str)
    assert len(lists) == len({k for k, c in rows if c is not None and (k is None or k == 7 or k % 3 == 0)})


def test_codes_of_long_vectors_are_an_error(spark):
    df = spark.createDataFrame([([0.5] * 65,)], "v array<double>")
    with pytest.raises(Exception, match="over 64 components"):
        df.select(hamming.sign_code(F.col("v"))).collect()


def test_search_grows_wider_when_codes_are_few(spark):
    df = spark.createDataFrame([(1, 0), (2, -1), (3, 255)], "vec_id long, code long")
    got = sorted((r["query_id"], r["rank"], r["neighbour_id"], r["distance"]) for r in hamming.top_k(df, df.where("vec_id = 1"), 10).collect())
    assert got == [(1, 1, 1, 0), (1, 2, 3, 8), (1, 3, 2, 64)]


# --- op7


def brute_rows(texts, span=100):
    """What is left of documents in order, each one a row of its own."""
    seen, out = {}, []
    for i, text in enumerate(texts):
        b, gone = (text or "").encode(), set()
        for p in range(len(b) - span + 1):
            if seen.setdefault(b[p : p + span], (i, p)) != (i, p):
                gone.update(range(p, p + span))
        out.append(bytes(x for p, x in enumerate(b) if p not in gone))
    return out


def test_unrelated_texts_of_one_key_keep_all(spark):
    rng = random.Random(9)
    a, b = words(rng, 60), words(rng, 60)
    for rows in ([(1, a), (None, a), (None, b)], [(1, a), (7, a), (7, b)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        kept = sorted(bytes(r["kept"]) for r in suffix.remove_repeats(df.repartition(2)).collect())
        assert kept == sorted([a.encode(), b"", b.encode()])


@pytest.mark.parametrize("piece", [150, 1000])
def test_long_texts_overlap_in_pieces(spark, monkeypatch, piece):
    rng = random.Random(10)
    part = words(rng, 50)
    texts = [words(rng, 400) + part + words(rng, 30) + part, part * 3, "ab" * 900, words(rng, 5) + "ab" * 200]
    whole = [suffix.find_anchors([t.encode()]) for t in texts]
    monkeypatch.setattr(suffix, "PIECE", piece)
    for t, w in zip(texts, whole, strict=True):
        starts = set()
        for numbers, offsets, group in suffix.pieces([t.encode()]):
            h, _, d, lo, hi = suffix.find_anchors(group)
            starts |= {(p + offsets[k], x) for x, k, a, z in zip(h.tolist(), d.tolist(), lo.tolist(), hi.tolist(), strict=True) for p in range(a, z + 1)}
            assert set(numbers) == {0}
        assert starts == {(p, x) for x, a, z in zip(w[0].tolist(), w[3].tolist(), w[4].tolist(), strict=True) for p in range(a, z + 1)}  # anchors depend on nothing but the string
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [bytes(r["kept"]) for r in suffix.remove_repeats(df).orderBy("doc_id").collect()] == brute_rows(texts)


@pytest.mark.parametrize("widespread", [1, 2, 10**9])
def test_buckets_dealt_out_by_class(spark, monkeypatch, widespread):
    """A line amid different text in all documents, with buckets that some tasks deal out and others do not."""
    monkeypatch.setattr(suffix, "WIDESPREAD", widespread)
    monkeypatch.setattr(suffix, "GATHER", 120)
    monkeypatch.setattr(suffix, "CROWDED", 6)
    monkeypatch.setattr(suffix, "REMEMBERED", 30)
    rng = random.Random(11)
    line = "a line that many documents of this table have amid other text of their own"
    texts = [words(rng, 12) + line * (1 + i % 2) + words(rng, 12) for i in range(25)] + [line * 2]
    texts += texts[:4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert [bytes(r["kept"]) for r in suffix.remove_repeats(df).orderBy("doc_id").collect()] == brute_rows(texts)


# --- op3, op8, op9 and what they share


def test_grid_points_hold_all_steps(spark):
    rng = random.Random(13)
    fps = [0, (1 << 64) - 1, 1 << 63] + [rng.getrandbits(64) for _ in range(20)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").select("fp", simhash.grid_points(F.col("fp")).alias("p"))
    for r in df.collect():
        counts = [((r["fp"] >> 2 * s) & 3).bit_count() for s in range(32)]
        pack = lambda c: sum(x << 2 * s for s, x in enumerate(c))
        want = {pack(counts)}
        for s in range(32):
            want |= {pack([*counts[:s], x, *counts[s + 1 :]]) for x in (counts[s] - 1, counts[s] + 1) if 0 <= x <= 2}
        assert {x % (1 << 64) for x in r["p"]} == want and len(r["p"]) == len(want)


def test_many_matches_of_one_text(spark):
    text = " ".join(f"token=abcdef{i} {'f' * 24}" for i in range(700))
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["secret_spans"]
    want = sorted((m.start(), p, m.end()) for p, r in enumerate(secrets.RULES[:3]) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    assert [(s["start"], s["place"], s["end"]) for s in got] == want and len(want) == 1400


@pytest.mark.parametrize("gather", [100, 2_000_000])
def test_tokens_left_over_are_packed_with_the_next(spark, monkeypatch, gather):
    monkeypatch.setattr(packing, "GATHER", gather)
    rng = random.Random(14)
    df = spark.createDataFrame([(i, words(rng, rng.randint(0, 90))) for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(df, queries.WORD_BPE, capacity=64).collect()
    sizes, spans = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
        spans[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
    assert sum(n != 64 for n in sizes.values()) <= 6 and all(n & (n - 1) == 0 for n in sizes.values())
    for (_, size), pieces in spans.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == size
    ids = bpe.WordBpe(bpe.read_vocabulary(queries.WORD_BPE), "library")
    import zlib

    text = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in rows:
        raw = ids.encode([text[r["doc_id"]]])[0] + np.array([1], "<u4").tobytes()
        assert zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]


def test_languages_without_stop_words_pass_the_rule(spark):
    rng = random.Random(15)
    foreign, english = words(rng, 80, "klmnopq"), "The cat, and (the) dog: " + words(rng, 60, "klmnopq")
    df = spark.createDataFrame([(1, foreign, "xx"), (2, foreign, "en"), (3, foreign, None), (4, english, "en"), (5, english, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["n_stop_words"], r["kept"]) for r in quality.judge(df, lang="lang").collect()}
    assert got == {1: (None, True), 2: (0, False), 3: (0, False), 4: (3, True), 5: (3, True)}


def test_columns_may_clash(spark, odd):
    df, n = clashing(odd), odd.count()
    assert langid.identify(df, langid.fit(df, F.lit(True))).count() == n
    assert bpe.decode_documents(bpe.encode_documents(df, queries.WORD_BPE), queries.WORD_BPE).count() == n
    assert simhash.near_duplicates(df).count() == n
    assert quality.judge(df).count() == n
    assert suffix.remove_repeats(df).count() == n
    assert secrets.scan(df).count() == n
    assert packing.pack_documents(df, queries.WORD_BPE).agg(F.sum(F.expr("if(start = 0, 1, 0)"))).first()[0] == n
    labels = clashing(spark.createDataFrame([(1, 1), (2, 0), (5, 0)], "doc_id long, toxic int"))
    assert toxicity.score_documents(df, toxicity.fit(df, labels, F.lit(True))).count() == n


def test_numbers_of_rows(spark, odd):
    rows = common.numbered(odd, "doc_id", "row").collect()
    assert len({r["row"] for r in rows}) == len(rows)
    ordered = [r["doc_id"] for r in sorted(rows, key=lambda r: r["row"])]
    assert ordered == sorted((k for k in ordered if k is not None)) + [None] * 3
    plain = spark.createDataFrame([(5,), (-2,)], "doc_id long")
    assert {(r["doc_id"], r["row"]) for r in common.numbered(plain, "doc_id", "row").collect()} == {(5, 5), (-2, -2)}


def test_what_a_stage_stores_goes(spark):
    import os

    with common.scratch(spark) as made:
        one, two = common.stored(spark.range(3), "a"), common.stored(spark.range(4), "b")
        paths = list(made)
        made.pop()
    assert two.count() == 4 and [os.path.exists(p) for p in paths] == [False, True] and one is not two


# --- pipeline


def test_stages_on_odd_tables(spark, odd):
    df = clashing(odd)
    texts = lambda d: sorted(str(r["text"]) for r in d.collect())
    kept = corpus_pipeline.quality_rules(spark, df, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    one = corpus_pipeline.near_dedup(spark, df, SF)
    a, b, c = (odd.where(w).first()["text"] for w in ("doc_id = 1 and lang = 'en'", "doc_id = 1 and lang is null", "doc_id is null and source = 's'"))
    blank = [r["text"] for r in odd.where("doc_id = 2").collect()]
    assert one.columns == corpus_pipeline.COLUMNS and texts(one) == sorted(map(str, [a, b, c, *blank, "the the"]))
    cut = corpus_pipeline.repeat_removal(spark, df, SF)
    assert cut.columns == corpus_pipeline.COLUMNS and texts(cut) == sorted([a, b, c, "the the"])
    clean = corpus_pipeline.secret_scan(spark, df, SF)
    assert clean.columns == corpus_pipeline.COLUMNS and clean.count() == odd.count()
    pieces = corpus_pipeline.packed(spark, df, SF)
    assert pieces.where("start = 0").count() == odd.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


# --- op3


def test_rows_without_an_id_link_others(spark):
    rows = lambda *ids: spark.createDataFrame([*zip(ids, (0, 3, 15), strict=True)], "doc_id long, fp long")
    group = lambda df: {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.grouped(df).collect()}
    assert group(rows(1, 7, 2)) == {(1, 0): 1, (7, 3): 1, (2, 15): 1}
    assert group(rows(1, None, 2)) == {(1, 0): 1, (None, 3): 1, (2, 15): 1}
    assert group(rows(None, None, 5)) == {(None, 0): 5, (None, 3): 5, (5, 15): 5}
    assert group(rows(None, None, None)) == {(None, 0): None, (None, 3): None, (None, 15): None}


# --- long rows


def test_many_spans_are_masked_in_proportion(spark):
    rng = random.Random(12)
    rows, took = [], []
    for n in (0, 1, 3, 511, 512, 513, 1024, 3000):
        text = "".join(rng.choice("ab é𝒳\n") for _ in range(8 * n + 5))
        spans, at = [], 0
        for _ in range(n):
            at = max(0, min(len(text) - 1, at + rng.choice([-2, 0, 1, 5, 9])))
            spans.append((at, 0, min(len(text), at + rng.randrange(1, 12)), "k"))
        rows.append((n, text, sorted(spans)))
    schema = "n long, text string, spans array<struct<start:long,place:int,end:long,kind:string>>"
    for r in spark.createDataFrame(rows, schema).withColumn("out", secrets.redacted(F.col("text"), F.col("spans"))).collect():
        want, at = "", 0
        for s in r["spans"]:
            if s["start"] >= at:
                want += r["text"][at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["out"] == want + r["text"][at:]
    for n in (25_000, 100_000):
        df = spark.range(1).select(F.expr(f"repeat('secret words ', {n})").alias("text"), F.expr(f"transform(sequence(0, {n - 1}), i -> named_struct('start', 13L * i, 'place', 0, 'end', 13L * i + 6, 'kind', 'k'))").alias("spans"))
        began = time.time()
        assert df.select(F.length(secrets.redacted(F.col("text"), F.col("spans")))).first()[0] == n * 15
        took.append(time.time() - began)
    assert took[1] < 12 * max(took[0], 1)


def test_many_turns_are_read_out_in_proportion(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"), F.expr("concat('turn ', id, if(id % 7 = 0, '</s>', ''))").alias("text"))
    began = time.time()
    out = chat.format_conversations(rows).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert out["loss"] == "".join(f"turn {i}" + ("</s>" if i % 7 == 0 else "") for i in range(1, n, 2))
    assert time.time() - began < 120


def test_substrings_by_blocks(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 5 == 0 else chr(97 + i % 26) for i in range(5000))
    at = [(a, b) for a in (0, 1, 1023, 1024, 1025, 2047, 2048, 4999, 5000) for b in (0, 1, 1024, 1025, 2048, 3000, 4999, 5000) if a <= b]
    df = spark.createDataFrame([(text, a, b) for a, b in at], "t string, a long, b long")
    for r in df.withColumn("x", common.let(common.blocks(F.col("t")), lambda p: common.between(p, F.col("a"), F.col("b")))).collect():
        assert r["x"] == text[r["a"] : r["b"]]


def test_maps_and_arrays_beside_repeated_ids(spark):
    rows = [(1, "alpha beta", {"a": 1}, [1]), (1, "alpha beta", {"b": 2}, [2]), (None, "gamma", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, list array<int>")
    assert sorted(r["row"] for r in common.numbered(df, "doc_id", "row").collect())[0] >= 0
    assert suffix.remove_repeats(df).count() == 3 and len({r["row"] for r in common.numbered(df, "doc_id", "row").collect()}) == 3


def test_one_long_run_of_letters_is_merged_in_little_memory():
    import tracemalloc

    coder = bpe.WordBpe(bpe.read_vocabulary(queries.WORD_BPE))
    _ = coder.ranks
    rng = random.Random(13)
    piece = "".join(rng.choice("etaoinshr") for _ in range(100_000))
    tracemalloc.start()
    ids = coder.merged(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    library = bpe.WordBpe(bpe.read_vocabulary(queries.WORD_BPE)).library.encode(piece, add_special_tokens=False).ids
    assert ids == library and peak < 90 * len(piece)


def test_idle_workers_hold_little_memory():
    """A worker that has encoded many different words, asked by a later job."""
    program = r"""
import random, re
import pyarrow as pa
from pyspark.sql import SparkSession
from contactspark.llm import packing, queries

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rng = random.Random(17)
texts = [(i, " ".join("".join(rng.choices("etaoinshr", k=9)) for _ in range(800))) for i in range(500)]
docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
packing.pack_documents(docs, queries.WORD_BPE).write.format("noop").mode("overwrite").save()

def held(batches):
    from contactspark.llm import bpe

    for b in batches:
        found = re.findall(r"Pss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read())
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, found)) // 1024]), pa.array([len(bpe._OWN)])], names=["mb", "coders"])

print("HELD", *spark.range(1).coalesce(1).mapInArrow(held, "mb long, coders long").first())
"""
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=300, cwd=ROOT)
    mb, coders = map(int, re.search(r"HELD (\d+) (\d+)", out.stdout)[0].split()[1:])
    assert coders == 1 and mb < 170, (mb, coders)


def test_postings_are_walked_once(monkeypatch):
    """The similarity and the share of it that tells come from one walk; both against plain sums."""
    rng, terms = np.random.default_rng(19), 3000

    def vector():
        t = np.unique(np.minimum(rng.zipf(1.3, 60), terms) - 1)
        return t, rng.random(len(t)), rng.random(len(t))

    examples, texts = [vector()[:2] for _ in range(600)], [vector() for _ in range(40)]
    index = toxicity.BlockMaxIndex(examples, terms)
    plain = np.zeros((600, terms))
    for i, (t, w) in enumerate(examples):
        plain[i, t] = w
    walked, spans = [], toxicity.spans
    monkeypatch.setattr(toxicity, "spans", lambda a, size: walked.append(size.sum()) or spans(a, size))
    found = list(index.all_nearest(texts, 20))
    asked = np.concatenate([t for t, _, _ in texts])
    asked = asked[index.row[asked] < 0]
    cells = index.cells[asked + 1] - index.cells[asked]
    postings = index.edges[index.cells[asked + 1]] - index.edges[index.cells[asked]]
    assert sum(walked) <= cells.sum() + postings.sum()
    for (t, w, share), (number, similarity, told) in zip(texts, found, strict=True):
        want = plain[:, t] @ w
        assert np.allclose(similarity, np.sort(want[want > 0])[::-1][:20]) and np.allclose(similarity, want[number]) and np.allclose(told, plain[number][:, t] @ (w * share))
