"""Runs of words against a plain search of all lags, on small and awkward texts and on whole tables."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from contactspark.llm import queries, runs

SPACE = b" \t\n\x0b\x0c\r"


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """All runs, lag by lag; a stretch with a smaller period is not one of this lag."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_words(text) -> list[bytes]:
    return (text or "").encode().split()


def collapsed(w: list[bytes], found) -> bytes:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_awkward_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "ab ab ab ab ab ab", "  " * 9, "é É é É é É é É", "x\ny " * 7, "a b " * 4 + "c " * 6 + "b a " * 4]
    for _ in range(400):
        w = []
        while len(w) < rng.randrange(2, 60):
            w += [rng.choice("abcd") for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 7) if rng.random() < 0.6 else [rng.choice("abcdefgh")]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(w))
    rows = [(None if i % 7 == 0 else i // 2, t, "runs", {"k": "v"}) for i, t in enumerate(texts + texts[:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, extra map<string,string>").repartition(3)
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "extra", "runs", "collapsed"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        w = plain_words(r["text"])
        want = plain_runs(w)
        assert [tuple(x) for x in r["runs"]] == want, r["text"]
        assert r["collapsed"].encode() == collapsed(w, want)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, exponent=3)


def test_other_exponent_and_length(spark):
    df = spark.createDataFrame([("a b " * 5 + "a",), ("c " * 9,)], "text string")
    assert [[tuple(x) for x in r["runs"]] for r in runs.periodic_runs(df, exponent=5, least=10).collect()] == [[(0, 11, 2)], []]


def test_long_texts_take_near_linear_time():
    rng = np.random.default_rng(0)
    for w, n in ((np.zeros(300_000, "i8"), 1), (np.tile(rng.integers(0, 50, 997), 300), 1), (rng.permutation(300_000) % 60_000, None)):
        began = time.time()
        found = runs.runs_of(w, np.zeros(len(w), "i8"))
        assert time.time() - began < 20 and (n is None or len(found) == n)


def test_query_is_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_runs(spark, SF).collect()
    assert len(got) == len(docs)
    some = 0
    for r in got:
        w, h = plain_words(docs[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
        want = plain_runs(w)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        some += bool(want)
        assert r["n_runs"] == len(want)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, want)).hexdigest()
    assert some > 5


def test_periodic_text_of_awkward_rows(spark):
    df = spark.range(200).select(F.expr("if(id % 9 = 0, null, id)").alias("doc_id"), F.expr("case when id % 5 = 0 then null when id % 5 = 1 then ' ' else concat_ws(' ', transform(sequence(1, 1 + id % 40), x -> cast(x as string))) end").alias("text"))
    for r in df.withColumn("new", queries.periodic_text(F.col("doc_id"), F.col("text"))).collect():
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10:
            assert r["new"] == r["text"]
