"""Phrases against plain counts with whole numbers of any size, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF

from contactspark.llm import phrases, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, longest, top, share):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    candidates = {x for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for lang, w in candidates:
        a = f[lang, w]
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        longer = any(100 * f[lang, y] >= share * a for lg, y in candidates if lg == lang and len(y) > len(w) and any(y[i : i + len(w)] == w for i in range(len(y) - len(w) + 1)))
        if not longer:
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def test_awkward_rows(spark):
    rng = random.Random(8)
    vocabulary = ["The", "the", "of", "é", "É", "naïve", "x\x00", "a-b", "\x1c", "ſ"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(7)) for _ in range(4)]
    texts = [None, "", " \t ", "...", "\n\x0b\x0c\r", "one", "one  two\tthree", "a a a a a a a a a a"]
    texts += [rng.choice([" ", "\t"]).join(rng.choice(passages) if rng.random() < 0.3 else rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += ["very long text, " * 20_000]
    rows = [(t, rng.choice([None, "und", "en", "fr", ""]), "w1", {"k": 1}, i) for i, t in enumerate(texts + texts[:40])]
    df = spark.createDataFrame(rows, "text string, lang string, w1 string, extra map<string,int>, n long").repartition(5)
    for least, longest, top, share in ((3, 5, 2000, 100), (2, 3, 7, 100), (4, 6, 2000, 60), (300, 5, 50, 100)):
        got = sorted(map(tuple, phrases.collocations(df, least=least, longest=longest, top=top, share=share).collect()))
        assert got == plain([r[:2] for r in rows], least, longest, top, share)
        assert got
    assert phrases.collocations(df.limit(0)).count() == 0


def test_crowded_cells_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(60)), rng.choice("xy")) for _ in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(phrases, "tables_of", lambda df, least, longest: [np.full(1 << 13, 255, "u1")] * longest)
    assert sorted(map(tuple, phrases.collocations(df, least=9).collect())) == plain(rows, 9, 5, 2000, 100)


def test_few_cells_are_open(spark):
    rows = [("common pair here " + " ".join(f"w{i}_{j}" for j in range(30)), "en") for i in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    tables = phrases.tables_of(df, 100, 5)
    assert [int(np.unpackbits(t).sum()) for t in tables] == [5, 5, 1, 1, 1]  # three words and two pairs; a triple
    assert phrases.windows(df, tables).where("w1 <> ''").groupBy("w1", "w2", "w3", "w4", "w5").count().count() == 3
    assert not any(t.any() for t in phrases.tables_of(df, 401, 3)) and np.unpackbits(phrases.tables_of(df, 400, 2)[0]).sum() == 5


def test_products_pass_64_bits(spark):
    df = spark.sql("select repeat('hot pair ', 200000) as text, 'en' as lang from range(20)").repartition(4)
    got = [tuple(r) for r in phrases.collocations(df).where("rank <= 3").collect()]
    n = 8_000_000
    assert ("en", got[0][1], got[0][2]) == ("en", 1, got[0][2]) and all(r[6] == n for r in got)
    for _, _, _, a, left, right, total, score in got:
        assert score == 1000 * a * total // (left * right)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_query_is_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.SQL["op13_phrases"]).fetchall()
    assert sorted(map(tuple, queries.op13_phrases(spark, sf).collect())) == sorted(want)
    assert want
