"""Mixing sources against targets filled up step by step, exact sums of copies, and its SQL."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from contactspark.llm import mixing, queries
from contactspark.llm.common import in_order


def plain_targets(size: dict) -> dict:
    """By weight, with what is too much for a source shared again by the others until none has too much."""
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return {s: 2.0 * size[s] for s in names}
        level = (total - 2 * sum(size[s] for s in full)) / sum(weight[s] for s in rest)
        more = {s for s in rest if level * weight[s] > 2 * size[s]}
        if not more:
            return {s: 2.0 * size[s] if s in full else level * weight[s] for s in names}
        full |= more


def held(rows, size_of):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    want = plain_targets({s: sum(r["size"] for r in x) for s, x in by.items()})
    for s, x in by.items():
        total, target = sum(r["size"] for r in x), want[s]
        rate = target / total if total else 0
        assert {r["source_size"] for r in x} == {total}
        assert all(abs(r["target"] - target) < 1e-6 * max(1, target) for r in x)
        assert all(int(rate - 1e-6) <= r["copies"] <= min(2, int(rate + 1 - 1e-6)) and r["taken"] == r["size"] * r["copies"] for r in x)
        assert abs(sum(r["copies"] for r in x) - rate * len(x)) <= 1 + 1e-6
        assert abs(sum(r["taken"] for r in x) - target) <= max(r["size"] for r in x) + 1


@pytest.mark.parametrize("seed", range(3))
def test_awkward_rows(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, i, i]), rng.choice([None, "", " \n", "w " * rng.randrange(1, 60), "long " * 3000]), rng.choice([None, "", "a", "b", "c", "ä", "𝒳", "hot", "hot", "hot"]), {"m": 1}, "row", 3) for i in range(500)]
    rows += [(7, "same words here", "hot", None, "place", None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>, row string, size int")
    out = mixing.mix(df.repartition(5)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((i, s, len((t or "").split())) for i, t, s, *_ in rows)
    held(out, None)
    again = mixing.mix(df.repartition(2)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_few_and_no_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, "a b c d", None)], schema)).collect()
    assert [(r["source"], r["size"], r["target"]) for r in one] == [(None, 4, 6.0)] and one[0]["copies"] in (1, 2)
    blank = mixing.mix(spark.createDataFrame([(1, None, "x"), (2, "", "y")], schema)).collect()
    assert {(r["target"], r["taken"]) for r in blank} == {(0.0, 0)}


def test_query_is_sql_and_near_its_targets(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        got = queries.op12_mixing(spark, sf).collect()
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
        want = con.execute(queries.SQL["op12_mixing"]).fetchall()
        assert sorted(map(tuple, got)) == sorted(want)
        held(got, None)
        for s in {r["source"] for r in got}:
            mine = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.5 * max(r["size"] for r in mine)


def test_documents_are_emitted_as_often_as_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs)
    out = mixing.emit(docs, mixed)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in mixed.collect() if r["copies"]}


def test_sums_in_order(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 101).alias("k"), (F.col("id") % 11).alias("v"))
    got = sorted((r["k"], r["at"], r["s"], r["v"]) for r in in_order(df, [F.desc("k")], {"at": None, "s": F.col("v")}).collect())
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == list(range(5000)) and [r[0] for r in got] == sorted((r[0] for r in got), reverse=True)
    total = 0
    for _, _, s, v in got:
        assert s == total
        total += v
