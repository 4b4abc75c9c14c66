"""Inequality joins, ranks by ranges, stored tables, recursion and sketches."""

import math
import operator
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import sketches
from tessera.operators import graph, inequality, lexical
from tessera.plans import retrieval
from tessera.sources import load, save, save_bucketed

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.mark.parametrize("x,y", [("<", ">"), (">=", "<"), ("<=", "<="), (">", ">=")])
def test_inequality_join_by_brute_force(spark, monkeypatch, x, y):
    monkeypatch.setattr(inequality, "BLOCK", 16)
    monkeypatch.setattr(inequality, "RANGE_ROWS", 100)
    monkeypatch.setattr(inequality, "AT_ONCE", 50)
    r = np.random.default_rng(4)
    one = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.integers(0, 40, (120, 2)))] + [(500, None, 1.0), (501, 1.0, math.nan), (None, 1.0, 1.0)]
    other = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.integers(0, 40, (150, 2)))] + [(600, 3.0, None), (7, 3.0, 3.0)]
    left, right = spark.createDataFrame(one, "i long, a double, b double"), spark.createDataFrame(other, "j long, a double, b double")
    got = inequality.inequality_join(left, right, ("a", x, "a"), ("b", y, "b"), "i", "j")
    whole = lambda t: all(v is not None and v == v for v in t)
    want = Counter((p[0], q[0]) for p in one for q in other if whole(p) and whole(q) and OPS[x](p[1], q[1]) and OPS[y](p[2], q[2]))
    assert Counter(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert inequality.inequality_join(left.limit(0), right, ("a", x, "a"), ("b", y, "b"), "i", "j").count() == 0


def test_between_ranges_only_matches_are_made():
    """Where x is known to hold, the pairs gone through are those of the result."""
    ids, made = np.arange(1000), 0
    left, right = (ids, ids * 1.0, ids * 1.0), (ids, ids + 5000.0, ids * 1.0)
    for a, b in inequality.block_matches(left, right, True, (True, True)):
        assert (a < b).all()
        made += len(a)
    assert made == 1000 * 999 // 2


def test_numbers_within_a_large_group(spark):
    r = np.random.default_rng(5)
    rows = [("big" if i % 10 else None if i % 20 else "small", float(x), i) for i, x in enumerate(r.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "g string, x double, i long").repartition(4)
    got = {r["i"]: (r["rn"], r["n"]) for r in inequality.numbered(df, "g", ["x", "i"]).collect()}
    for g in ("big", "small", None):
        own = sorted((x, i) for h, x, i in rows if h == g)
        assert [got[i] for _, i in own] == [(k + 1, len(own)) for k in range(len(own))]
    assert inequality.numbered(df.limit(0), "g", ["x", "i"]).count() == 0


def test_recursion_gives_what_the_loop_gives(spark):
    r = np.random.default_rng(6)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in r.integers(0, 60, (70, 2))] + [(None, "n1")], "src string, dst string")
    seeds = spark.createDataFrame([("n1",), ("n2",), (None,), ("nowhere",), ("n1",)], "node string")
    for hops in (0, 1, 3):
        assert sorted(map(tuple, graph.khop_recursive(edges, seeds, hops).collect())) == sorted(map(tuple, graph.khop(edges, seeds, hops).collect()))
    with pytest.raises(ValueError):
        graph.khop_recursive(edges, seeds, 101)


def test_buckets_join_without_a_shuffle(spark, sf, tmp_path):
    found = lexical.postings(load(spark, sf, "documents"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posts = save_bucketed(found, "t_postings", str(tmp_path / "p"), ["term"], 4)
        freqs = save_bucketed(lexical.doc_freq(posts), "t_df", str(tmp_path / "d"), ["term"], 4)
        plan = posts.join(freqs.where("df <= 2"), "term")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        counted = freqs.agg(F.sum("df")).first()[0]
        assert counted == posts.count() == found.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("t_postings", "t_df"):
            spark.sql(f"drop table if exists {name}")


def test_partitions_are_pruned_by_the_join(spark, sf, tmp_path):
    docs = load(spark, sf, "documents")
    save(docs.select("doc_id", F.lit("x").alias("term"), F.lit(1).cast("long").alias("tf"), "lang"), str(tmp_path / "p"), ["lang"])
    posts = spark.read.parquet(str(tmp_path / "p"))
    plan = retrieval.postings_of_languages(posts, docs)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_count_min_stays_within_its_bound(spark):
    r = np.random.default_rng(7)
    keys = r.zipf(1.3, 20_000) % 3000 - 1000
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "k long").repartition(3)
    exact = Counter(keys.tolist())
    sketch = sketches.count_min(df, "k", error=0.005, confidence=0.99)
    assert sketches.opened(sketch)[0] == len(keys) and len(sketch) < 30_000
    asked = spark.createDataFrame([(k,) for k in [*range(-1000, 2000), None, 10**12]], "k long")
    got = {r["k"]: r["n"] for r in asked.select("k", sketches.count_min_estimate(F.col("k"), sketch).alias("n")).collect()}
    over = [got[k] - exact[k] for k in range(-1000, 2000)]
    assert got[None] is None and min(over) >= 0 and np.mean(np.array(over) <= 0.005 * len(keys)) >= 0.99 and max(over) > 0
    fine = sketches.count_min(df, "k", error=0.0001)
    assert {r["k"]: r["n"] for r in asked.where("k is not null").select("k", sketches.count_min_estimate(F.col("k"), fine).alias("n")).collect()}.items() >= exact.items()


