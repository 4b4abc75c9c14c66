"""The stored vector index and the similarity join of all rows."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import balls, ivf, qa, vector
from tessera.sources import load

SCHEMA = "vec_id long, embedding array<double>"


def clustered(seed, groups=12, size=40, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (groups, 16))
    return [(i, (centres[i % groups] + r.normal(0, spread, 16)).tolist()) for i in range(groups * size)]


def recall(found, exact):
    found, exact = ({(r["query_id"], r["vec_id"], r["score"]) for r in df.collect()} for df in (found, exact))
    return len(found & exact) / len(exact)


def test_stored_index_finds_and_reopens(spark, sf, tmp_path):
    vectors = load(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    index = ivf.build(vectors, str(tmp_path / "index"))
    exact = vector.knn(asked, vectors, 5)
    assert recall(ivf.search(asked, index, 5, probes=-(-2 * len(index.centres) // 3)), exact) >= 0.9
    again = ivf.opened(spark, str(tmp_path / "index"))
    assert (again.centres == index.centres).all() and (again.codebooks == index.codebooks).all()
    assert recall(ivf.search(asked, again, 5, probes=len(index.centres), keep=500), exact) == 1


def test_only_probed_partitions_are_read(spark):
    """Vectors in clusters: few cells are probed, the plan prunes to them, and recall stays."""
    vectors = spark.createDataFrame(clustered(1), SCHEMA)
    index, asked = ivf.build(vectors), vectors.where("vec_id = 0")
    assert recall(ivf.search(asked, index, 5, probes=3), vector.knn(asked, vectors, 5)) >= 0.9
    cells = [r["cell"] for r in ivf.probed(asked, index, 3).collect()]
    rows = index.rows(spark).where(F.col("cell").isin(cells)).select("vec_id", "codes")
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") and "embedding:" not in plan.split("== Physical Plan ==")[1]
    assert len(cells) == 3 and rows.count() < 0.5 * vectors.count() == 0.5 * index.rows(spark).count()


def test_index_of_broken_vectors(spark):
    nan = math.nan
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [nan, 1.0]), (None, [1.0, 1.0]), (6, [0.5, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    index = ivf.build(df.where("vec_id is null or vec_id != 4"), cells=1)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ivf.search(df.where("vec_id in (0, 2, 5)"), index, 3, probes=1).collect()) == [(0, 1, 1), (0, 2, 6)]
    none = ivf.build(df.limit(0))
    assert ivf.search(df, none, 3, probes=1).count() == 0


def brute_classes(rows, least):
    unit = [(i, np.array(v) / np.linalg.norm(v)) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) else (i, None) for i, v in rows if i is not None]
    links, parent = [0] * len(unit), list(range(len(unit)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(unit)):
        for b in range(a):
            if unit[a][1] is not None and unit[b][1] is not None and round(float(unit[a][1] @ unit[b][1]), 9) >= least:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for n, (i, _) in enumerate(unit):
        ids[root(n)].append(i)
    return sorted((i, links[n], min(ids[root(n)])) for n, (i, _) in enumerate(unit))


@pytest.mark.parametrize("least,block", [(0.995, 2048), (0.9, 20), (0.3, 50)])
def test_similarity_of_all_rows(spark, monkeypatch, least, block):
    monkeypatch.setattr(balls, "BLOCK", block)
    rows = clustered(2, size=12)
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(5, [2 * x for x in rows[7][1]]), (2000, None), (2001, [0.0] * 16), (2002, [math.nan] * 16), (2003, [1.0, None] + [0.0] * 14), (None, rows[0][1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in balls.similarity_classes(df, least).collect()) == brute_classes(rows, least)
    assert balls.similarity_classes(df.limit(0), least).count() == 0


def test_balls_and_distances_skip_pairs():
    """Of two million pairs few are compared, and none that counts is lost."""
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (2000, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, least, met = r.permutation(2000), 0.999, []
    pivots = balls.pivots_of(x, 45)
    away = np.linalg.norm(x[:, None] - pivots[None], axis=2)
    home, reach, found = away.argmin(axis=1), math.sqrt(2 - 2 * least), set()
    for ball in range(len(pivots)):
        inside = away[:, ball] <= away.min(axis=1) + 2 * reach
        sides = [(ids[m], away[m, ball], x[m]) for m in (home == ball, inside)]
        a, b, _ = balls.block_pairs(*sides, least, met, strip=16)
        assert not found & set(zip(a.tolist(), b.tolist(), strict=True))
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    i, j = np.nonzero(np.triu(np.round(x @ x.T, 9) >= least, 1))
    assert found == {(min(a, b), max(a, b)) for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True)}
    assert sum(met) < 0.1 * 2000 * 1999 / 2


def test_answers_by_worker_and_by_table(spark):
    rows = [(1, "red car", "A dog. The red car stops. End"), (2, None, "One. Two"), (3, "x", None), (4, "a b", "b x. a b. a b c"), (5, "É a", " \t. é A\n. b")]
    df = spark.createDataFrame(rows, "id long, question string, context string")
    want = {r["id"]: r["answer"] for r in qa.answer(df).collect()}
    assert {r["id"]: r["answer"] for r in qa.answer(df, qa.worker_answer(qa.sentence_answerer)).collect()} == want
    assert {r["id"]: r["answer"] for r in qa.answer_by_table(df, ["id"]).collect()} == want


def test_a_worker_sets_its_function_up_once(spark, tmp_path):
    """Once for all batches of a task."""
    folder = str(tmp_path)

    def setup():
        import tempfile

        tempfile.mkstemp(dir=folder)
        return lambda q, c: q + c

    df = spark.range(1000).select(F.col("id").cast("string").alias("question"), F.lit("!").alias("context")).repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert {r["answer"] for r in qa.answer(df, qa.worker_answer(setup)).collect()} == {f"{i}!" for i in range(1000)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list(tmp_path.iterdir())) == 1
