"""Steps whose rows, memory or time grew faster than the tables."""

import random

import pytest


def _vectors(spark, n, width=8, same=()):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(width)]) for i in range(n)]
    rows = [(i, rows[0][1] if i in same else v) for i, v in rows]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def _single(rows):
    import numpy as np

    return {i: [float(np.float32(x)) for x in v] for i, v in rows}


def _brute(rows, asked, k):
    vectors, out = _single(rows), {}
    for q in asked:
        scores = []
        for i, v in vectors.items():
            if i != q:
                s = 0.0
                for a, b in zip(vectors[q], v, strict=True):
                    s += a * b
                scores.append((-round(s, 9), i))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def test_nearest_without_a_row_for_each_pair(spark):
    from tessera.operators import vector

    rows, vectors = _vectors(spark, 3_000, same=range(100, 400))
    asked = vectors.where("vec_id % 50 = 0")
    near = vector._against(asked, vectors, 5)
    assert near.count() <= 60 * vector.shards_of(vectors) * 10  # not 60 * 3,000
    found = {}
    for r in vector.knn(asked, vectors, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == _brute(rows, range(0, 3_000, 50), 5)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_a_block_gives_all_that_may_be_best(k):
    import numpy as np

    from tessera.operators.vector import block_matches

    draw = np.random.default_rng(1)
    x, y = draw.integers(-3, 4, (50, 6)).astype(float), draw.integers(-3, 4, (700, 6)).astype(float)  # many ties
    i, j, score = block_matches(np.arange(50), x, np.arange(700), y, k, None)
    for q in range(50):
        best = sorted((-s, v) for v, s in enumerate(y @ x[q]) if v != q)[:k]
        assert set(best) <= {(-s, v) for s, v in zip(score[i == q], j[i == q], strict=True)}


def test_recursive_hops_have_no_row_for_each_walk(spark):
    from tessera.operators import graph

    n = 110  # 3 n ** 3 walks of three steps from one seed
    edges = spark.createDataFrame([(f"p{i}", f"l{j}") for i in range(n) for j in range(n)], "src string, dst string")
    seeds = spark.createDataFrame([("p0",)], "node string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.khop_recursive(edges, seeds, 3)) == rows(graph.khop(edges, seeds, 3))
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        assert graph.khop_recursive(edges, seeds, 2).count() == 2 * n
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "100"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_counts_of_more_keys_than_the_sketch_has_cells(spark):
    from tessera.functions.sketches import count_min, count_min_exact

    rows = spark.range(60_000).selectExpr("id % 3001 * 7 as k")
    keys = spark.range(3_005).selectExpr("id * 7 as key")
    for error in (0.1, 0.002, 0.0001):
        found = dict(map(tuple, count_min_exact(keys, rows, "k", count_min(rows, "k", error=error)).collect()))
        assert found == {7 * i: (60_000 + 3_000 - i) // 3_001 if i < 3_001 else 0 for i in range(3_005)}


def test_lines_of_many_suppliers(spark, tmp_path):
    from tessera import plans

    spark.range(30_000).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(300_000).selectExpr("pmod(xxhash64(id), 30010) as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = plans.queries()["r29_count_min"](spark, str(tmp_path)).collect()
    told = dict(map(tuple, spark.sql(f"SELECT s_suppkey, count(l_suppkey) FROM parquet.`{tmp_path}/supplier.parquet` LEFT JOIN parquet.`{tmp_path}/lineitem.parquet` ON l_suppkey = s_suppkey GROUP BY s_suppkey").collect()))
    assert dict(map(tuple, found)) == told


@pytest.mark.parametrize("block", [1, 7, 8_192])
def test_points_of_ranges_are_counted_without_a_row_for_each(spark, block):
    from tessera.operators.inequality import range_counts

    draw = random.Random(5)
    points = [(1_000 - i, draw.choice([draw.randint(0, 40) / 2, None, float("nan"), -0.0])) for i in range(400)]
    ranges = [(i, *sorted(draw.choice([draw.randint(-4, 50) / 2, -0.0]) for _ in range(2))) for i in range(200)] + [(200, None, 3.0), (201, 3.0, 1.0), (202, float("-inf"), float("inf"))]
    found = range_counts(spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(ranges, "r long, low double, high double"), "x", "p", "low", "high", "r", block)
    told = []
    for r, low, high in ranges:
        ids = [i for i, x in points if x is not None and low is not None and low <= x < high]
        if ids:
            told.append((r, len(ids), min(ids)))
    assert sorted(map(tuple, found.collect())) == told


def test_terms_of_a_text_are_no_rows(spark, sf):
    from tessera import plans

    df = plans.queries()["t1_tokens"](spark, sf)
    assert "Generate" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("least", [-1.0, 0.2, 0.6, 0.95])
def test_links_of_all_blocks_as_by_brute_force(spark, least):
    import numpy as np

    from tessera.operators import balls

    rows, vectors = _vectors(spark, 240, 5, same=range(10, 20))
    x = np.array([v for _, v in sorted(_single(rows).items())])
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    near = (np.round(x @ x.T, 9) >= least - 5e-10) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
    others, edges = balls.linked(units := balls.unit_vectors(vectors), least, cell=50)
    assert edges.count() <= 240 * 6  # not a row a link
    told = {r["first"]: r["copies"] - 1 + (r["n"] or 0) for r in units.join(others, units.rep == others.a, "left").collect()}
    assert told == {i: int(near[i].sum()) for i in told}
    found = {r["vec_id"]: (r["links"], r["class_id"]) for r in balls.similarity_classes(vectors, least).collect()}
    assert found == {i: (int(near[i].sum()), int(label[i])) for i in range(len(x))}


def test_strips_far_apart_are_skipped():
    import numpy as np

    from tessera.operators.balls import block_links

    draw = np.random.default_rng(2)
    x = np.repeat(np.eye(8), 512, axis=0) + draw.normal(0, 0.01, (4_096, 8))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    met = []
    links, _, roots = block_links((np.ones(4_096, np.int64), x), None, 0.9, met)
    assert (links == 511).all() and set(roots) == set(range(0, 4_096, 512))
    assert sum(met) == 8 * 512 * 512


@pytest.mark.parametrize("most", [1, 20, 50_000])
def test_entities_are_found_with_few_known_frequencies(spark, monkeypatch, most):
    import math
    from collections import Counter

    from tessera.operators import graph

    monkeypatch.setattr(graph, "MOST_FREQUENT", most)
    draw = random.Random(9)
    rows = [(i % 95, " ".join(f"w{min(draw.randint(0, 60), draw.randint(0, 60))}" for _ in range(draw.randint(0, 90)))) for i in range(100)] + [(100, None), (101, "a a")]
    chunks = {}
    for i, t in rows:
        for c in range(max(0, math.ceil((len(t or "") - 500) / 400)) + 1 if t else 0):
            chunks.setdefault(f"{i}#{c}", Counter()).update(t[c * 400 : c * 400 + 500].split())
    chunks = {k: v for k, v in chunks.items() if v}
    df = Counter(w for v in chunks.values() for w in v)
    told = set()
    for k, v in chunks.items():
        best = sorted((-round(tf * math.log(len(chunks) / df[w]), 6), w) for w, tf in v.items())[:3]
        told |= {(k, w, -x, r + 1) for r, (x, w) in enumerate(best)}
    found = graph.entities(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["chunk"], r["term"], r["weight"], r["rank"]) for r in found.collect()} == told


@pytest.mark.parametrize("asked", [3, 4_096])
def test_lists_are_not_copied_for_each_slice_of_questions(spark, monkeypatch, asked):
    from tessera.operators import impact, lexical

    monkeypatch.setattr(impact, "ASKED", asked)
    draw = random.Random(4)
    text = lambda: " ".join(f"w{draw.randint(0, 30)}" for _ in range(12))
    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    questions = spark.createDataFrame([(i, text()) for i in range(60)], "question_id long, text string")
    index = lexical.impact_index(*lexical.weighted(docs), shard=20)  # 15 shards for 4 cores
    found = impact.topk(questions, index, 3)
    plan = found._jdf.queryExecution().toString()
    assert "pmod(xxhash64(q" not in plan or ", 1)" in plan  # one part, so lists are shuffled once
    rows = lambda df: sorted((r["question_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert rows(lexical.best(found, 3)) == rows(lexical.best(lexical.bm25_scores(questions, docs), 3))


def test_buckets_follow_the_documents(spark):
    from tessera.plans.retrieval import buckets_of

    assert buckets_of(spark.range(10)) == 16
    assert buckets_of(spark.range(1_000_000)) == 62


@pytest.mark.parametrize("words", [50, 2_000_000])
def test_postings_of_an_index_are_no_rows(spark, monkeypatch, words):
    from tessera.operators import impact, lexical

    monkeypatch.setattr(impact, "WORDS_AT_ONCE", words)
    draw = random.Random(6)
    text = lambda: " ".join(f"w{min(draw.randint(0, 30), draw.randint(0, 30))}" for _ in range(draw.randint(1, 20)))
    docs = spark.createDataFrame([(5 * i % 301, text()) for i in range(300)] + [(400, None), (401, ""), (None, "w1 w1")], "doc_id long, text string").repartition(3)
    questions = spark.createDataFrame([(i, text()) for i in range(30)], "question_id long, text string")
    index = lexical.index(docs, shard=40)
    if words > 50:
        assert index.rows.count() <= 32 * 3 * 4  # terms x slices
    rows = lambda df: sorted((r["question_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    known = lexical.bm25_scores(questions, docs).where("doc_id is not null")
    assert rows(lexical.best(impact.topk(questions, index, 4, block=3), 4)) == rows(lexical.best(known, 4))


def test_an_id_that_comes_again_adds_up(spark):
    from tessera.operators import impact, lexical

    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (1, "a c")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "a b")], "question_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(lexical.best(impact.topk(asked, lexical.index(docs), 4), 4)) == rows(lexical.best(lexical.bm25_scores(asked, docs), 4))


def test_added_and_merged_lists_are_not_postings(spark, tmp_path):
    from tessera.operators import live

    docs = spark.createDataFrame([(i, f"a b b c{i % 3}") for i in range(90)], "doc_id long, text string").coalesce(1)
    for name, part in (("s0", docs.where("doc_id < 40")), ("s1", docs.where("doc_id >= 40"))):
        live.add(str(tmp_path), part, name)
    name = live.merge(spark, str(tmp_path))
    rows = spark.read.schema(live.POSTINGS).parquet(f"{tmp_path}/postings").where(f"segment = '{name}'").collect()
    assert {r["term"]: r["df"] for r in rows} == {"": 90, "a": 90, "b": 90, "c0": 30, "c1": 30, "c2": 30}
    (whole,) = [r for r in rows if r["term"] == ""]
    assert not whole["pos"] and set(whole["dls"]) == {4}
    for r in rows:  # ids and lengths stand once
        if r["term"]:
            assert not r["docs"] and not r["dls"] and len(r["pos"]) == r["df"]
            assert sorted(whole["docs"][p] for p in r["pos"]) == [i for i in range(90) if r["term"] in f"a b b c{i % 3}".split()]


def test_names_of_nodes_are_not_copied(spark):
    from tessera.operators import graph

    edges = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(12) for j in range(i)], "src string, dst string")
    found = graph.triangles(edges, 10)
    dealt = found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[1].splitlines()[0]
    assert "cell" in dealt and found.first()["triangles"] == 220


def test_postings_are_not_dealt_by_language(spark):
    from tessera.plans.retrieval import postings_of_languages

    docs = spark.createDataFrame([(1, "en", 20_000), (2, "fr", 10), (3, None, 20_000)], "doc_id long, lang string, n_chars long")
    posts = spark.range(1_000).selectExpr("id as doc_id", "concat('w', id % 300) as term", "1L as tf", "if(id % 10 = 0, 'fr', 'en') as lang")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = postings_of_languages(posts, docs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert found.count() == 270 and found.where("lang = 'en'").count() == 270
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
