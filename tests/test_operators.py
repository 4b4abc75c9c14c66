"""Small cases worked by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cosine, dot, normalize_ws, page_title, strip_html, terms
from tessera.operators import graph, lexical, qa, sizes, temporal, text, vector
from tessera.plans import graphs
from tessera.sources import load, save
from tessera.sources.tables import stream
from tessera.streaming.runner import drained

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("c", "f")]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_text_columns(spark):
    df = spark.createDataFrame([("Ab, 9 é!", "<TITLE>x\ny</TITLE><p>one<script>no</script> <!-- no --> two", " a \n b ")], "t string, h string, w string")
    row = df.select(terms(F.col("t")).alias("t"), page_title(F.col("h")).alias("p"), strip_html(F.col("h")).alias("h"), normalize_ws(F.col("w")).alias("w")).first()
    assert row["t"] == ["ab", "9", "é"] and row["p"] == "x\ny" and row["h"] == "x y one two" and row["w"] == "a b"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    rows = df.select(dot(F.col("a"), F.col("b")).alias("d"), cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0]["d"] == 11.0 and abs(rows[0]["c"] - 11 / (math.sqrt(5) * 5)) < 1e-12
    assert rows[1]["d"] == 0.0 and rows[1]["c"] is None and rows[2]["d"] is None


def test_approximate_neighbours(spark, sf):
    vectors = load(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    exact, found = (set(pairs(df, "query_id", "vec_id", "score")) for df in (vector.knn(asked, vectors, 5), vector.ann(asked, vectors, 5, width=64)))
    assert len(exact & found) >= 0.9 * len(exact) == 0.9 * len(found)


def test_approximate_neighbours_leave_out_broken_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0])], "vec_id long, embedding array<double>")
    assert pairs(vector.ann(df, df, 3, width=2), "query_id", "vec_id", "rank") == [(0, 1, 1), (1, 0, 1)]
    assert vector.ann(df.limit(0), df, 3, width=2).count() == 0


def test_chunks_cover_and_skip_nothing(spark):
    df = spark.createDataFrame([(1, "x" * 901), (2, ""), (3, None), (4, "y" * 500)], "doc_id long, text string")
    got = pairs(text.chunk(df).select("doc_id", "chunk_no", F.length("text").alias("n")), "doc_id", "chunk_no", "n")
    assert got == [(1, 0, 500), (1, 1, 500), (1, 2, 101), (4, 0, 500)]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "c")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a")], "question_id long, text string")
    row = lexical.bm25_topk(asked, docs).first()
    want = math.log(1 + 2.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2))
    assert row["doc_id"] == 1 and abs(row["score"] - round(want, 6)) < 1e-9


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a")], "question_id long, text string")
    none = spark.createDataFrame([], "src string, dst string")
    assert lexical.bm25_topk(asked, docs).count() == 0
    assert graph.components(none).count() == 0 and graph.pagerank(none).count() == 0 and graph.communities(none).count() == 0
    assert graph.triangles(none).first()["triangles"] == 0


def test_knn_ties_and_self(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert pairs(vector.knn(v.where("vec_id = 3"), v, 2), "rank", "vec_id") == [(1, 1), (2, 2)]


def test_graph_walks(spark, edges):
    assert pairs(graph.degree(edges), "node", "degree") == [("a", 2), ("b", 2), ("c", 3), ("d", 1), ("e", 1), ("f", 1)]
    assert pairs(graph.components(edges), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "a")]
    seeds = spark.createDataFrame([("a",)], "node string")
    assert pairs(graph.khop(edges, seeds, 2), "node", "hop") == [("a", 0), ("b", 1), ("c", 1), ("f", 2)]
    assert graph.triangles(edges).first()["triangles"] == 1


def test_components_of_a_chain(spark):
    n = 60
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n)], "src string, dst string")
    assert {r["component"] for r in graph.components(chain).collect()} == {"000"}


def test_pagerank_sums_to_one(edges):
    assert abs(sum(r["rank"] for r in graph.pagerank(edges).collect()) - 1) < 1e-6


def test_pack_context_fits(spark):
    hits = spark.createDataFrame([(1, r, r * 10) for r in range(1, 6)], "question_id long, rank int, n_chars long")
    assert pairs(qa.pack_context(hits, 60), "rank", "used") == [(1, 10), (2, 30), (3, 60)]


def test_answer_takes_a_function(spark):
    df = spark.createDataFrame([("red car", "A dog. The red car stops. End"), (None, "One. Two"), ("x", None), ("a b", "b x. a b. a b c")], "question string, context string")
    assert [r["answer"] for r in qa.answer(df).collect()] == ["The red car stops", "One", "", "a b"]
    assert qa.answer(df, lambda q, c: F.upper(q)).first()["answer"] == "RED CAR"


def test_range_join_at_the_bounds(spark):
    points = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (25.0,)], "x double")
    ranges = spark.createDataFrame([(0.0, 10.0, "a"), (10.0, 25.0, "b")], "lo double, hi double, name string")
    assert pairs(temporal.range_join(points, ranges, "x", "lo", "hi", 3.0), "x", "name") == [(0.0, "a"), (9.99, "a"), (10.0, "b")]


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(1, "en"), (2, "fr"), (3, "en")], "doc_id long, lang string")
    save(df, str(tmp_path / "t.parquet"), ["lang"])
    back = load(spark, str(tmp_path), "t")
    assert pairs(back.where("lang = 'en'"), "doc_id") == [(1,), (3,)]


def test_filter_and_columns_reach_the_scan(spark, sf, monkeypatch):
    """In the only plan that reads the documents, once."""
    plans, keep = [], lexical.materialized
    monkeypatch.setattr(lexical, "materialized", lambda df: plans.append(df._jdf.queryExecution().toString()) or keep(df))
    last = lexical.filtered_retrieval(spark.createDataFrame([(1, "a")], "question_id long, text string"), load(spark, sf, "documents"), lang="fr")
    (plan,) = [x for x in [*plans, last._jdf.queryExecution().toString()] if "documents.parquet" in x]
    physical = plan.split("== Physical Plan ==")[1]
    assert "EqualTo(lang,fr)" in plan and "n_chars" not in physical and physical.count("documents.parquet") == 1


def test_chunk_cooccurrence_at_any_distance(spark):
    docs = spark.createDataFrame([(1, "a b c d a e"), (2, "e A"), (3, None), (4, "x" + " " * 400 + "y" + " " * 200 + "z")], "doc_id long, text string")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.edges_chunk_cooccur(docs).collect()}
    first = {(a, b): 1 for i, a in enumerate("abcde") for b in "abcde"[i + 1 :]}
    assert got == first | {("a", "e"): 2, ("x", "y"): 1, ("y", "z"): 1}


def test_triangles_of_every_turn(spark, tmp_path):
    """The triangle stands in the turn whose text sorts last, and no edge joins two turns."""
    rows = [(1, 0, "user", "a b"), (1, 1, "assistant", "x y z"), (1, 2, "user", "b c"), (2, 0, "user", "c a")]
    save(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), str(tmp_path / "conversations.parquet"))
    assert graphs.triangle_count(spark, str(tmp_path)).first()["triangles"] == 2


def test_triangles_by_colours(spark):
    """As many as all triples give, with one task and with many, with loops, repeats, both directions and a hub."""
    r = np.random.default_rng(1)
    ends = [(int(x), int(y)) for x, y in r.integers(0, 60, (500, 2))] + [(0, i) for i in range(60)] + [(i, 0) for i in range(60)]
    linked = {frozenset(e) for e in ends if e[0] != e[1]}
    want = sum({frozenset((i, j)), frozenset((j, k)), frozenset((i, k))} <= linked for i in range(60) for j in range(i) for k in range(j))
    df = spark.createDataFrame([(f"n{x}", f"n{y}") for x, y in ends] + [(None, "n1"), ("n2", None)], "src string, dst string")
    for size in (1_000_000, 200, 40):
        assert graph.triangles(df, size).first()["triangles"] == want


def test_cooccurrence_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b"), (3, None), (4, "")], "doc_id long, text string")
    assert pairs(graph.edges_cooccur(docs), "src", "dst", "weight") == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_broken_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, None), (5, [1.0, None]), (6, [inf, 0.0]), (None, [1.0, 1.0]), (7, [9.0])], "vec_id long, embedding array<double>")
    assert pairs(vector.knn(v, v, 5), "query_id", "rank", "vec_id") == [(1, 1, 2), (2, 1, 1)]
    assert pairs(vector.range_search(v, v, -9), "query_id", "vec_id") == [(1, 2), (2, 1)]
    assert pairs(vector.ann(v, v, 5, width=2), "query_id", "vec_id") in ([(1, 2), (2, 1)], [])
    assert pairs(vector.centroid(v.where("vec_id < 6").withColumn("label", F.lit(1))), "label", "centroid") == [(1, [0.75, 0.25])]


def test_khop_of_groups(spark, edges):
    seeds = spark.createDataFrame([(1, "a"), (2, "d"), (2, "f"), (3, None), (3, "nowhere")], "question_id long, node string")
    assert pairs(qa.graph_expand(seeds, edges, 1), "question_id", "node", "hop") == [(1, "a", 0), (1, "b", 1), (1, "c", 1), (2, "c", 1), (2, "d", 0), (2, "e", 1), (2, "f", 0), (3, "nowhere", 0)]


def test_community_summary_by_hand(spark):
    labels = spark.createDataFrame([("p1", "p1"), ("p2", "p1"), ("l", "p1"), ("q", "q")], "node string, community string")
    ends = spark.createDataFrame([("p1", "l"), ("p2", "l"), ("q", "l")], "src string, dst string")
    texts = spark.createDataFrame([("p1", 1, "x y"), ("p2", 2, "y z z z y"), ("q", 3, None)], "node string, doc_id long, text string")
    rows = {r["community"]: r for r in graph.community_summary(labels, ends, texts, top=2).collect()}
    assert (rows["p1"]["size"], rows["p1"]["top_nodes"], rows["p1"]["top_terms"], rows["p1"]["representative"]) == (3, "l,p1", "y,z,x", "x y")
    assert (rows["q"]["size"], rows["q"]["top_terms"], rows["q"]["representative"]) == (1, None, None)


def test_bm25_of_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a A"), (8, None), (9, "zzz")], "question_id long, text string")
    got = lexical.bm25_topk(asked, docs).collect()
    idf, avg = math.log(1 + 2.5 / 2.5), 1.5
    want = [(7, 1, 1, round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / avg)), 6)), (7, 2, 4, round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg)), 6))]
    assert sorted(tuple(r) for r in got) == want


def test_documents_are_scanned_once_for_scores(spark, sf):
    """One scan writes what is kept; the scores read that and never the documents."""
    docs = load(spark, sf, "documents")
    plan = lexical.bm25_topk(spark.createDataFrame([(1, "a")], "question_id long, text string"), docs)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_scratch_must_be_shared_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *x: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        sizes.scratch(far)


def test_a_stream_reads_its_own_table_only(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    save(df, str(tmp_path / "conversations.parquet"))
    save(df, str(tmp_path / "conversations.parquet_old"))
    assert drained(stream(spark, str(tmp_path), "conversations")).count() == 1
