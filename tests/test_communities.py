"""Hierarchical communities by brute force, and answers from communities by hand."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import communities, graph, qa


def planted(seed, groups=6, size=8):
    """Dense groups in pairs, some weights, loops, repeats and null ends."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(groups * size):
        for j in range(i):
            near, pair = i // size == j // size, i // size // 2 == j // size // 2
            if r.random() < (0.7 if near else 0.12 if pair else 0.01):
                rows.append((f"n{i:02}", f"n{j:02}", int(r.integers(1, 3))))
    return rows + [("n00", "n00", 5), rows[0], (rows[1][1], rows[1][0], 1), ("x", "y", 1), (None, "x", 1), ("y", None, 2)]


def arcs(rows):
    w = Counter()
    for a, b, n in rows:
        if a is not None and b is not None and a != b:
            w[a, b] += n
            w[b, a] += n
    return w


def quality(w):
    k, inside, whole = Counter(), 0, sum(w.values())
    for (a, b), n in w.items():
        k[a] += n
        inside += n * (a == b)
    return inside / whole - sum(x * x for x in k.values()) / whole**2


def contracted(w, label):
    out = Counter()
    for (a, b), n in w.items():
        out[label[a], label[b]] += n
    return out


def brute(rows, levels=6, rounds=8):
    w = arcs(rows)
    whole, reached, number, out = sum(w.values()), quality(w), 0, []
    member = {a: a for a, _ in w}
    for level in range(levels):
        k, near = Counter(), defaultdict(Counter)
        for (a, b), n in w.items():
            k[a] += n
            near[a][b] += n * (a != b)
        label, still = {a: a for a in k}, 0
        for _ in range(rounds):
            number += 1
            tot = Counter()
            for a, c in label.items():
                tot[c] += k[a]
            new = dict(label)
            for a, own in label.items():
                if zlib.crc32(f"{a}#{number}".encode()) % 2 == 0:
                    to = Counter({own: 0.0})
                    for b, n in near[a].items():
                        to[label[b]] += n * (a != b)
                    gain = {c: n - k[a] * (tot[c] - (k[a] if c == own else 0.0)) / whole for c, n in to.items()}
                    best = min(gain, key=lambda c: (-gain[c], c))
                    if gain[best] > gain[own] + communities.LEAST_GAIN:
                        new[a] = best
            still = 0 if new != label else still + 1
            label = new
            if still == 2:
                break
        name = {}
        for a, c in label.items():
            name[c] = min(a, name.get(c, a))
        label = {a: name[c] for a, c in label.items()}
        w = contracted(w, label)
        if quality(w) <= reached + communities.LEAST_GAIN:
            break
        reached = quality(w)
        member = {a: label[c] for a, c in member.items()}
        out += [(a, c, level) for a, c in member.items()]
    return sorted(out or [(a, a, 0) for a in member])


def test_hierarchy_by_brute_force(spark):
    rows = planted(1)
    edges = spark.createDataFrame(rows, "src string, dst string, weight long")
    found = graph.materialized(communities.hierarchy(edges))
    want = brute(rows)
    assert sorted(tuple(r) for r in found.collect()) == want and max(x[2] for x in want) >= 1
    # levels nest, and the last is no worse than label propagation
    last = max(x[2] for x in want)
    by_level = [{a: c for a, c, at in want if at == level} for level in range(last + 1)]
    for fine, coarse in zip(by_level, by_level[1:], strict=False):
        assert len({(fine[a], coarse[a]) for a in fine}) == len(set(fine.values())) > len(set(coarse.values()))
    reached = communities.modularity(edges, found.where(F.col("level") == last))
    assert abs(reached - quality(contracted(arcs(rows), by_level[-1]))) < 1e-9
    assert reached >= communities.modularity(edges, graph.communities(edges)) - 1e-9


@pytest.mark.parametrize("few", [0, 40, 10_000])
def test_hierarchy_by_numbers_and_where_few_are_left(spark, few):
    rows = planted(3, groups=5) + [("é", "ß", 1), ("lone", "pair", 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight long")
    assert sorted(tuple(r) for r in communities.hierarchy(edges, few=few).collect()) == brute(rows)
    bits, last = communities._turn(17)
    for name in ("a", "é", "n01", ""):
        assert (zlib.crc32(f"{name}#17".encode()) & 1) == ((zlib.crc32(name.encode()) & bits).bit_count() + last) % 2


def test_hierarchy_without_gain(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert communities.hierarchy(none).count() == 0 and communities.modularity(none, communities.hierarchy(none)) == 0
    pair = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert {r["community"] for r in communities.hierarchy(pair).collect()} == {"a"}


@pytest.fixture
def entities(spark):
    rows = [("1#0", "sun", 4.0), ("1#0", "star", 2.0), ("2#0", "moon", 3.0), ("2#0", "star", 1.0), ("3#0", "fish", 5.0)]
    return spark.createDataFrame(rows, "chunk string, term string, weight double")


def test_entity_graph_by_hand(spark, entities):
    edges = graph.entity_edges(entities)
    assert sorted(tuple(r) for r in edges.collect()) == [("moon", "star", 1), ("star", "sun", 1)]
    labels = graph.with_lone(graph.communities(edges), entities.select(F.col("term").alias("node")))
    assert {r["node"]: r["community"] for r in labels.collect()}["fish"] == "fish"


def test_community_answers_by_hand(spark, entities):
    labels = spark.createDataFrame([("sun", "sky"), ("star", "sky"), ("moon", "sky"), ("fish", "fish")], "node string, community string")
    pieces = spark.createDataFrame([("1#0", "The sun is a star. It is hot"), ("2#0", "A moon is no star"), ("3#0", "Fish swim. Big fish eat fish")], "chunk string, text string")
    reports = qa.community_reports(entities, labels, pieces, each=2)
    assert {r["community"]: r["report"] for r in reports.collect()} == {"sky": "The sun is a star. It is hot\nA moon is no star", "fish": "Fish swim. Big fish eat fish"}
    asked = spark.createDataFrame([(1, "is the SUN hot"), (2, "do big fish eat the moon"), (3, "nothing here"), (4, None), (5, "star")], "question_id long, text string")
    got = {r["question_id"]: tuple(r)[1:] for r in qa.community_answers(asked, entities, labels, reports).collect()}
    assert got == {1: (1, "sky", "The sun is a star"), 2: (2, "fish", "Big fish eat fish"), 3: (0, None, None), 4: (0, None, None), 5: (1, "sky", "The sun is a star")}
    assert {r["question_id"]: r["communities"] for r in qa.community_answers(asked, entities, labels, reports, most=1).collect()}[2] == 1


def test_only_chosen_communities_are_reported(spark, entities):
    labels = spark.createDataFrame([("sun", "sky"), ("star", "sky"), ("moon", "sky"), ("fish", "fish")], "node string, community string")
    pieces = spark.createDataFrame([("1#0", "The sun is a star"), ("2#0", "A moon is no star"), ("3#0", "Fish swim")], "chunk string, text string")
    asked = spark.createDataFrame([(1, "is the SUN hot"), (2, "nothing here")], "question_id long, text string")
    chosen = qa.chosen_communities(asked, entities, labels)
    assert [tuple(r) for r in chosen.collect()] == [(1, "sky", 4.0, 1)]
    reports = qa.community_reports(entities, qa.asked_labels(labels, chosen), pieces)
    assert {r["community"] for r in reports.collect()} == {"sky"}
    whole = qa.community_answers(asked, entities, labels, qa.community_reports(entities, labels, pieces))
    assert sorted(map(str, qa.community_answers(asked, entities, labels, reports, chosen=chosen).collect())) == sorted(map(str, whole.collect()))


def test_chunks_of_long_documents_fit(spark):
    docs = spark.createDataFrame([(1, "x " * 3000 + "needle in it " + "y " * 3000), (2, "needle"), (3, None)], "doc_id long, text string")
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "question_id long, rank int, doc_id long")
    asked = spark.createDataFrame([(7, "needle"), (8, "x")], "question_id long, text string")
    rows = sorted(tuple(r) for r in qa.best_chunks(hits, asked, docs, 2).select("rank", "doc_id", "chunk_no", F.contains("text", F.lit("needle")).alias("has")).collect())
    assert rows == [(1, 1, 14, True), (2, 1, 0, False), (3, 2, 0, True)] or rows[0][3] and rows[-1] == (3, 2, 0, True)
