"""Counts of pairs by brute force, in one slice and many, one cell and many."""

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import graph, pairs


def texts(seed, n=40):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)] + ["é", "ß", "日本", "Z"]
    return [" ".join(words[i] for i in r.integers(0, len(words), int(r.integers(0, 25)))) for _ in range(n)] + ["", None, "one", "one one"]


@pytest.mark.parametrize("at_once, cell", [(1 << 24, 1 << 23), (50, 100)])
def test_chunk_pairs_by_brute_force(spark, monkeypatch, at_once, cell):
    monkeypatch.setattr(pairs, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(pairs, "CELL", cell)
    rows = texts(1)
    found = graph.edges_chunk_cooccur(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), size=500, stride=400)
    want = Counter(p for t in rows for p in combinations(sorted({w.lower() for w in (t or "").split()}, key=str.encode), 2))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_no_pair_is_a_row_before_its_last_count(spark):
    plan = graph.edges_chunk_cooccur(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert plan.count("Generate explode") == plan.count("sequence(0") and "posexplode" not in plan


def test_pairs_nearby_and_numbers():
    code, row = np.array([2, 0, 2, 2, 1]), np.array([0, 0, 0, 1, 1])
    assert Counter(pairs.pairs_nearby(2)(code, row, 3).tolist()) == {2: 2, 5: 1}
    for x in ([0], [255, 256, 3], [1 << 40, 7]):
        assert pairs.unpacked_numbers(pairs.packed_numbers(np.array(x, np.int64)), len(x)).tolist() == x
    assert pairs.slice_lists(pa.array([[], []], pa.list_(pa.string())), pairs.pairs_of_row, 2) is None
    assert pairs.slice_lists(pa.array([["a"]]), pairs.pairs_of_row, 2) is None


@pytest.mark.parametrize("at_once, cell", [(1 << 24, 1 << 23), (20, 50)])
def test_neighbours_by_brute_force(spark, monkeypatch, at_once, cell):
    monkeypatch.setattr(pairs, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(pairs, "CELL", cell)
    want = Counter()
    for t in texts(2):
        words = (t or "").lower().split()
        want.update(tuple(sorted((a, b), key=str.encode)) for i, a in enumerate(words) for b in words[i + 1 : i + 3] if a != b)
    found = graph.edges_cooccur(spark.createDataFrame([(t,) for t in texts(2)], "text string"))
    assert "explode" not in found._jdf.queryExecution().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


@pytest.mark.parametrize("tile", [1 << 22, 30])
def test_pairs_of_parts_by_brute_force(spark, monkeypatch, tile):
    for name, value in (("TILE", tile), ("PART", 40), ("TERMS_AT_ONCE", 90)):
        monkeypatch.setattr(pairs, name, value)
    rows = [*texts(3, 60), *["a b", "b a"] * 5]  # either of two terms comes first in some slice
    found = graph.edges_chunk_cooccur(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))
    want = Counter(p for t in rows for p in combinations(sorted({w.lower() for w in (t or "").split()}, key=str.encode), 2))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_chunks_terms_are_shuffled_once_and_no_pairs(spark):
    found = graph.edges_chunk_cooccur(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("CartesianProduct") == 1 and plan.count("ReusedExchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert "counts" not in plan  # lists of pairs had them


def test_no_pairs_at_all(spark):
    assert graph.edges_chunk_cooccur(spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "doc_id long, text string")).collect() == []
    assert graph.edges_chunk_cooccur(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lists_of_a_cell_are_added_up_a_few_at_a_time(monkeypatch):
    """However many lists there are, a task decodes no more than ``LISTED`` pairs of them at once, or one list."""
    monkeypatch.setattr(pairs, "LISTED", 40)
    rows = [r for r in texts(5, 60) if r]
    lists = [pairs.slice_lists(pa.array([r.split() for r in rows[a : a + 4]]), pairs.pairs_nearby(2), 1).to_pylist()[0] for a in range(0, len(rows) - 3, 4)]
    met, add = [], pairs.Cell.add
    monkeypatch.setattr(pairs.Cell, "add", lambda self, some: met.append([r["n"] for r in some]) or add(self, some))
    got = Counter()
    for b in pairs.cell_counts(iter(lists)):
        for r in b.to_pylist():
            assert (r["src"], r["dst"]) not in got
            got[r["src"], r["dst"]] = r["weight"]
    want = Counter()
    for t in rows[: 4 * len(lists)]:
        words = t.split()
        want.update(tuple(sorted((a, b), key=str.encode)) for i, a in enumerate(words) for b in words[i + 1 : i + 3] if a != b)
    assert got == want
    assert len(met) > 2 and all(len(x) == 1 or sum(x) <= 40 for x in met)
