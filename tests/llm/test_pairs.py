"""Near-duplicates, top-k search and URL filter against brute force and SQL."""

import math
import os
import re
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import same_as_sql
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, counted, documents, no_docs, odd_docs, same_rows_left, tables_of, with_clashes  # noqa: E402

from tessera.llm import op06_dual_tree, op07_urls, op09_near_dups, registry  # noqa: E402


# 9: near-duplicates


def weights_of(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    n = max(1, len(words) - 4) if words else 0
    return {s: 1 + math.log(k) for s, k in Counter(tuple(words[i : i + 5]) for i in range(n)).items()}


def similarity(x, y):
    """Probability Jaccard from its definition."""
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def classes(pairs, threshold=0.8):
    """doc_id: smallest doc_id of its class; all pairs that share a shingle are compared."""
    found, by_shingle = [weights_of(t or "") for _, t in pairs], defaultdict(set)
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, w in enumerate(found):
        for s in w:
            by_shingle[s].add(i)
        if not w:
            by_shingle["no words", pairs[i][1] or ""].add(i)
    met = {(min(a, b), max(a, b)) for g in by_shingle.values() for a in g for b in g if a != b}
    for a, b in met:
        if root(a) != root(b) and (not found[a] or found[a] == found[b] or similarity(found[a], found[b]) >= threshold):
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(pairs):
        groups[root(i)].append(doc_id)
    first = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return counted((doc_id, first[root(i)]) for i, (doc_id, _) in enumerate(pairs)), len(groups)


def check_classes(df, pairs):
    rows = df.select("doc_id", "class_id", "keep").collect()
    want, n = classes(pairs)
    assert counted((r["doc_id"], r["class_id"]) for r in rows) == want
    assert sum(r["keep"] for r in rows) == n and all(r["doc_id"] == r["class_id"] for r in rows if r["keep"])


def test_classes_of_all_documents(spark, sf):
    docs = documents(spark, sf)
    check_classes(registry.queries()["op9_near_duplicates"](spark, sf), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_classes_of_odd_rows(spark):
    check_classes(op09_near_dups.near_duplicate_rows(odd_docs(spark)), [x for x in ODD if x[0] != 8] + [(8, ODD[9][1])])
    assert op09_near_dups.near_duplicate_rows(no_docs(spark)).count() == 0
    kept = op09_near_dups.one_of_each(odd_docs(spark))
    assert same_rows_left(kept, odd_docs(spark)) and Counter(r["doc_id"] for r in kept.collect())[4] == 1
    assert kept.count() == classes(ODD)[1]


def planted(seed, n_groups=12, size=14):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(n_groups):
        base = list(r.choice(vocabulary, 120))
        for k in range(size):
            text = base.copy()
            for at in r.integers(0, 120, k % 4):
                text[at] = "x%d" % r.integers(1 << 30)
            rows.append((len(rows), " ".join(text)))
    return rows + [(len(rows) + i, "alone " + " ".join(r.choice(vocabulary, 60))) for i in range(20)]


def test_near_copies_and_blocks(spark, monkeypatch):
    pairs = planted(5)
    monkeypatch.setattr(op09_near_dups, "BLOCK", 4)  # so that buckets are cut into several blocks
    monkeypatch.setattr(op09_near_dups, "PIVOT_PAIRS", 3)  # and pivots are copied
    check_classes(op09_near_dups.near_duplicate_rows(odd_docs(spark, pairs)), pairs)


def test_a_large_group_of_copies(spark):
    pairs = [(i, "many copies of this one text stand in the table at once" + " ." * (i % 3)) for i in range(3000)] + [(5000, "and one that differs from all of the others here")]
    rows = op09_near_dups.near_duplicate_rows(odd_docs(spark, pairs)).collect()
    assert counted((r["class_id"], r["keep"]) for r in rows) == Counter({(0, False): 2999, (0, True): 1, (5000, True): 1})


def test_signatures_agree_as_often_as_the_similarity_says():
    a, b = (np.arange(x, x + 60, dtype=np.uint32) * 77 for x in (0, 20))
    r = np.random.default_rng(2)
    wa, wb = 1 + r.exponential(1, 60), 1 + r.exponential(1, 60)
    sign = op09_near_dups.prob_min_hash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], 60), 2, 8192)
    want = similarity(dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True)))
    assert abs((sign[0] == sign[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 8192)


def test_similarity_of_lists():
    r = np.random.default_rng(3)
    for _ in range(30):
        a, b = (np.sort(r.integers(0, 12, r.integers(1, 25))).astype(np.uint32) for _ in range(2))
        weigh = lambda x: {k: 1 + math.log(n) for k, n in Counter(x.tolist()).items()}
        assert abs(op09_near_dups.probability_jaccard(a, b) - similarity(weigh(a), weigh(b))) < 1e-9


# 6: top-k


def brute_top_k(rows, k, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, own) in enumerate(good):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for m, (i, v) in enumerate(good) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return counted(out)


def test_top_k_same_as_sql(spark, sf, duck):
    same_as_sql(registry.queries()["op6_dual_tree_top_k"](spark, sf), duck, registry.oracle_sql()["op6_dual_tree_top_k"])


def test_repeated_ids_same_as_sql(spark, sf, tmp_path):
    """Each row of a repeated id is a query and a candidate, with its own vector."""
    import duckdb

    some = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 60")
    again = some.where("vec_id in (5, 40)").select("vec_id", F.reverse("embedding").alias("embedding"), "label").unionAll(some.where("vec_id in (40, 7)"))
    path = tables_of(tmp_path, embeddings=some.unionAll(again).coalesce(1))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    same_as_sql(registry.queries()["op6_dual_tree_top_k"](spark, path), con, registry.oracle_sql()["op6_dual_tree_top_k"])


def test_top_k_of_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (20, [1.0]), (21, []), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (None, [1.0, 1.0]), (7, [-1.0, -0.01]), (7, [-1.0, 9.0]), (0, [1.0, 0.5]), (40, [0.0, 0.0])]
    vectors = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    for k in (3, 20):
        assert counted(op06_dual_tree.top_k(vectors, F.col("vec_id") % 20 == 0, k).collect()) == brute_top_k(rows, k)
    assert op06_dual_tree.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0


def test_top_k_over_many_blocks_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(op06_dual_tree, "BLOCK", 40)
    monkeypatch.setattr(op06_dual_tree, "GROUP", 6)
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (6, 8))
    rows = [(i, (centres[0] if i % 3 == 0 else centres[i % 6] + r.normal(0, 0.05, 8)).tolist()) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert counted(op06_dual_tree.top_k(vectors, F.col("vec_id") % 20 == 0, 20).collect()) == brute_top_k(rows, 20)


def test_crowded_cells_are_split_around_their_own_pivots(spark, monkeypatch):
    """Clusters within a cluster end up in different cells, and groups search few of the blocks."""
    for name, value in (("BLOCK", 40), ("GROUP", 20), ("PIVOTS", 4), ("CELL_SAMPLE", 64)):
        monkeypatch.setattr(op06_dual_tree, name, value)
    r = np.random.default_rng(6)
    near = [np.eye(8)[i % 3] * 50 + r.normal(0, 2, 8) for i in range(12)]
    rows = [(i, (near[i % 12] + r.normal(0, 0.02, 8)).tolist()) for i in range(960)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    searched, keep = [], op06_dual_tree.search
    monkeypatch.setattr(op06_dual_tree, "search", lambda pairs, groups, blocks, k: searched.append((pairs.count(), groups.count() * blocks.count())) or keep(pairs, groups, blocks, k))
    assert counted(op06_dual_tree.top_k(vectors, F.col("vec_id") % 20 == 0, 20).collect()) == brute_top_k(rows, 20)
    assert sum(n for n, _ in searched) < 0.5 * searched[0][1], searched
    placed = op06_dual_tree.split_cells(op06_dual_tree.in_cells(op06_dual_tree.integer_vectors(vectors, 64, "vec_id", "embedding"), np.zeros((1, 8))), 8, 40)
    cells = defaultdict(set)
    for x in placed.collect():
        cells[x["cell"]].add(x["vec_id"] % 12)
    assert len(cells) >= 12 and sum(len(c) == 1 for c in cells.values()) >= 0.8 * len(cells)


@pytest.mark.parametrize("spread,share", [(0.01, 0.2), (1.0, 0.9)])
def test_dual_search_is_exact_and_prunes(spread, share):
    r = np.random.default_rng(7)
    centres = r.normal(0, 10, (12, 6))
    points = np.floor(64 * (centres[r.integers(0, 12, 3000)] + r.normal(0, spread, (3000, 6))))
    ids = r.permutation(3000)
    data, queries = op06_dual_tree.CoverTree(ids, points), op06_dual_tree.CoverTree(ids[:200], points[:200])
    met = []
    q, d, s = op06_dual_tree.dual_search(queries, data, 10, met=met)
    assert sum(met) < share * 200 * 3000
    scores = points[:200] @ points.T
    for i in range(200):
        order = sorted((-x, j) for x, j in zip(scores[i], ids, strict=True) if j != ids[i])[:10]
        assert [(-x, y) for x, y in zip(s[q == ids[i]], d[q == ids[i]], strict=True)] == order


# 7: URLs


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((len(h + p), action, h + p) for action, h, p in op07_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_urls_same_as_sql(spark, sf, duck):
    same_as_sql(registry.queries()["op7_url_filter"](spark, sf), duck, registry.oracle_sql()["op7_url_filter"])


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/x?y#z", "http://www.example.com/en/", "HTTPS://a.b.www.example.com/en/q", "x://notexample.com/en/", "http://example.com", "http://example.com?/en/", "http://example.com#/en/", "ftp://h.net/es/", "http://h.net/fr/a://b.com/", "http://net/es/x", "http://.com/", "http://com/", "http://É.com/Ä", "http://a..com/x", "http://example.com:80/en/", "http://example.com/en", "http://a.com\n/b"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[4]), (3, urls[4]), (None, urls[5]), (99, "http://" + "a." * 300 + "com/" + "y" * 5000)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string")).withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "action", "prefix", "full")})
    rules = op07_urls.rule_table(spark)
    assert counted(op07_urls.judge_urls(pages, rules).collect()) == counted((i, *judge(u)) for i, u in rows)
    assert op07_urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in op07_urls.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_very_long_urls(spark):
    """Linear in a host's labels and a path's length: these took minutes when all suffixes were made."""
    rows = [(1, "http://" + "a." * 16_000 + "example.com/en/" + "y" * 100_000), (2, "x://" + "." * 30_000 + "net/fr/"), (3, "http://" + "b" * 200_000 + "/es/" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    began = time.perf_counter()
    assert counted(op07_urls.judge_urls(pages, op07_urls.rule_table(spark)).collect()) == counted((i, *judge(u)) for i, u in rows)
    assert time.perf_counter() - began < 20


def test_many_rules_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(op07_urls, "BROADCAST_RULES", 2)
    rows = [(1, "http://example.com/en/"), (2, "http://x.net/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert counted(op07_urls.judge_urls(pages, op07_urls.rule_table(spark)).collect()) == counted((i, *judge(u)) for i, u in rows)
