"""Graphs as edge tables (src, dst); iterations are joins, with each round's table written and read back.

Rows with a null end are no edges, repeated edges count once and loops not at all (but in ``pagerank``,
which keeps loops as arcs). Labels of a hub's neighbours are summed up before they are sent on; the
joins at a hub are plain inner joins, whose large partitions Spark's adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from .pairs import counted_pairs, pairs_nearby, pairs_within
from .sizes import materialized, small, spread
from .text import chunk, links
from .vector import knn


#: Edges of a task that counts triangles, about.
EDGES_A_TASK = 1_000_000
#: Terms whose frequencies go to all tasks, at most.
MOST_FREQUENT = 50_000


def edges_pages(pages: DataFrame) -> DataFrame:
    """Pages and what they link to, as a two-sided graph: src ``p`` + page_id, dst ``l`` + link.

    Pages that share a target are two hops apart; their pairs are never written out."""
    return links(pages).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.concat(F.lit("l"), "link").alias("dst")).distinct()


def edges_knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    return knn(queries, vectors, k).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("score").alias("weight"))


def edges_cooccur(docs: DataFrame, reach: int = 2) -> DataFrame:
    """Terms up to ``reach`` words apart in a text; weight counts the meetings. Linear in the text.

    Pairs are counted in slices of rows; packed lists of counts are shuffled, about a fifth of a pair for each character and step."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    found = spread(docs.select("text")).select(F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("t"))
    return counted_pairs(found, pairs_nearby(reach), lambda n: n * reach, chars * reach / 10)


def edges_chunk_cooccur(docs: DataFrame, size: int = 500, stride: int = 400) -> DataFrame:
    """Terms of one chunk, however far apart; weight counts the chunks they share.

    A chunk's length bounds its pairs. Its terms are shuffled, not its pairs, and the pairs of two parts of the terms are counted by the task that gives them:
    about a term for each five characters of a chunk."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    found = chunk(spread(docs.select("doc_id", "text")), size, stride).select(terms(F.col("text")).alias("t"))
    return pairs_within(found, chars * size / stride / 5)


def both_ways(edges: DataFrame) -> DataFrame:
    one = edges.select("src", "dst").where("src != dst")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def khop(edges: DataFrame, seeds: DataFrame, hops: int, by: Sequence[str] = ()) -> DataFrame:
    """node, hop: nodes within ``hops`` steps of a seed, with the least number of steps; with ``by``, of each group of seeds by itself."""
    keys = [*by, "node"]
    steps = materialized(both_ways(edges))
    reached = materialized(seeds.select(*keys).where(F.col("node").isNotNull()).distinct().withColumn("hop", F.lit(0)))
    front = reached
    for hop in range(1, hops + 1):
        near = steps.join(small(front.select(*by, F.col("node").alias("at"))), F.col("src") == F.col("at")).select(*by, F.col("dst").alias("node")).distinct()
        front = materialized(near.join(reached, keys, "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(front)
    return reached


def khop_recursive(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hop as ``khop`` gives, by one recursive query instead of a loop.

    A level has each node once, however many walks lead to it, so rows grow as nodes x hops (100 hops at most). Spark's
    bound on the rows of a recursion (spark.sql.cteRecursionRowLimit) is raised to that number where it is lower,
    for this query only, whose result is stored."""
    if not 0 <= hops <= 100:
        raise ValueError("a recursion has at most 100 levels")
    spark, bound = edges.sparkSession, "spark.sql.cteRecursionRowLimit"
    steps = materialized(both_ways(edges))
    starts = materialized(seeds.select("node").where(F.col("node").isNotNull()).distinct())
    walked = spark.sql(
        "WITH RECURSIVE walk(node, hop) AS (SELECT node, 0 FROM {starts} UNION ALL SELECT DISTINCT s.dst, w.hop + 1 FROM walk w JOIN {steps} s ON s.src = w.node WHERE w.hop < {hops}) SELECT node, min(hop) AS hop FROM walk GROUP BY node",
        starts=starts, steps=steps, hops=hops,
    )
    before = spark.conf.get(bound)
    most = (starts.count() + steps.select("src").distinct().count()) * (hops + 1)
    try:
        if 0 <= int(before) < most:
            spark.conf.set(bound, most)
        return materialized(walked)
    finally:
        spark.conf.set(bound, before)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of each connected component.

    Labels pass along edges and then jump to their own labels, so long chains take few rounds."""
    steps = materialized(both_ways(edges))
    labels = materialized(steps.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = steps.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("src")).select("node", "component", F.least("component", "near").alias("up"))
        jumps = hooked.select(F.col("node").alias("at"), F.col("up").alias("jump"))
        moved = materialized(hooked.join(jumps, F.col("up") == F.col("at")).select("node", F.col("jump").alias("component"), (F.col("jump") != F.col("component")).alias("moved")))
        labels = moved.select("node", "component")
        if not moved.where("moved").limit(1).count():
            return labels


def pagerank(edges: DataFrame, iterations: int = 5, damping: float = 0.85) -> DataFrame:
    """node, rank from a uniform start; the rank of nodes without successors is spread over all."""
    arcs = edges.select("src", "dst").distinct()
    nodes = materialized(arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct())
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    arcs = materialized(arcs.join(out, "src"))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ends = nodes.join(out, nodes.node == out.src, "left_anti").withColumn("ends", F.lit(True))
    ranks = materialized(nodes.join(ends, "node", "left").select("node", F.coalesce("ends", F.lit(False)).alias("ends"), F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        lost = ranks.where("ends").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("s")).first()["s"]
        given = arcs.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))
        ranks = materialized(ranks.join(given, F.col("node") == F.col("dst"), "left").select("node", "ends", new.alias("rank")))
    return ranks.select("node", F.round("rank", 9).alias("rank"))


def communities(edges: DataFrame, iterations: int = 3) -> DataFrame:
    """node, community by synchronous label propagation: the most frequent label around, ties to the smallest."""
    steps = materialized(both_ways(edges))
    labels = steps.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(iterations):
        votes = steps.join(labels, F.col("dst") == F.col("node")).groupBy("src", "community").agg(F.count("*").alias("n"))
        # the largest count, then the smallest label, while aggregating
        labels = materialized(votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("top")).select("node", F.col("top.community").alias("community")))
    return labels


def triangles(edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """One row, the number of triangles.

    Nodes are numbered, so that what is copied is numbers and no names. They get one of b colours by their number, and an edge goes to the b multisets of three colours
    that hold its own two. All edges of a triangle meet in the multiset of its colours and nowhere
    else, where they are counted within the task by intersecting lists of neighbours; wedges are never
    rows. So b copies of each edge are shuffled, and b is chosen so that a task has about
    ``edges_a_task`` edges, even those of the largest hub."""
    one = materialized(edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    ends = one.select(F.col("a").alias("node")).unionAll(one.select("b"))
    nodes = materialized(ends.groupBy("node").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    size = nodes.agg(F.coalesce(F.sum("n") / 2, F.lit(0)).alias("m"), F.coalesce(F.max("n"), F.lit(0)).alias("hub")).first()
    colours = max(1, math.ceil(math.sqrt(6 * size["m"] / edges_a_task)), math.ceil(2 * size["hub"] / edges_a_task))
    ids = small(nodes.select("node", "id"))
    numbered = one.join(ids, F.col("a") == F.col("node")).select(F.col("id").alias("x"), "b").join(ids, F.col("b") == F.col("node")).select(F.col("x").alias("a"), F.col("id").alias("b"))
    colour = lambda c: F.pmod(c, F.lit(colours))
    dealt = numbered.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(colours - 1).cast("long"))).alias("c"))
    t = F.array_sort(F.array(colour("a"), colour("b"), "c"))
    dealt = dealt.select("a", "b", t.alias("t")).select("a", "b", ((F.col("t")[0] * colours + F.col("t")[1]) * colours + F.col("t")[2]).alias("cell"))

    def run(key: tuple, met: pa.Table) -> pa.Table:
        a, b = (met.column(c).combine_chunks() for c in ("a", "b"))
        first, last = divmod(key[0].as_py(), colours)
        n = count_triangles(a, b, a.to_numpy() % colours, b.to_numpy() % colours, [*divmod(first, colours), last])
        return pa.table({"n": pa.array([n], pa.int64())})

    return dealt.groupBy("cell").applyInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("triangles"))


def count_triangles(a: pa.Array, b: pa.Array, colour_a: np.ndarray, colour_b: np.ndarray, wanted: list[int], at_once: int = 1 << 21) -> int:
    """Triangles among the edges a[i], b[i] whose nodes have just the wanted colours. ``at_once`` bounds what is held beside the edges."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    ids, n, m = both.indices.to_numpy().astype(np.int64), len(both.dictionary), len(a)
    colours = np.empty(n, np.int64)
    colours[ids[:m]], colours[ids[m:]] = colour_a, colour_b
    # nodes by degree, edges from the lower to the higher: lists of neighbours stay short at hubs
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.bincount(ids, minlength=n), kind="stable")] = np.arange(n)
    colours = colours[np.argsort(rank)]
    ends = np.sort(rank[ids].reshape(2, m), axis=0)
    keys = np.sort(ends[0] * n + ends[1])
    u, v = keys // n, keys % n
    first, size = np.searchsorted(u, np.arange(n)), np.bincount(u, minlength=n)
    swap = size[v] > size[u]  # the shorter list is gone through, the other one looked up
    short, other = np.where(swap, u, v), np.where(swap, v, u)
    steps = np.cumsum(size[short])
    total, at, wanted = 0, 0, sorted(wanted)
    while at < m:
        stop = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + at_once, "right")))
        n_of = size[short[at:stop]]
        edge = np.repeat(np.arange(at, stop), n_of)
        w = v[np.repeat(first[short[at:stop]] - (np.cumsum(n_of) - n_of), n_of) + np.arange(len(edge))]
        sought = other[edge] * n + w
        spot = np.minimum(np.searchsorted(keys, sought), m - 1)
        found = keys[spot] == sought
        edge, w = edge[found], w[found]
        total += int((np.sort(np.stack([colours[u[edge]], colours[v[edge]], colours[w]]), axis=0) == np.array(wanted)[:, None]).all(axis=0).sum())
        at = stop
    return total


def _counts_by_row(t: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of terms: the different terms, and rows in order with each term's place among these and how often the row has it."""
    coded = t.flatten().dictionary_encode()
    n, sizes = max(1, len(coded.dictionary)), np.diff(t.offsets.to_numpy())
    key, tf = np.unique(np.repeat(np.arange(len(t)), sizes) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return coded.dictionary, *np.divmod(key, n), tf


def entities(docs: DataFrame, top: int = 3, size: int = 500, stride: int = 400) -> DataFrame:
    """Stand-in for a model's entity extraction: the ``top`` terms of each chunk by tf-idf over chunks.

    Terms are counted within the chunk's row, for a batch of chunks at once. Frequencies of at most ``MOST_FREQUENT`` terms, the most frequent, go to all tasks;
    any other term has one between 1 and the least of these, so its weight is known within bounds, and a term that can't
    be among the ``top`` of its chunk is left out before anything is shuffled. The few left are joined with their
    frequencies. Chunks of a doc_id that comes again are one, as their postings would be."""
    pieces = chunk(spread(docs.select("doc_id", "text")), size, stride)
    found = pieces.select("doc_id", "chunk_no", terms(F.col("text")).alias("t")).where("size(t) > 0")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    if again.limit(1).count():  # doc_ids are seldom repeated; null ones are left as they are
        found = found.groupBy("doc_id", "chunk_no").agg(F.flatten(F.collect_list("t")).alias("t"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, code, _ = _counts_by_row(batch.column("t"))
            df = np.append(np.bincount(code, minlength=len(names)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([names, pa.nulls(1, pa.string())]), pa.array(df, pa.int64())], names=["term", "df"])

    counted = materialized(found.select("t").mapInArrow(frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")))
    n = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]  # the row without a term counts chunks
    df = counted.where("term is not null")
    frequent = df.orderBy(F.desc("df"), "term").limit(MOST_FREQUENT).collect()
    known = {r["term"]: math.log(n / r["df"]) for r in frequent}
    rest = frequent[-1]["df"] if len(frequent) == MOST_FREQUENT else 1  # of any other term at most
    low, high = math.log(n / rest) if n else 0.0, math.log(n) if n else 0.0
    shared = found.sparkSession.sparkContext.broadcast(known)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "t") + ", term string, tf long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            names, row, code, tf = _counts_by_row(batch.column("t"))
            known_idf = [idf.get(w) for w in names.to_pylist()]
            lows = tf * np.array([low if x is None else x for x in known_idf], float)[code]
            highs = tf * np.array([high if x is None else x for x in known_idf], float)[code]
            order, sizes = np.lexsort((-lows, row)), np.bincount(row, minlength=batch.num_rows)
            more = sizes > top
            needed = np.full(batch.num_rows, -1.0)
            needed[more] = lows[order][(np.cumsum(sizes) - sizes)[more] + top - 1] - 2e-6  # weights are rounded to six places
            held = highs >= needed[row]
            at, kept, counts = pa.array(row[held]), names.take(pa.array(code[held])), pa.array(tf[held], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("chunk_no").take(at), kept, counts], names=["doc_id", "chunk_no", "term", "tf"])

    few = found.mapInArrow(run, ddl)
    scored = few.join(df, "term").select("doc_id", "chunk_no", "term", F.round(F.col("tf") * F.log(F.lit(n) / F.col("df").cast("double")), 6).alias("weight"))
    order = Window.partitionBy("doc_id", "chunk_no").orderBy(F.desc("weight"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk"), "term", "weight", "rank")


def entity_edges(found: DataFrame) -> DataFrame:
    """src, dst, weight: entities of one chunk, of which a chunk has a few; weight counts the chunks they share."""
    lists = found.groupBy("chunk").agg(F.array_sort(F.collect_set("term")).alias("t"))
    first = lists.select("t", F.posexplode("t").alias("i", "src"))
    return first.select("src", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def with_lone(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels, and each node without one as its own community."""
    return labels.unionByName(nodes.select("node").distinct().join(labels, "node", "left_anti").withColumn("community", F.col("node")))


def community_summary(labels: DataFrame, edges: DataFrame, texts: DataFrame, top: int = 3, top_terms: int = 5) -> DataFrame:
    """Stand-in for a model's summary of each community: its size, the ``top`` nodes by degree, the
    ``top_terms`` most frequent terms of its texts, and the chunk that holds most of these.

    ``texts`` has node, doc_id and text for the nodes that have one; a community without any has nulls.
    Ties go to the smaller node or term, and to the earlier chunk of the smaller doc_id."""
    ranked = labels.join(degree(edges), "node")
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    heads = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]), ",").alias("top_nodes"))
    told = materialized(labels.join(texts, "node").select("community", "doc_id", "text"))
    counts = told.select("community", F.explode(terms(F.col("text"))).alias("term")).groupBy("community", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("community").orderBy(F.desc("n"), "term")
    common = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_terms).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("common"))
    pieces = chunk(told.select(F.struct("community", "doc_id").alias("doc_id"), "text")).select("doc_id.community", "doc_id.doc_id", "chunk_no", "text").join(common, "community")
    shared = F.size(F.array_intersect("common", terms(F.col("text"))))
    first = pieces.groupBy("community").agg(F.min_by("text", F.struct(-shared, "doc_id", "chunk_no")).alias("representative"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.join(heads, "community").join(common.select("community", F.array_join("common", ",").alias("top_terms")), "community", "left").join(first, "community", "left")
