"""Exact top-k inner products by dual-tree search over cover trees.

Candidates are placed in cells around pivots (chosen from a bounded sample). A cell of more than
``BLOCK`` vectors is split around pivots of its own, and so on, so cells stay small and local however
many rows there are; only a cell of equal vectors is cut by a hash instead. Cells become blocks of
candidates and groups of about ``GROUP`` queries. Each block and group gets a cover tree: a node
covers its points with balls of half its radius around some of them, down to leaves. Query and data
trees are searched together. A pair of nodes is left out if even the largest inner product their
centres and radii allow, q.d + r_q |d| + r_d |q| + r_q r_d, stays below the worst k-th score of the
queries in the query node. Each group descends to the blocks with the largest bounds in the region (a
first-level cell) with the largest bound and searches as many as hold k rows, which gives every query
a k-th score to beat; then it meets the regions whose bound reaches the group's worst k-th score and, of their
blocks, those whose bound does, so the result is exact and pairs that bounds rule out are not
written anywhere. Pruning depends on the data: where all vectors are about equally far apart, it
leaves out little, and the work is that of comparing the queries with all rows, in blocks.

A block's tree goes once to each part of about ``PART`` groups that meet it.

Scores are exact up to 2**53. Defined results: vectors that are null or hold null or non-finite
components, and rows without an id, take no part; shorter vectors count as padded with zeros;
rows are told apart by a key of their own, so of rows that repeat an id each is a candidate, also for
the others, and each is a query with its own k rows; ties go to the smaller id; with fewer than k candidates
all are given; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_of, read, stored

BLOCK, GROUP = 4096, 256
LEAF, MOST_CHILDREN = 64, 64
PIVOTS, SAMPLE = 64, 2048
CELL_SAMPLE = 256  # rows, about, that a crowded cell's pivots are chosen from
LEVELS = 9  # 64 ** 9 cells; their codes fit a long
PART = 64  # groups that share one copy of a block's tree
REGION_BLOCKS = 256  # blocks of a region that share a join key


class CoverTree:
    """Points in tree order, with their ids and the keys of their rows; node i has points first[i] to
    stop[i], a centre, a radius and children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, keys: np.ndarray | None = None) -> None:
        self.order: list[np.ndarray] = []
        self.first, self.stop, self.radius, self.children, centres = [], [], [], [], []
        self.placed = 0
        root = points[0] if len(points) else np.zeros(points.shape[1])

        def add(at: np.ndarray, centre: np.ndarray, reach: float) -> int:
            away = np.sqrt(((points[at] - centre) ** 2).sum(axis=1))
            node, radius = len(self.first), float(away.max())
            self.first.append(self.placed)
            self.stop.append(0)
            self.radius.append(radius)
            self.children.append([])
            centres.append(centre)
            reach = min(reach, radius)
            if len(at) <= LEAF or radius == 0:
                self.order.append(at)
                self.placed += len(at)
            else:
                rest, half = at, reach / 2
                while len(rest):
                    if len(self.children[node]) == MOST_CHILDREN:  # too spread out for balls of half the radius
                        self.children[node].append(leaf(rest, centre))
                        break
                    one = points[rest[0]]
                    near = np.sqrt(((points[rest] - one) ** 2).sum(axis=1)) <= half
                    self.children[node].append(add(rest[near], one, half))
                    rest = rest[~near]
            self.stop[node] = self.placed
            return node

        def leaf(at: np.ndarray, centre: np.ndarray) -> int:
            away = np.sqrt(((points[at] - centre) ** 2).sum(axis=1))
            self.first.append(self.placed)
            self.order.append(at)
            self.placed += len(at)
            self.stop.append(self.placed)
            self.radius.append(float(away.max()))
            self.children.append([])
            centres.append(centre)
            return len(self.first) - 1

        if len(points):
            add(np.arange(len(points)), root, np.inf)
        order = np.concatenate(self.order) if self.order else np.empty(0, int)
        self.ids, self.keys, self.points = ids[order], (ids if keys is None else keys)[order], points[order]
        self.centres = np.array(centres).reshape(len(centres), points.shape[1])
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        del self.order, self.placed


def dual_search(queries: CoverTree, data: CoverTree, k: int, floor: np.ndarray | None = None, met: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query key, id, score) of the k best of ``data`` for each query, without what lies below ``floor``.

    ``met`` takes the number of pairs of points in each pair of leaves that was compared."""
    n = len(queries.ids)
    top = np.full((n, k), -np.inf)
    worst = np.full(n, -np.inf) if floor is None else floor.astype(float)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def bound(q: int, ds: np.ndarray) -> np.ndarray:
        rq, nq, rd = queries.radius[q], queries.norms[q], radius[ds]
        high = data.centres[ds] @ queries.centres[q] + rq * data.norms[ds] + rd * nq + rq * rd
        return high + 1e-9 * np.abs(high) + 1e-6

    radius, lengths = np.array(data.radius), np.sqrt((queries.points**2).sum(axis=1))
    waiting = [(0, 0)] if n and len(data.ids) else []
    while waiting:
        q, d = waiting.pop()
        a, z = queries.first[q], queries.stop[q]
        if bound(q, np.array([d]))[0] < worst[a:z].min():
            continue
        if queries.children[q] and (not data.children[d] or queries.radius[q] >= data.radius[d]):
            waiting += [(c, d) for c in queries.children[q]]
        elif data.children[d]:
            below = np.array(data.children[d])
            high = bound(q, below)
            # the most promising last, so that it comes off first
            waiting += [(q, int(c)) for c, h in sorted(zip(below, high, strict=True), key=lambda x: x[1]) if h >= worst[a:z].min()]
        else:
            b, y = data.first[d], data.stop[d]
            # of the leaf's queries, those that the data node can still serve
            high = queries.points[a:z] @ data.centres[d] + radius[d] * lengths[a:z]
            alive = a + np.flatnonzero(high + 1e-9 * np.abs(high) + 1e-6 >= worst[a:z])
            if not len(alive):
                continue
            if met is not None:
                met.append(len(alive) * (y - b))
            scores = queries.points[alive] @ data.points[b:y].T
            scores[queries.keys[alive, None] == data.keys[None, b:y]] = -np.inf
            row, col = np.nonzero((scores >= worst[alive, None]) & (scores > -np.inf))
            if not len(row):
                continue
            found.append((alive[row], data.ids[b + col], scores[row, col]))
            both = np.concatenate([top[alive], scores], axis=1)
            top[alive] = -np.partition(-both, k - 1, axis=1)[:, :k]
            worst[alive] = np.maximum(worst[alive], top[alive].min(axis=1))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    good = scores >= worst[row]
    row, ids, scores = row[good], ids[good], scores[good]
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    first = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - first < k
    return queries.keys[row[keep]], ids[keep], scores[keep]


def integer_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """row (unique), vec_id and v, floor(scale * x) of each component; stored, so that keys stay."""
    whole = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & whole)
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("double")).alias("v")), "vectors")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first points of the sample."""
    if not len(sample):
        return sample
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def nearest_pivot(column: pa.Array | pa.ChunkedArray, pivots: np.ndarray) -> np.ndarray:
    return (matrix(column, pivots.shape[1]) @ pivots.T - (pivots**2).sum(axis=1) / 2).argmax(axis=1)


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with the cell of the nearest pivot. A cell's code is PIVOTS times (its parent's + 1), plus its place."""
    ddl = "row long, vec_id long, v array<double>, cell long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(PIVOTS + nearest_pivot(b.column("v"), pivots))], schema=arrow_of(ddl))

    return rows.mapInArrow(run, ddl)


def split_cells(placed: DataFrame, width: int, most: int) -> DataFrame:
    """Cells of more than ``most`` rows split around pivots of their own, level by level.

    A cell's pivots come from about CELL_SAMPLE of its rows; its rows are dealt in parts of about
    ``most``, each with a copy of the pivots."""
    pivot_ddl, row_ddl = "cell long, parts long, pivots array<double>, k long", "row long, vec_id long, v array<double>, cell long"

    def choose(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        chosen = choose_pivots(matrix(table.column("v"), width), min(PIVOTS, 2 * -(-n // most)))
        return pa.table([[table.column("cell")[0].as_py()], [-(-n // most)], [chosen.ravel().tolist()], [len(chosen)]], schema=arrow_of(pivot_ddl))

    def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return arrow_of(row_ddl).empty_table()
        chosen = np.array(pivots.column("pivots")[0].as_py()).reshape(-1, width)
        cell = (rows.column("cell").to_numpy() + 1) * PIVOTS + nearest_pivot(rows.column("v"), chosen)
        return pa.table([rows.column("row"), rows.column("vec_id"), rows.column("v"), pa.array(cell)], schema=arrow_of(row_ddl))

    for level in range(1, LEVELS):
        crowded = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most)
        if not crowded.limit(1).count():
            break
        met = placed.join(crowded, "cell").where(F.pmod(F.xxhash64("row", F.lit(level)), F.greatest(F.lit(1), F.floor(F.col("n") / CELL_SAMPLE))) == 0)
        pivots = stored(met.select("cell", "n", "v").groupBy("cell").applyInArrow(choose, pivot_ddl), "pivots").where("k > 1")
        if not pivots.limit(1).count():
            break
        moving = placed.join(pivots.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("row"), "parts")).drop("parts")
        copies = pivots.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "pivots")
        moved = moving.groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInArrow(assign, row_ddl)
        placed = stored(placed.join(pivots.select("cell"), "cell", "left_anti").select("row", "vec_id", "v", "cell").unionByName(moved), "placed")
    return placed


def trees(placed: DataFrame, size: int, width: int) -> DataFrame:
    """place, region, n, centre, radius, norm and the pickled tree of each block of at most about ``size`` points."""
    ddl = "place string, region long, n long, centre array<double>, radius double, norm double, tree binary"
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(size))).alias("pieces"))
    dealt = placed.join(counts, "cell").select("cell", F.pmod(F.xxhash64("row"), "pieces").alias("piece"), "row", "vec_id", "v")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        cell, piece = (x.as_py() for x in key)
        tree, region = CoverTree(table.column("vec_id").to_numpy(), matrix(table.column("v"), width), table.column("row").to_numpy()), cell
        while region >= 2 * PIVOTS:
            region = region // PIVOTS - 1
        row = (f"{cell}:{piece}", region, len(tree.ids), tree.centres[0].tolist(), tree.radius[0], float(tree.norms[0]), pickle.dumps(tree))
        return pa.table([pa.array([x], t) for x, t in zip(row, arrow_of(ddl).types, strict=True)], schema=arrow_of(ddl))

    return stored(dealt.groupBy("cell", "piece").applyInArrow(build, ddl), "trees")


def search(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best of each pair's block for each query of its group; ``floors`` holds k-th scores known so far.

    A block and some of the groups that meet it come to a task together."""
    ddl = "grp string, query long, query_id long, vec_id long, score long"

    def run(met: pa.Table, block: pa.Table) -> pa.Table:
        schema, found = arrow_of(ddl), []
        data = pickle.loads(block.column("data_tree")[0].as_py()) if met.num_rows else None
        for i in range(met.num_rows):
            grp, query, known = (met.column(c)[i].as_py() for c in ("grp", "query_tree", "floors"))
            queries, floor = pickle.loads(query), None
            if known is not None:
                best = dict(known)
                floor = np.array([best.get(int(q), -np.inf) for q in queries.keys])
            q, d, s = dual_search(queries, data, k, floor)
            order = np.argsort(queries.keys)
            ids = queries.ids[order[np.searchsorted(queries.keys, q, sorter=order)]]
            found.append(pa.table([pa.array([grp] * len(q), pa.string()), pa.array(q), pa.array(ids), pa.array(d), pa.array(s.astype(np.int64))], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    joined = pairs.join(groups.select(F.col("place").alias("grp"), F.col("tree").alias("query_tree")), "grp")
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / F.lit(float(PART))).alias("parts"))
    joined = joined.join(parts, "block").select("block", F.pmod(F.xxhash64("grp"), "parts").alias("part"), "grp", "query_tree", "floors")
    trees = blocks.select(F.col("place").alias("block"), F.col("tree").alias("data_tree")).join(parts, "block")
    trees = trees.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "data_tree")
    return joined.groupBy("block", "part").cogroup(trees.groupBy("block", "part")).applyInArrow(run, ddl)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on vec_id."""
    rows = integer_vectors(vectors, scale, id_col, vector_col)
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()]
    width = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    pivots = choose_pivots(np.array([x + [0.0] * (width - len(x)) for x in sample]).reshape(len(sample), width), PIVOTS)
    if not len(pivots):
        pivots = np.zeros((1, width))
    placed = split_cells(stored(in_cells(rows, pivots), "placed"), width, BLOCK)
    blocks, groups = trees(placed, BLOCK, width), trees(placed.where(is_query), GROUP, width)
    # a region's blocks are dealt over keys, so that none of the at most PIVOTS regions is one join key
    counts = blocks.groupBy("region").agg(F.ceil(F.count("*") / F.lit(float(REGION_BLOCKS))).alias("salts"))
    summaries = blocks.join(F.broadcast(counts), "region").select(F.col("place").alias("block"), "region", "salts", F.pmod(F.xxhash64("place"), "salts").alias("salt"), "n", F.col("centre").alias("d"), F.col("radius").alias("rd"), F.col("norm").alias("nd"))
    # a region is a ball around one of its blocks' centres; there are at most PIVOTS of them
    heart = summaries.groupBy("region").agg(F.min_by("d", "block").alias("c"))
    away = F.sqrt(F.aggregate(F.zip_with("d", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)) + F.col("rd")
    regions = summaries.join(F.broadcast(heart), "region").groupBy("region").agg(F.first("salts").alias("salts"), F.first("c").alias("d"), (F.max(away) * (1 + 1e-9)).alias("rd")).withColumn("nd", F.sqrt(_dot("d", "d")))
    left = groups.select(F.col("place").alias("grp"), F.col("centre").alias("q"), F.col("radius").alias("rq"), F.col("norm").alias("nq"))
    high = _dot("q", "d") + F.col("rq") * F.col("nd") + F.col("rd") * F.col("nq") + F.col("rq") * F.col("rd")
    high = high + F.abs(high) * 1e-9 + 1e-6
    # every group meets the few regions (at most PIVOTS rows): the stated queries against all rows, by their summaries
    each = F.explode(F.sequence(F.lit(PIVOTS).cast("long"), F.lit(2 * PIVOTS - 1).cast("long"))).alias("region")
    bounds = stored(left.select("*", each).join(F.broadcast(regions), "region").select("grp", "q", "rq", "nq", "region", "salts", high.alias("region_high")), "bounds")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    summaries = summaries.drop("salts")
    nearest = bounds.groupBy("grp").agg(F.max_by(F.struct("region", "salts", "q", "rq", "nq"), F.struct("region_high", "region")).alias("m")).select("grp", "m.*")
    # as many blocks as hold k others than a query itself
    order = Window.partitionBy("grp").orderBy(F.desc("high"), "block").rowsBetween(Window.unboundedPreceding, -1)
    best = salted(nearest).join(summaries, ["region", "salt"]).select("grp", "block", "n", high.alias("high")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") <= k)
    kind = "array<struct<query:bigint,score:double>>"
    seeds = stored(best.select("grp", "block", F.lit(None).cast(kind).alias("floors")), "seeds")
    first = stored(search(seeds, groups, blocks, k), "first")
    kth = first.groupBy("grp", "query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select("grp", "query", F.element_at("s", k).alias("score"))
    # a group has about GROUP queries, so its list is short
    known = kth.groupBy("grp").agg(F.collect_list(F.struct("query", F.col("score").cast("double").alias("score"))).alias("floors"), F.count("*").alias("n"), F.min("score").alias("low"))
    worst = groups.select(F.col("place").alias("grp"), F.col("n").alias("queries")).join(known, "grp", "left").select("grp", "floors", F.when(F.col("n") == F.col("queries"), F.col("low")).alias("low"))
    reached = bounds.join(worst, "grp").where(F.col("low").isNull() | (F.col("region_high") >= F.col("low")))
    more = salted(reached).join(summaries, ["region", "salt"]).where(F.col("low").isNull() | (high >= F.col("low"))).select("grp", "block", "floors").join(seeds.select("grp", "block"), ["grp", "block"], "left_anti")
    found = first.unionByName(search(more, groups, blocks, k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLE = """
WITH good AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
scored AS (SELECT q.r, q.vec_id AS query_id, d.vec_id,
  list_sum([a[1] * a[2] FOR a IN list_zip(q.v, d.v)])::BIGINT AS score
  FROM good q JOIN good d ON q.vec_id % 20 = 0 AND q.r <> d.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
