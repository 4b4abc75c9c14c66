"""Similarity join of all rows of a table of vectors: metric balls with replication at their borders.

Vectors are scaled to length one, where a cosine of at least t is a distance of at most
r = sqrt(2 - 2 t). Equal vectors are one, with their number. Each lies in the ball of its nearest pivot
(its home) and goes as a guest to every ball whose pivot is at most 2 r farther than its own: two
vectors within r of each other meet in the home of either, by the triangle inequality. In a ball
rows are sorted by their distance to its pivot; a home row is compared with the rows whose distance
differs by at most r, in matrix products; all other pairs are skipped. A ball's home rows and all its
rows are cut into blocks of about ``BLOCK``, and blocks meet blocks, so a crowded ball is many tasks'. Where
all vectors are about equally far apart and r is large, guests are many: the work is then that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .sizes import materialized
from .vector import finite

SAMPLE, MOST_PIVOTS = 4_096, 1_024
BLOCK = 2_048
PLACED = 256  # rows whose balls are looked for at once
CELL, STRIP = 16_384, 256  # rows of a block of ``linked``, and those that are compared or skipped together
SLACK = 1e-9  # of distances and cosines, which are rounded to nine places


def pivots_of(sample: np.ndarray, most: int) -> np.ndarray:
    """Points of the sample far from each other (farthest first)."""
    if not len(sample):
        return sample
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and away.max() > SLACK:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Stored rep (a number of its own), first (the smallest id), copies and v of each distinct direction that has a length; vectors narrower than the widest are padded."""
    x = F.col("embedding").cast("array<double>")
    rows = finite(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, y: s + y * y))
    rows = rows.withColumn("length", length).where("length > 0 and length < double('infinity')")
    return materialized(rows.select("vec_id", F.transform("x", lambda y: F.round(y / F.col("length"), 12) + F.lit(0.0)).alias("v")).groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))


def placed(units: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """ball, home, away, rep, v: each row at home, and as a guest where it may meet a row of that home."""
    width = pivots.shape[1]
    ddl = "ball int, home boolean, away double, rep long, v array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, PLACED) for whole in batches for i in range(0, whole.num_rows, PLACED)):
            x = matrix(b.column("v"), width)
            away = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)))
            at = away.argmin(axis=1)
            row, ball = np.nonzero(away <= away[np.arange(len(x)), at][:, None] + 2 * reach + 1e-6)
            for i in range(0, len(row), BLOCK):  # a row may be a guest of most balls
                r, at_ball = row[i : i + BLOCK], ball[i : i + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(at_ball.astype(np.int32)), pa.array(at[r] == at_ball), pa.array(away[r, at_ball]), b.column("rep").take(pa.array(r)), b.column("v").take(pa.array(r))], names=["ball", "home", "away", "rep", "v"])

    return units.select("rep", "v").mapInArrow(run, ddl)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


def block_pairs(home: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], least: float, met: list | None = None, strip: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) of home rows and all rows of a ball (ids, distances to the pivot, vectors), a the smaller id and at home here. ``met`` takes the number of pairs that were compared."""
    (ids, away, x), (names, far, y) = ((z[0][o], z[1][o], z[2][o]) for z in (home, other) for o in [np.argsort(z[1], kind="stable")])
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    out = []
    for a in range(0, len(ids), strip):
        z = min(a + strip, len(ids))
        low, high = np.searchsorted(far, away[a] - reach, "left"), np.searchsorted(far, away[z - 1] + reach, "right")
        if met is not None:
            met.append((z - a) * (high - low))
        cosines = np.round(x[a:z] @ y[low:high].T, 9)
        i, j = np.nonzero(cosines >= least - SLACK / 2)
        keep = ids[a + i] < names[low + j]
        out.append((ids[a + i[keep]], names[low + j[keep]], cosines[i[keep], j[keep]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of all nodes (each the smallest number of its class) after the classes of each i and j are joined; ``parent`` has roots."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def block_links(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, least: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """links of the rows of ``left``, those of ``right`` (copies of what they are linked to; both sides are copies and vectors), and the roots of all in one row of numbers.

    ``right`` is None for links within ``left``. Rows that lie near each other should stand together: strips of them are skipped where their
    centres are too far apart. Links are counted and their classes joined strip by strip, so no pair is kept. ``met`` takes the number of pairs that were compared."""
    (copies, x), (others, y) = left, right or left
    n, reach = len(x), np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    links, back = np.zeros(n, np.int64), np.zeros(len(y), np.int64)
    parent = np.arange(n + (0 if right is None else len(y)))
    shift = 0 if right is None else n

    def strips(v: np.ndarray) -> list[tuple[int, np.ndarray, float]]:
        out = []
        for a in range(0, len(v), STRIP):
            centre = v[a : a + STRIP].mean(axis=0)
            out.append((a, centre, float(np.sqrt(((v[a : a + STRIP] - centre) ** 2).sum(axis=1).max()))))
        return out

    ends = strips(y)
    starts, centres, radii = np.array([e[0] for e in ends], int), np.array([e[1] for e in ends]).reshape(len(ends), -1), np.array([e[2] for e in ends])
    for a, centre, radius in strips(x):
        near = starts[np.sqrt(((centres - centre) ** 2).sum(axis=1)) <= radius + radii + reach]
        if not len(near):
            continue
        at = np.concatenate([np.arange(b, min(b + STRIP, len(y))) for b in near])
        for b in range(0, len(at), 4 * STRIP):  # bounds the pairs held at once
            cols = at[b : b + 4 * STRIP]
            cosines = x[a : a + STRIP] @ y[cols].T
            if met is not None:
                met.append(cosines.size)
            i, j = np.nonzero(cosines >= least - 2 * SLACK)
            keep = np.round(cosines[i, j], 9) >= least - SLACK / 2
            i, j = i[keep] + a, cols[j[keep]]
            if right is None:
                i, j = i[i != j], j[i != j]
            np.add.at(links, i, others[j])
            if right is not None:
                np.add.at(back, j, copies[i])
            parent = joined(parent, i, j + shift)
    return links, back, parent


def linked(units: DataFrame, least: float, most_pivots: int = MOST_PIVOTS, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Stored a, n: the number of rows that each distinct direction is linked to by a cosine of at least ``least``; and src, dst: edges between directions that make the classes of all such links.

    Rows are sorted into blocks by the ball of their nearest pivot and their distance to it, and each two blocks
    meet once, where links are counted and only a root is kept for each row. So what is written grows as rows x blocks, whatever
    the number of links."""
    sample = [r["v"] for r in units.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()]
    width = units.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    count = units.count()
    blocks = max(1, -(-count // cell), min(5, -(-count // 512)))
    pivots = pivots_of(np.array([x + [0.0] * (width - len(x)) for x in sample]).reshape(-1, width), min(most_pivots, max(1, round(count**0.5))))
    pivots = pivots if len(pivots) else np.zeros((1, width))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, BLOCK) for whole in batches for i in range(0, whole.num_rows, BLOCK)):
            x = matrix(b.column("v"), width)
            away = np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1))
            ball = away.argmin(axis=1)
            place = ball * 4.0 + np.sqrt(away[np.arange(len(x)), ball])  # no two vectors of length one are more than 2 apart
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("copies"), pa.array(place), pa.array([v.tobytes() for v in x], pa.binary())], names=["rep", "copies", "place", "v"])

    rows = materialized(units.select("rep", "copies", "v").mapInArrow(at_home, "rep long, copies long, place double, v binary"))
    edges = sorted(set(rows.approxQuantile("place", [i / blocks for i in range(1, blocks)], 0.1 / blocks))) if blocks > 1 else []
    blocks = len(edges) + 1
    own = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e <= F.col("place")))
    dealt = rows.withColumn("block", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "place", "v")
    cells = blocks * (blocks + 1) // 2

    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by([("block", "ascending"), ("place", "ascending")])
        block, reps, copies = (held.column(c).to_numpy() for c in ("block", "rep", "copies"))
        v = np.frombuffer(b"".join(held.column("v").to_pylist()), float).reshape(held.num_rows, width)
        n = int(np.searchsorted(block, held.column("i")[0].as_py(), "right"))
        within = held.column("i")[0].as_py() == held.column("j")[0].as_py()
        links, back, roots = block_links((copies[:n], v[:n]), None if within else (copies[n:], v[n:]), least)
        links = links if within else np.concatenate([links, back])
        some = np.flatnonzero(links)
        return pa.table([pa.array(reps[some]), pa.array(links[some]), pa.array(reps[roots[some]])], names=["a", "n", "root"])

    parts = max(units.sparkSession.sparkContext.defaultParallelism, min(2_000, 2 * cells))
    found = materialized(dealt.repartition(parts, "i", "j").groupBy("i", "j").applyInArrow(run, "a long, n long, root long"))
    return found.groupBy("a").agg(F.sum("n").alias("n")), found.where("a != root").select(F.col("a").alias("src"), F.col("root").alias("dst"))


def similar_pairs(units: DataFrame, least: float, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """Stored a, b (a < b, by rep) and score: all pairs of distinct directions with a cosine of at least ``least``."""
    sample = [r["v"] for r in units.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()]
    width = units.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    count = units.count()
    pivots = pivots_of(np.array([x + [0.0] * (width - len(x)) for x in sample]).reshape(-1, width), min(most_pivots, max(1, round(count**0.5))))
    if not len(pivots):
        pivots = np.zeros((1, width))
    rows = materialized(placed(units, pivots, float(np.sqrt(max(0.0, 2 - 2 * least)))))
    # at most MOST_PIVOTS rows
    sizes = rows.groupBy("ball").agg(F.ceil(F.count_if("home") / F.lit(float(BLOCK))).alias("homes"), F.ceil(F.count("*") / F.lit(float(BLOCK))).alias("all"))
    dealt = rows.join(F.broadcast(sizes), "ball").where("homes > 0").withColumn("i", F.pmod(F.xxhash64("rep", F.lit(1)), "homes")).withColumn("j", F.pmod(F.xxhash64("rep", F.lit(2)), "all"))
    one = dealt.where("home").select("ball", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("j"), "away", "rep", "v")
    other = dealt.select("ball", F.explode(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1)).alias("i"), "j", "away", "rep", "v")
    other = other.toDF(*other.columns)  # columns of their own, as both sides come from one table
    ddl = "a long, b long, score double"

    def run(home: pa.Table, rest: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])
        if not home.num_rows or not rest.num_rows:
            return schema.empty_table()
        sides = [(t.column("rep").to_numpy(), t.column("away").to_numpy(), matrix(t.column("v"), width)) for t in (home, rest)]
        return pa.table([pa.array(c) for c in block_pairs(*sides, least)], schema=schema)

    # of a pair the smaller id is at home in one ball only, so no pair comes twice
    return materialized(one.groupBy("ball", "i", "j").cogroup(other.groupBy("ball", "i", "j")).applyInArrow(run, ddl))


def similarity_join(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, score) of distinct directions, and these (rep, first, copies, v): together all pairs of rows, copies not written out."""
    units = unit_vectors(vectors)
    return similar_pairs(units, least), units


def similarity_classes(vectors: DataFrame, least: float) -> DataFrame:
    """vec_id, links, class_id: for every row the number of other rows with a cosine of at least ``least``, and the smallest id that such links lead to.

    Vectors without a direction (null, zero, not finite) have no links and are their own class; null ids are left out."""
    units = unit_vectors(vectors)
    others, edges = linked(units, least)
    classes = components(edges)
    named = units.join(others, F.col("rep") == F.col("a"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    named = materialized(named.select("v", "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("comp")))
    firsts = named.groupBy("comp").agg(F.min("first").alias("class_id"))
    named = materialized(named.join(firsts, "comp").select("v", "links", "class_id"))
    x = F.col("embedding").cast("array<double>")
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), length.alias("length"))
    whole = F.coalesce(F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))), F.lit(False)) & (F.col("length") > 0) & (F.col("length") < float("inf"))
    keyed = rows.select("vec_id", F.when(whole, F.transform("x", lambda y: F.round(y / F.col("length"), 12) + F.lit(0.0))).alias("v"))
    return keyed.join(named, "v", "left").select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("class_id", "vec_id").alias("class_id"))
