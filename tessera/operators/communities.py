"""Communities within communities: modularity by local moves and contraction, level by level."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import materialized

LEAST_GAIN = 1e-9
#: Arcs of a graph whose levels one task finishes, at most.
FEW_ARCS = 2_000_000


def arcs_of(edges: DataFrame) -> DataFrame:
    """src, dst, w: both directions of each undirected edge; repeated edges add up their weights (1 where there is none), loops and null ends are left out."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    one = edges.where("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(weight).alias("w"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(one.select("b", "a", "w"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of labels (node, community) over edges; 0 for a graph without edges."""
    return _modularity(_contracted(arcs_of(edges), labels))


def _contracted(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """Arcs between communities; what lies within one becomes its loop."""
    ends = [labels.select(F.col("node").alias(n), F.col("community").alias(c)) for n, c in (("src", "from"), ("dst", "to"))]
    return arcs.join(ends[0], "src").join(ends[1], "dst").groupBy(F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.sum("w").alias("w"))


def _modularity(arcs: DataFrame) -> float:
    by_node = arcs.groupBy("src").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("inside"))
    x = by_node.agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.sum("k").alias("all")).first()
    return x["inside"] / x["all"] - x["squares"] / x["all"] ** 2 if x["all"] else 0.0


def _turn(number: int) -> tuple[int, int]:
    """Which bits of the crc32 of a name, and a last one, make by exclusive or the last bit of the crc32 of that name and ``#number``; so names are not needed."""
    added = f"#{number}".encode()
    bit = lambda start: zlib.crc32(added, start) & 1
    return sum(1 << i for i in range(32) if bit(1 << i) != bit(0)), bit(0)


def _may_move(crc: Column, number: int) -> Column:
    """About half of the nodes, others in each round, so that neighbours don't swap for ever: those with an even crc32 of their name and ``#number``."""
    bits, last = _turn(number)
    return F.bit_count(crc.bitwiseAND(F.lit(bits).cast("long"))) % 2 == last


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node, crc) with ids in the order of their names, and arcs src, crc (of src), dst, w between ids."""
    one = materialized(arcs_of(edges).where("src < dst"))
    names = one.select(F.col("src").alias("node")).union(one.select("dst")).distinct().orderBy("node")
    nodes = materialized(names.select(F.monotonically_increasing_id().alias("id"), "node", F.crc32(F.col("node").cast("string").cast("binary")).alias("crc")))
    ends = [nodes.select(F.col("node").alias(n), F.col("id").alias(f"{n}_id"), F.col("crc").alias(f"{n}_crc")) for n in ("src", "dst")]
    both = materialized(one.join(ends[0], "src").join(ends[1], "dst").select("src_id", "src_crc", "dst_id", "dst_crc", "w"))
    return nodes, both.toDF("src", "crc", "dst", "_", "w").drop("_").unionAll(both.select("dst_id", "dst_crc", "src_id", "w"))


def _moved(arcs: DataFrame, state: DataFrame, all_weight: float, number: int) -> DataFrame:
    """One round: of the nodes that may move, each goes to the community around it with the largest gain.

    The gain of a community is the weight to it less what chance gives, k tot / all; the own one counts
    without the node. Ties go to the smaller community, and only a real gain moves. What a node hears from its
    neighbours is dealt by node once; sums, gains and the choice are made where it lies."""
    may = _may_move(F.col("crc"), number)
    held = state.join(state.groupBy("community").agg(F.sum("k").alias("tot")), "community")
    told = arcs.where(may & (F.col("src") != F.col("dst"))).join(held.select(F.col("node").alias("dst"), F.col("community").alias("c"), F.col("tot").alias("c_tot")), "dst")
    near = told.select("src", "c", "c_tot", "w").repartition("src").groupBy("src", "c").agg(F.sum("w").alias("w"), F.first("c_tot").alias("c_tot"))
    going = held.where(may).join(near, F.col("node") == F.col("src"), "left")
    chance = lambda tot: F.col("k") * tot / F.lit(all_weight)
    own = F.col("c") == F.col("community")
    gain = F.col("w") - chance(F.col("c_tot") - F.when(own, F.col("k")).otherwise(0.0))
    scored = going.select("node", "k", "crc", "community", "c", gain.alias("gain"), F.when(own, gain).alias("own"), (0.0 - chance(F.col("tot") - F.col("k"))).alias("alone"))
    kept = [F.first(x).alias(x) for x in ("k", "crc", "community", "alone")]
    best = scored.groupBy("node").agg(*kept, F.min(F.when(F.col("c").isNotNull(), F.struct((-F.col("gain")).alias("loss"), "c"))).alias("best"), F.max("own").alias("own"))
    moves = F.coalesce(-F.col("best.loss") > F.coalesce("own", "alone") + LEAST_GAIN, F.lit(False))
    chosen = best.select("node", "k", "crc", F.when(moves, F.col("best.c")).otherwise(F.col("community")).alias("community"), moves.alias("moved"))
    return chosen.unionAll(state.where(~may).select("node", "k", "crc", "community", F.lit(False).alias("moved")))


def _joined(arcs: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (node, community, crc), communities called by their smallest node, and the arcs between these."""
    names = state.groupBy("community").agg(F.min("node").alias("name"), F.min_by("crc", "node").alias("name_crc"))
    labels = materialized(state.join(names, "community").select("node", F.col("name").alias("community"), F.col("name_crc").alias("crc")))
    ends = [labels.select(F.col("node").alias("src"), F.col("community").alias("from"), F.col("crc").alias("from_crc")), labels.select(F.col("node").alias("dst"), F.col("community").alias("to"))]
    met = arcs.select("src", "dst", "w").join(ends[0], "src").join(ends[1], "dst")
    return labels, materialized(met.groupBy(F.col("from").alias("src"), F.col("from_crc").alias("crc"), F.col("to").alias("dst")).agg(F.sum("w").alias("w")))


def _moved_here(arcs: tuple[np.ndarray, ...], k: np.ndarray, crc: np.ndarray, community: np.ndarray, whole: float, number: int) -> np.ndarray:
    """The communities after a round as ``_moved`` makes it, of nodes 0 to n - 1."""
    bits, last = _turn(number)
    src, dst, w = arcs
    may, n = np.bitwise_count(crc & bits) % 2 == last, len(k)
    tot, told = np.bincount(community, k, n), may[src] & (src != dst)
    if not told.any():
        return community
    near, at = np.unique(src[told] * n + community[dst[told]], return_inverse=True)
    node, c = np.divmod(near, n)
    own = c == community[node]
    gain = np.bincount(at, w[told]) - k[node] * (tot[c] - np.where(own, k[node], 0.0)) / whole
    stay = 0.0 - k * (tot[community] - k) / whole
    stay[node[own]] = gain[own]
    first = np.flatnonzero(np.diff(node, prepend=-1))
    best = np.maximum.reduceat(gain, first)
    spot = np.minimum.reduceat(np.where(gain == np.repeat(best, np.diff(np.append(first, len(node)))), np.arange(len(node)), len(node)), first)
    moves = best > stay[node[first]] + LEAST_GAIN
    out = community.copy()
    out[node[first][moves]] = c[spot][moves]
    return out


def _finished(arcs: DataFrame, whole: float, done: list[float], reached: float, number: int, levels: range, rounds: int) -> DataFrame:
    """at, to, level: further levels of a graph of few arcs, made by one task; the rounds are those of ``hierarchy``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = list(batches)
        if not met:
            return
        met = pa.Table.from_batches(met)
        src, crc, dst, w = (met.column(c).to_numpy() for c in ("src", "crc", "dst", "w"))
        ids, first, src = np.unique(src, return_index=True, return_inverse=True)
        crc, dst, best, turn = crc[first], np.searchsorted(ids, dst), reached, number
        names, top = ids, np.arange(len(ids))  # of this level's nodes, and where each node of the first one is among them
        for level in levels:
            k = np.bincount(src, w, len(names))
            label, still = np.arange(len(names)), 0
            for _ in range(rounds):
                turn += 1
                after = _moved_here((src, dst, w), k, crc, label, whole, turn)
                still = 0 if (after != label).any() else still + 1
                label = after
                if still == 2:
                    break
            _, least, to = np.unique(label, return_index=True, return_inverse=True)
            order = np.argsort(least)  # communities in the order of their smallest nodes
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            to, names, crc, n = place[to], names[least[order]], crc[least[order]], len(order)
            pair, at = np.unique(to[src] * n + to[dst], return_inverse=True)
            w, (src, dst) = np.bincount(at, w), np.divmod(pair, n)
            now = (w[src == dst].sum() + done[0]) / whole - ((np.bincount(src, w, n) ** 2).sum() + done[1]) / whole**2
            if now <= best + LEAST_GAIN:
                return
            best, top = now, to[top]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names[top]), pa.array(np.full(len(ids), level, np.int32))], names=["at", "to", "level"])

    return materialized(arcs.select("src", "crc", "dst", "w").repartition(1).mapInArrow(run, "at long, to long, level int"))


def hierarchy(edges: DataFrame, levels: int = 6, rounds: int = 8, few: int = FEW_ARCS) -> DataFrame:
    """node, community, level: at level 0 communities of nodes, at each further one communities of those before (Blondel et al. 2008).

    A level makes up to ``rounds`` rounds of moves and ends when two in a row move nothing; its
    communities then become the nodes of the next. A level that does not raise modularity is not given,
    and the last is that where nothing can be joined. A community is called by its smallest node. Nodes are numbered
    in the order of their names, which come back at the end; a community that nothing around it is left to join takes no part in further
    levels. Each round and each contraction is a few joins on numbers, its result written and read back; a few numbers
    a level come to the driver. Once at most ``few`` arcs are left, one task makes the levels that are left. Without any gain each node is its own community at level 0."""
    nodes, arcs = _numbered(edges)
    whole, done = None, [0.0, 0.0]  # of communities that take no part any more: weight inside, squares of weights

    def weighed(arcs: DataFrame) -> tuple[DataFrame, float, int]:
        """Nodes (node, k, crc, community) that others are around, the modularity of all, and the number of these nodes' arcs."""
        nonlocal whole
        loop = F.col("src") == F.col("dst")
        found = materialized(arcs.groupBy("src", "crc").agg(F.sum("w").alias("k"), F.sum(F.when(loop, F.col("w")).otherwise(0.0)).alias("inside"), F.max(~loop).alias("open"), F.count("*").alias("n")))
        squares = F.col("k") * F.col("k")
        x = found.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("k", "inside", squares, F.when(~F.col("open"), F.col("inside")), F.when(~F.col("open"), squares))), F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0))).first()
        whole = x[0] if whole is None else whole
        quality = (x[1] + done[0]) / whole - (x[2] + done[1]) / whole**2 if whole else 0.0
        done[0], done[1] = done[0] + x[3], done[1] + x[4]
        return found.where("open").select(F.col("src").alias("node"), "k", "crc", F.col("src").alias("community")), quality, x[5]

    state, reached, left = weighed(arcs)
    member = nodes.select("node", F.col("id").alias("at"))
    found, number = [], 0
    for level in range(levels):
        if not left:
            break
        if left <= few:
            rest = _finished(arcs.join(state.select(F.col("node").alias("src")), "src", "left_semi"), whole, done, reached, number, range(level, levels), rounds)
            made = [r["level"] for r in rest.select("level").distinct().collect()]
            found += [member.join(rest.where(F.col("level") == at).drop("level"), "at", "left").select("node", F.coalesce("to", "at").alias("at"), F.lit(at).alias("level")) for at in sorted(made)]
            break
        still = 0
        for _ in range(rounds):
            number += 1
            moved = materialized(_moved(arcs, state, whole, number))
            state = moved.drop("moved")
            still = 0 if moved.where("moved").limit(1).count() else still + 1
            if still == 2:
                break
        labels, arcs = _joined(arcs, state)
        state, now, left = weighed(arcs)
        if now <= reached + LEAST_GAIN:
            break
        to = labels.select(F.col("node").alias("at"), F.col("community").alias("to"))
        member = materialized(member.join(to, "at", "left").select("node", F.coalesce("to", "at").alias("at")))
        found.append(member.withColumn("level", F.lit(level)))
        reached = now
    if not found:
        return nodes.select("node", F.col("node").alias("community"), F.lit(0).alias("level"))
    named = nodes.select(F.col("id").alias("at"), F.col("node").alias("community"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.join(named, "at").select("node", "community", "level")
