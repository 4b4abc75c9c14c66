"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A text is lower-cased in A-Z and cut into words at space, tab and the line separators of ASCII. Each
three words in a row are a shingle (a shorter text has one, of all its words); repeats count. A bit
of the 64-bit fingerprint is 1 if more than half of the shingles' XXH64 hashes (seed 42) have it.
Fingerprints at a Hamming distance of ``RADIUS`` or less are linked, and documents get the smallest
doc_id that links lead to.

Only distinct fingerprints are compared. They are sorted by the population counts of their four
quarters and cut into tiles of ``TILE``; each tile keeps the smallest and largest count of each
quarter. Two fingerprints differ in at least as many bits as the counts of their quarters differ in
sum, so pairs of tiles whose counts are farther apart than the radius are skipped, and within a pair
of tiles those of its strips of ``STRIP``. What is left is compared by exclusive-or and bit counts.
A comparison gives no more links than join its members, however many pairs lie within the radius.
The work grows with the square of the distinct fingerprints, less what the counts skip.

Defined results: null texts count as empty; texts without words have fingerprint zero and are linked
like others; long texts are read whole; repeated rows each give a row; a null doc_id gives no
component its name, and a component of null ids alone has a null one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .op09_near_dups import components
from .shared import arrow_of, id_and_text, read, slices, stored

WORDS, SEED = 3, 42
RADIUS = 3
TILE, STRIP = 16384, 512
SLICE_BYTES = 4 << 20
HASHES_AT_ONCE = 1 << 16
QUARTERS = range(4)


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    width = min(WORDS, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    ones, spans = np.zeros(64, np.int64), list(zip(starts, stops, strict=True))
    for at in range(0, len(spans), HASHES_AT_ONCE):
        part = spans[at : at + HASHES_AT_ONCE]
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:z], SEED) for a, z in part), ">u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (as a signed long) of each row."""
    ddl = "doc_id long, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(found.view(np.int64))], schema=arrow_of(ddl))

    return id_and_text(docs).mapInArrow(run, ddl)


def quarter_counts(fp: Column) -> list[Column]:
    """Population counts of the four 16-bit quarters."""
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int").alias(f"q{i}") for i in QUARTERS]


def tiles(prints: DataFrame) -> DataFrame:
    """Stored tiles of the distinct fingerprints (fp): tile, low0, high0, ..., and their bytes, in the order of their counts."""
    bounds = [f"{side}{i}" for i in QUARTERS for side in ("low", "high")]
    ddl = "tile long, " + ", ".join(f"{b} int" for b in bounds) + ", prints binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def row(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ends = [int(f(rows[:, 1 + i])) for i in QUARTERS for f in (np.min, np.max)]
            return pa.record_batch([[number], *([x] for x in ends), [rows[:, 0].astype("<i8").tobytes()]], schema=arrow_of(ddl))

        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1))
            n += b.num_rows
            if n >= TILE:
                rows = np.concatenate(held)
                for at in range(0, n - n % TILE, TILE):
                    yield row(rows[at : at + TILE])
                held, n = [rows[n - n % TILE :]], n % TILE
        if n:
            yield row(np.concatenate(held))

    counted = prints.select("fp", *quarter_counts(F.col("fp")))
    keys = [*(f"q{i}" for i in QUARTERS), "fp"]
    return stored(counted.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pack, ddl), "tiles")


def tile_pairs(packed: DataFrame, radius: int) -> DataFrame:
    """a, b (a <= b): pairs of tiles whose counts are within the radius; met on the first quarter's count."""
    box = packed.drop("prints")
    one = box.select(*(F.col(c).alias(f"a_{c}") for c in box.columns), F.explode(F.sequence("low0", "high0")).alias("key"))
    other = box.select(*(F.col(c).alias(f"b_{c}") for c in box.columns), F.explode(F.sequence(F.col("low0") - radius, F.col("high0") + radius)).alias("key"))
    apart = sum(F.greatest(F.lit(0), F.col(f"a_low{i}") - F.col(f"b_high{i}"), F.col(f"b_low{i}") - F.col(f"a_high{i}")) for i in QUARTERS)
    return one.join(other, "key").where((F.col("a_tile") <= F.col("b_tile")) & (apart <= radius)).select(F.col("a_tile").alias("a"), F.col("b_tile").alias("b")).distinct()


def strips(prints: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and end of each strip of a tile, with the smallest and largest counts of its quarters."""
    counts = np.bitwise_count(prints.view("<u2").reshape(-1, 4)).astype(np.int16)
    return [(a, a + len(counts[a : a + STRIP]), counts[a : a + STRIP].min(axis=0), counts[a : a + STRIP].max(axis=0)) for a in range(0, len(prints), STRIP)]


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, radius: int = RADIUS, met: list | None = None) -> list[tuple[int, int]]:
    """Links between two tiles of unsigned fingerprints, or within one; as few as join what lies within the radius.

    ``met`` takes the number of pairs of each pair of strips that was compared."""
    nodes = x if same else np.concatenate([x, y])
    shift, parent, out = 0 if same else len(x), np.arange(len(nodes)), []

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, z, low, high in strips(x):
        for b, w, low_y, high_y in strips(y):
            if same and b < a or np.maximum(0, np.maximum(low - high_y, low_y - high)).sum() > radius:
                continue
            if met is not None:
                met.append((z - a) * (w - b))
            near = np.bitwise_count(x[a:z, None] ^ y[None, b:w]) <= radius
            while True:
                near &= parent[a:z, None] != parent[None, b + shift : w + shift]
                rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(rows):
                    break
                # the first partner of each row and of each column; what these join is not looked at again
                firsts = [(a + i, shift + b + j) for i, j in zip(rows, near[rows].argmax(axis=1), strict=True)] + [(a + i, shift + b + j) for j, i in zip(columns, near[:, columns].argmax(axis=0), strict=True)]
                for i, j in firsts:
                    ri, rj = root(i), root(j)
                    if ri != rj:
                        parent[max(ri, rj)] = min(ri, rj)
                        out.append((int(nodes[i]), int(nodes[j])))
                while (up := parent[parent]).tobytes() != parent.tobytes():
                    parent[:] = up
    return out


def links(packed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links of fingerprints that lead from each to all it is linked with."""
    ddl = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in ("x", "y"))
                found = np.array(tile_links(x, y, batch.column("a")[i].as_py() == batch.column("b")[i].as_py(), radius), np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=arrow_of(ddl))

    side = lambda tile, name: packed.select(F.col("tile").alias(tile), F.col("prints").alias(name))
    dealt = stored(tile_pairs(packed, radius), "pairs").join(side("a", "x"), "a").join(side("b", "y"), "b")
    return dealt.repartition("a", "b").mapInArrow(run, ddl)


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: one row a document."""
    rows = stored(fingerprints(docs), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = stored(links(tiles(prints.select("fp")), radius), "links")
    comps = components(found).withColumnRenamed("node", "fp")
    named = prints.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    firsts = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = stored(named.join(firsts, "comp").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op11_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
