"""Near-duplicate classes by ProbMinHash over weighted word shingles.

Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text. A shingle
is five words in a row (a shorter text has one, of all its words), weighted 1 + ln(times it occurs).
Every shingle starts a Poisson process whose rate is its weight, the same in each document that has
it; an arrival goes to one of ``REGISTERS`` registers, which keep the earliest arrival's shingle. A
document stops when the next arrival is later than every register, so two documents agree in a
register with the probability Jaccard similarity of their weights. ``BANDS`` bands of registers
make buckets; what meets in a bucket is verified on the shingles themselves, at ``THRESHOLD``.

Texts of equal words are one class at once and go on as one representative. In a bucket no list of
all pairs is made: the smallest member is held against the others first, and what passes becomes
links. Components of the links then leave open only buckets whose members lie in several
components. Of open buckets with the same members one is kept; each is cut into blocks of about
``BLOCK`` members, and blocks are compared by matrix products over their shingles, within
themselves and with the bucket's other blocks. A comparison gives at most one link for each member,
as only links that join two components are given. So every pair that shares a bucket is either
in one class or has been compared.

Very long texts are read whole; their shingles count all.

Result: one row per document with class_id (the smallest doc_id of its class) and keep (true for
one row of each class). Null texts count as empty; texts without words are copies if they are
equal; null ids come last and give a null class_id where a class has no other; repeated rows are
members like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_of, id_and_text, read, slices, stored

WORDS = 5
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
SLICE_BYTES = 2 << 20
BLOCK, BLOCK_BYTES = 256, 16 << 20
PIVOT_PAIRS = 512
COLUMNS = 4096  # of a matrix product
NO_ID = (1 << 63) - 1

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and multiplications (Steele, Lea and Flood 2014)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each."""
    raws = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False).astype(bool))
    begins, ends = edge[::2], edge[1::2]
    if not len(begins):
        return np.empty(0, _U), np.zeros(len(texts), np.int64)
    sizes = ends - begins
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    parts = (data[inside].astype(_U) + _U(1)) * powers(0x9E3779B97F4A7C15, int(sizes.max()))[place]
    hashes = mixed(np.add.reduceat(parts, np.cumsum(sizes) - sizes))
    starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return hashes, np.diff(np.searchsorted(begins, starts))


def text_keys(texts: list[str], words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's sequence of words; of the text itself where it has none."""
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(first, counts)
    some = np.flatnonzero(counts)
    keys = []
    for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        key = np.zeros(len(counts), _U)
        if len(some):
            key[some] = mixed(np.add.reduceat(mixed(words ^ _U(base)) * powers(base, int(counts.max()))[place], first[some]) + counts[some].astype(_U))
        keys.append(key)
    for i in np.flatnonzero(counts == 0):
        digest = hashlib.blake2b(texts[i].encode(), digest_size=16).digest()
        keys[0][i], keys[1][i] = np.frombuffer(digest, _U)
    return keys[0], keys[1]


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit shingle hashes of all texts (sorted in each, repeated as they occur) and their numbers."""
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    doc, first = np.repeat(np.arange(len(n)), n), np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(doc))
    length = np.minimum(counts, WORDS)[doc]
    padded = np.concatenate([words, np.zeros(WORDS, _U)])
    total = length.astype(_U)
    for k, power in enumerate(powers(0xE7037ED1A0B428DB, WORDS + 1)[1:]):
        total = total + np.where(k < length, padded[at + k], _U(0)) * power
    keyed = np.sort((doc.astype(_U) << _U(32)) | (mixed(total) >> _U(32)))
    return (keyed & _U(0xFFFFFFFF)).astype(np.uint32), n


def weighted(found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with their weights, and each one's text."""
    doc = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [len(found)]]))
    return found[at], 1 + np.log(times), doc[at]


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """For each document and register the 32-bit element whose arrival there is earliest."""
    empty = np.iinfo(_U).max
    kept = np.full(n_docs * registers, empty, _U)
    seed, time = mixed(elements.astype(_U) + _U(0x2545F4914F6CDD1D)), np.zeros(len(elements))
    while len(elements):
        seed = mixed(seed + _U(0x9E3779B97F4A7C15))
        # the upper 53 bits give the waiting time, a product of the seed the register
        time = time - np.log(((seed >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
        place = ((seed * _U(0xD1342543DE82EF95)) >> _U(33)) % _U(registers)
        arrival = (time.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | elements
        np.minimum.at(kept, doc * registers + place.astype(np.int64), arrival)
        latest = (kept.reshape(n_docs, registers).max(axis=1) >> _U(32)).astype(np.uint32)
        latest = np.where(latest == 0xFFFFFFFF, np.uint32(0x7F800000), latest).view(np.float32)
        going = time < latest[doc]
        elements, weights, doc, seed, time = elements[going], weights[going], doc[going], seed[going], time[going]
    return (kept & _U(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, registers)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(_U)
    key = np.arange(BANDS, dtype=_U)[None, :] + _U(1)
    for k in range(ROWS):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two sorted shingle lists with repeats."""
    (ea, wa, _), (eb, wb, _) = weighted(a, np.array([len(a)])), weighted(b, np.array([len(b)]))
    if not len(ea) or not len(eb):
        return 0.0
    common, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if len(wa) == len(a) and len(wb) == len(b):
        return len(common) / (len(ea) + len(eb) - len(common))
    x, y = wa[ia], wb[ib]
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # of the sum over j of max(x_j / x_i, y_j / y_i), those of a ratio not below i's have x_j / x_i
    at = np.searchsorted(ratio, ratio, "left")
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])[at] + only_x
    below = np.concatenate([[0], np.cumsum(y)])[at] + only_y
    return float((1 / (above / x + below / y)).sum())


def signed(docs: DataFrame) -> DataFrame:
    """Stored rows: row (unique), doc_id, text_hash, key, bands and shingles (4 bytes each, sorted)."""
    ddl = "row long, doc_id long, text_hash long, key_a long, key_b long, bands array<long>, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_of(ddl)
        row = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for b in slices(batches, "text", SLICE_BYTES):
            texts = b.column("text").to_pylist()
            words, counts = word_hashes(texts)
            key_a, key_b = text_keys(texts, words, counts)
            found, n = shingles(words, counts)
            some = np.flatnonzero(n)
            bands = np.full(len(texts), None, object)
            keys = band_keys(prob_min_hash(*weighted(found, n[some]), len(some))) if len(some) else []
            for i, k in zip(some, keys, strict=True):
                bands[i] = k
            ends = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
            sets = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(found.astype("<u4").tobytes())])
            yield pa.record_batch([pa.array(np.arange(row, row + len(texts))), b.column("doc_id"), b.column("text_hash"), pa.array(key_a.view(np.int64)), pa.array(key_b.view(np.int64)), pa.array(bands, schema.types[5]), sets], schema=schema)
            row += len(texts)

    return stored(id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, ddl), "signed")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b, copies) those whose similarity reaches the threshold."""
    ddl = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_of(ddl)
        for b in batches:
            lists = [[np.frombuffer(x, "<u4") for x in b.column(c).to_pylist()] for c in ("in_a", "in_b")]
            keep = pa.array([probability_jaccard(x, y) >= threshold for x, y in zip(*lists, strict=True)], pa.bool_())
            yield pa.record_batch([b.column("a"), b.column("b")], schema=schema).filter(keep)

    # a pivot of large buckets is copied once for each PIVOT_PAIRS of their members, so no task gets all its pairs
    pivots = pairs.groupBy("a").agg(F.max("copies").alias("copies")).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    pivots = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("in_a")).join(pivots, "a")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy")).join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("in_b")), "b")
    return dealt.join(pivots, ["a", "copy"]).select("a", "b", "in_a", "in_b").mapInArrow(run, ddl)


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node it is linked to. Labels go along links and are then followed to
    their own labels, so the rounds grow with the logarithm of a chain's length."""
    both = stored(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(links.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("comp").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("src")).select("node", F.least("comp", "near").alias("next"), "comp")
        target = hooked.select(F.col("node").alias("to"), F.col("next").alias("jump"))
        moved = stored(hooked.join(target, F.col("next") == F.col("to")).select("node", "jump", (F.col("jump") != F.col("comp")).alias("moved")), "labels")
        labels = moved.select("node", F.col("jump").alias("comp"))
        if not moved.where("moved").limit(1).count():
            return labels


def block_links(reps: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], threshold: float, cut: int = 0) -> list[tuple[int, int]]:
    """Links between members of different components that reach the threshold, as few as join them.

    With cut, only members before it are held against those from it on. The sum over shingles of
    sqrt(p q), p and q the weights' shares, is never below the similarity and is a matrix product;
    where all weights are 1 it tells the similarity itself, other pairs are then worked out."""
    n = len(reps)
    _, comp = np.unique(comps, return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    if comp.max() == 0 or not sizes.all():
        return []
    elements, weights, doc = weighted(np.concatenate(sets), sizes)
    totals, plain = np.bincount(doc, weights, n), np.bincount(doc, minlength=n) == sizes
    column = np.unique(elements, return_inverse=True)[1]
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, doc, share = (np.cumsum(shared) - 1)[column[keep]], doc[keep], np.sqrt(weights[keep] / totals[doc[keep]])
    order = np.argsort(column, kind="stable")
    column, doc, share = column[order], doc[order], share[order]
    overlap = np.zeros((n, n), np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, z = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[doc[a:z], column[a:z] - low] = share[a:z]
        overlap += part @ part.T
    open_pairs = np.triu(comp[:, None] != comp[None, :], 1) & (overlap >= threshold - 1e-3)
    if cut:
        open_pairs[:cut, :cut] = open_pairs[cut:, cut:] = False
    i, j = np.nonzero(open_pairs)
    common = np.rint(overlap[i, j] * np.sqrt(sizes[i].astype(float) * sizes[j]))
    exact = plain[i] & plain[j]
    passes = common / (sizes[i] + sizes[j] - common) >= threshold
    parent = list(range(int(comp.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for known in (True, False):  # what is known first, which spares working out others
        for a, z, good in zip(*(x[exact == known].tolist() for x in (i, j, passes)), strict=True):
            if known and not good:
                continue
            ra, rz = root(int(comp[a])), root(int(comp[z]))
            if ra != rz and (known or probability_jaccard(sets[a], sets[z]) >= threshold):
                parent[ra] = rz
                out.append((int(reps[a]), int(reps[z])))
    return out


def _unpacked(lists: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in lists]


def links_in_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) within each (band, block) of rows band, block, rep, comp, shingles; a block is small."""
    ddl = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, held = arrow_of(ddl), None, []

        def links() -> list[tuple[int, int]]:
            return block_links(np.array([x[0] for x in held]), np.array([x[1] for x in held]), _unpacked([x[2] for x in held]), threshold) if len(held) > 1 else []

        for b in batches:
            found = []
            for band, block, *member in zip(*(b.column(c).to_pylist() for c in ("band", "block", "rep", "comp", "shingles")), strict=True):
                if (band, block) != now:
                    found += links()
                    now, held = (band, block), []
                held.append(member)
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)
        found = links()
        yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return rows.repartition("band", "block").sortWithinPartitions("band", "block").select("band", "block", "rep", "comp", "shingles").mapInArrow(run, ddl)


def links_between_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """Links between different blocks of a band: a block is packed into one row and meets the later ones."""
    packed_ddl = "band long, block long, reps array<long>, comps array<long>, sizes array<long>, shingles binary"

    def pack(table: pa.Table) -> pa.Table:
        sets = table.column("shingles").to_pylist()
        row = [table.column("band")[0].as_py(), table.column("block")[0].as_py(), table.column("rep").to_pylist(), table.column("comp").to_pylist(), [len(x) // 4 for x in sets], b"".join(sets)]
        return pa.table([pa.array([x], t) for x, t in zip(row, arrow_of(packed_ddl).types, strict=True)], schema=arrow_of(packed_ddl))

    packed = stored(rows.groupBy("band", "block").applyInArrow(pack, packed_ddl), "blocks")
    ddl = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i in range(b.num_rows):
                left, right = ([b.column(f"{side}_{c}")[i].as_py() for c in ("reps", "comps", "sizes", "shingles")] for side in "xy")
                sets = [part for side in (left, right) for part in np.split(np.frombuffer(side[3], "<u4"), np.cumsum(side[2])[:-1])]
                found += block_links(np.array(left[0] + right[0]), np.array(left[1] + right[1]), sets, threshold, len(left[0]))
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=arrow_of(ddl))

    x, y = (packed.select("band", *(F.col(c).alias(f"{side}_{c}") for c in ("block", "reps", "comps", "sizes", "shingles"))) for side in "xy")
    return x.join(y, "band").where("x_block < y_block").repartition("band", "x_block", "y_block").drop("band", "x_block", "y_block").mapInArrow(run, ddl)


def linked_components(reps: DataFrame, threshold: float) -> DataFrame:
    """node, comp for the representatives that have links."""
    exploded = reps.where("bands is not null").select("rep", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    members = stored(exploded.join(shared, "band").select("band", "rep", "pivot", "n"), "members")
    sets = stored(reps.select("rep", "shingles").join(members.select("rep").distinct(), "rep", "left_semi"), "sets")
    copies = F.ceil(F.max("n") / F.lit(float(PIVOT_PAIRS))).cast("int").alias("copies")
    pairs = members.where("rep != pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(copies)
    links = stored(verified(pairs, sets, threshold), "links")
    comps = components(links)
    labelled = stored(members.select("band", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(sets.select("rep", F.octet_length("shingles").alias("bytes")), "rep"), "labelled")
    # open buckets, one of those with the same members, and the blocks each is cut into
    hashes = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    buckets = labelled.groupBy("band").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("bytes").alias("bytes"), *hashes)
    parts = F.greatest(F.ceil(F.col("n") / F.lit(float(BLOCK))), F.ceil(F.col("bytes") / F.lit(float(BLOCK_BYTES))))
    chosen = buckets.where("low != high").groupBy("n", "h1", "h2").agg(F.min("band").alias("band"), F.max(parts).alias("blocks"))
    opened = labelled.join(chosen.select("band", "blocks"), "band").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    opened = stored(opened.select("band", "rep", "comp", "blocks", "block"), "opened")
    if not opened.limit(1).count():
        return comps
    rows = opened.join(sets, "rep")
    more = links_in_blocks(rows, threshold).unionByName(links_between_blocks(rows.where("blocks > 1"), threshold))
    more = stored(more.distinct(), "links")
    return components(links.unionByName(more)) if more.limit(1).count() else comps


def near_duplicate_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, class_id, keep: one row per document."""
    rows = signed(docs)
    by_key = rows.groupBy("key_a", "key_b").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row")).alias("first"), F.min("row").alias("rep"))
    keyed = stored(by_key, "texts")
    reps = rows.join(keyed.select("rep"), F.col("row") == F.col("rep"), "left_semi").select(F.col("row").alias("rep"), "bands", "shingles")
    comps = linked_components(reps, threshold)
    texts = keyed.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    firsts = texts.groupBy("comp").agg(F.min("first").alias("its"))
    classes = stored(texts.join(firsts, "comp").select("key_a", "key_b", "its"), "classes")
    out = rows.select("row", "doc_id", "text_hash", "key_a", "key_b").join(classes, ["key_a", "key_b"])
    return out.select("doc_id", "text_hash", F.nullif("its.id", F.lit(NO_ID)).alias("class_id"), (F.col("row") == F.col("its.row")).alias("keep"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each near-duplicate class of ``docs``, with its columns.

    A row is known by its id and the hash of its text; rows equal in both are one document, and
    only where there are such rows is one of them chosen in a further step."""
    kept = near_duplicate_rows(docs, threshold).where("keep").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    # a row travels as one struct, so its columns can't clash with those made here
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")]
    marked = docs.select(*own)
    found = marked.join(kept, (F.col("hash") == F.col("kept_hash")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    if docs.select(*own[1:]).groupBy("id", "hash").count().where("count > 1").limit(1).count():
        found = found.dropDuplicates(["id", "hash"])
    return found.select("row.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_rows(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "keep")
