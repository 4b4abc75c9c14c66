"""Token ids in grammar-compressed shards (Re-Pair), readable at random positions.

Documents are dealt by ranges of doc_id, so the shards follow the ids' order (part, then shard). Each shard holds up to
``SHARD_TOKENS`` ids (one longer document makes a shard of its own) and is compressed by itself:
frequent pairs of neighbouring symbols are replaced by nonterminals, again and again. A round takes
the most frequent pairs, replaces each occurrence that no more frequent pair overlaps, and the next
round counts again, until no pair occurs ``LEAST`` times or the ``ROUNDS`` are over. No rule spans
two documents. A shard stores its rules, every rule's expansion length, the symbol sequence, and for
each document its id and where its symbols start, so one document, or any range of its ids, is
decoded without touching the others.

Files: Parquet with one row a shard; columns shard, part, n_tokens, doc_ids (int64), doc_starts
(int64 symbol positions), rules (pairs), lengths (int64), symbols; all little-endian, the symbols
and rules in 2 bytes where all ids are below ``FIRST_NARROW``, else in 4 (``first_rule`` tells).

Defined results: a null or empty text has only the end id; repeated rows and repeated ids are kept,
equal ids in order of their texts; null ids come first; an empty table makes no shard; other
columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import default_path, with_end, word_memo
from .shared import arrow_of, id_and_text, read, slices, stored

FIRST_NARROW = 50_300  # in two-byte shards, symbols from here on are nonterminals
SLOT_BITS = 18
SHARD_TOKENS = 1 << 21
ROUNDS = 8
PAIRS_A_ROUND = 1900
LEAST = 8
SLICE_BYTES = 2 << 20
NO_ID = -(1 << 63)  # stands for a null doc_id

SHARD_DDL = "part int, shard long, first_doc long, n_docs long, n_tokens long, first_rule long, doc_ids binary, doc_starts binary, rules binary, lengths binary, symbols binary"


def _chosen_pairs(keys: np.ndarray, most: int, least: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties to the smaller key."""
    ordered = np.sort(keys)
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    counts = np.diff(edge)
    often = np.flatnonzero(counts >= least)
    counts, found = counts[often], ordered[edge[often]]
    return found[np.lexsort((found, -counts))[:most]]


def _ranks(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Rank of each key among the chosen ones, len(chosen) for the others.

    A table by multiplicative hash; of chosen keys that share a slot the first has it, and the
    others wait for the next round."""
    word = keys.dtype.type
    odd, shift = (word(0x9E3779B1), word(32 - SLOT_BITS)) if keys.itemsize == 4 else (word(0x9E3779B97F4A7C15), word(64 - SLOT_BITS))
    table, owner = np.full(1 << SLOT_BITS, len(chosen), np.int16), np.full(1 << SLOT_BITS, np.iinfo(keys.dtype).max, keys.dtype)
    at = ((chosen * odd) >> shift)[::-1]
    table[at], owner[at] = np.arange(len(chosen), dtype=np.int16)[::-1], chosen[::-1]
    mine = (keys * odd) >> shift
    rank = table[mine]
    rank[owner[mine] != keys] = len(chosen)
    return rank


def symbol_space(largest: int) -> tuple[int, type, type]:
    """First nonterminal, and the types of symbols and of pairs, for ids up to ``largest``."""
    return (FIRST_NARROW, np.uint16, np.uint32) if largest < FIRST_NARROW else (1 << 31, np.uint32, np.uint64)


def repair(ids: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS, most: int = PAIRS_A_ROUND, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Compress ``ids``; ``ends`` is True at each document's last id.

    Gives the first nonterminal, the rules (n, 2), the symbols and the symbols' ends."""
    first, kind, pair = symbol_space(int(ids.max()) if len(ids) else 0)
    if first == FIRST_NARROW:
        most = min(most, (65_535 - first) // max(1, rounds))
    half = pair(8 * np.dtype(kind).itemsize)
    seq, last, rules = ids.astype(kind), ends, np.empty((0, 2), kind)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        keys = (seq[:-1].astype(pair) << half) | seq[1:]
        inside = ~last[:-1]
        chosen = _chosen_pairs(keys[inside], min(most, 32_000), least)
        if not len(chosen):
            break
        # rank[i + 1] is that of the pair at i; both ends have none
        rank = np.full(len(keys) + 2, len(chosen), np.int16)
        rank[1:-1] = _ranks(keys, chosen)
        rank[1:-1][~inside] = len(chosen)
        some = np.flatnonzero(rank < len(chosen))
        mine, before = rank[some], rank[some - 1]
        same = mine == before
        # of a run of one pair, every other one
        run = np.maximum.accumulate(np.where(same, 0, np.arange(len(some))))
        even = (np.arange(len(some)) - run) % 2 == 0
        good = ((mine < before) | (same & even)) & (mine <= rank[some + 1])
        at, used = some[good] - 1, np.zeros(len(chosen), bool)
        used[mine[good]] = True
        symbols = (first + len(rules) + np.cumsum(used) - 1).astype(kind)
        seq[at] = symbols[mine[good]]
        new = chosen[used]
        rules = np.concatenate([rules, np.stack([new >> half, new & ((pair(1) << half) - pair(1))], axis=1).astype(kind)])
        last = last.copy()
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
    return first, rules, seq, last


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids below each rule; a rule only names ids and earlier rules."""
    out = np.ones(len(rules), np.int64)
    size = lambda s: 1 if s < first else out[s - first]
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = size(a) + size(b)
    return out


class Shard:
    """A compressed shard, decoded as a whole, by document or by a range of a document's ids."""

    def __init__(self, first_rule: int, doc_ids: bytes, doc_starts: bytes, rules: bytes, lengths: bytes, symbols: bytes) -> None:
        self.first = first_rule
        kind = "<u2" if first_rule == FIRST_NARROW else "<u4"
        self.doc_ids, self.doc_starts = np.frombuffer(doc_ids, "<i8"), np.frombuffer(doc_starts, "<i8")
        self.rules = np.frombuffer(rules, kind).reshape(-1, 2)
        self.lengths = np.frombuffer(lengths, "<i8")
        self.symbols = np.frombuffer(symbols, kind)
        # expansions one after another; the single ids of this shard come first
        self.single = np.unique(np.concatenate([self.symbols, self.rules.ravel()]))
        self.single = self.single[self.single < self.first].astype(np.int64)
        self.at = np.concatenate([np.arange(len(self.single)), len(self.single) + np.cumsum(self.lengths) - self.lengths])
        self.flat = np.empty(len(self.single) + int(self.lengths.sum()), np.uint32)
        self.flat[: len(self.single)] = self.single
        for i, (a, b) in enumerate(zip(*(self._slot(self.rules[:, k]).tolist() for k in (0, 1)), strict=True)):
            p, la, lb = self.at[len(self.single) + i], self._size(a), self._size(b)
            self.flat[p : p + la] = self.flat[self.at[a] : self.at[a] + la]
            self.flat[p + la : p + la + lb] = self.flat[self.at[b] : self.at[b] + lb]

    def _slot(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        return np.where(symbols >= self.first, symbols - self.first + len(self.single), np.searchsorted(self.single, symbols))

    def _size(self, slot: int) -> int:
        return 1 if slot < len(self.single) else int(self.lengths[slot - len(self.single)])

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.first
        out = np.ones(len(symbols), np.int64)
        out[rule] = self.lengths[symbols[rule].astype(np.int64) - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self._sizes(symbols)
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.at[self._slot(symbols)] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _span(self, i: int) -> np.ndarray:
        return self.symbols[self.doc_starts[i] : self.doc_starts[i + 1]]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self._span(i))

    def ids(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document i: only the symbols that overlap the range are expanded."""
        symbols = self._span(i)
        ends = np.cumsum(self._sizes(symbols))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(symbols[a:b])[skip : skip + max(0, stop - start)]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each document's."""
        per = np.concatenate([[0], np.cumsum(self._sizes(self.symbols))])[self.doc_starts]
        return self.expand(self.symbols), np.diff(per)


def shard_row(doc_ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray, **options) -> tuple:
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(sizes) - 1] = True
    first, rules, symbols, last = repair(flat, ends, **options)
    starts = np.concatenate([[0], np.flatnonzero(last) + 1])
    kind = "<u2" if first == FIRST_NARROW else "<u4"
    return (first, doc_ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), rules.astype(kind).tobytes(), expansion_lengths(rules, first).astype("<i8").tobytes(), symbols.astype(kind).tobytes())


def write_shards(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """Encode, compress and store ``docs``; gives the stored shards."""
    docs = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    dealt = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, schema = word_memo(path), arrow_of(SHARD_DDL)
        held: list[tuple] = []
        part, shard, held_tokens = 0, 0, 0

        def put() -> pa.RecordBatch:
            ids, flat, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
            row = (part, shard, int(ids[0]), len(ids), len(flat), *shard_row(ids, flat, sizes))
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for b in slices(batches, "text", SLICE_BYTES):
            part = b.column("part")[0].as_py()
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            flat, sizes = with_end(*memo.ids(b.column("text").to_pylist()), end)
            if held and held_tokens + len(flat) > SHARD_TOKENS:
                yield put()
                held, held_tokens, shard = [], 0, shard + 1
            held.append((ids, flat, sizes))
            held_tokens += len(flat)
        if held:
            yield put()

    return stored(dealt.mapInArrow(run, SHARD_DDL), "shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Each shard with the ids of all shards before it.

    A running sum within each part, and one over the parts' totals: a row for each range that the
    documents were dealt into, a number the session sets."""
    sizes = shards.select("part", "shard", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_tokens").over(earlier.partitionBy("part").orderBy("shard")), F.lit(0))
    return sizes.select("part", "shard", inside.alias("inside")).join(F.broadcast(firsts), "part").select("part", "shard", (F.col("first") + F.col("inside")).alias("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode every document of the stored shards: doc_id, start, n_tokens, ids_crc32."""
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_of(ddl)
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(*(row[k] for k in ("first_rule", "doc_ids", "doc_starts", "rules", "lengths", "symbols")))
                flat, sizes = shard.documents()
                raw, ends = flat.astype("<u4").tobytes(), np.cumsum(sizes)
                view = memoryview(raw)
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch([pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID), pa.array(row["before"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], schema=schema)

    # by a shuffle of the shards, which are small beside the texts: their number grows with the corpus
    return shards.join(shard_starts(shards).hint("merge"), ["part", "shard"]).mapInArrow(run, ddl)


def op1_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(read(spark, sf_dir, "documents"), default_path()))
