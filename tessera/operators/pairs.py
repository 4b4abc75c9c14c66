"""Counts of pairs of terms: tasks count within slices, and what is shuffled is packed lists of counts instead of a row for each pair.

Terms are dealt over ``side`` parts by their crc32, and a pair lies in the cell of its two parts. A slice gives
each cell the terms of its two parts in order, the gaps between its pairs' numbers, and their counts. All of a pair meet in
one cell, where the lists are added up; ``side`` grows with the root of the text, so that a cell's lists fit a task.

Where a row's pairs are many times its terms (``pairs_within``), the rows' terms are shuffled instead, once, by part, and the task of
a cell reads its two parts and counts their pairs from these, a tile of its terms at a time. No pair is ever shuffled or written."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a slice before they are counted, of a cell's lists, about, and of lists that are added up at once.
PAIRS_AT_ONCE, CELL, LISTED = 1 << 23, 1 << 22, 1 << 21
ROWS_OUT = 1 << 16
LISTS = "cell int, n int, src binary, dst binary, gaps binary, counts binary"
#: Terms of a slice of rows and of a part, about; a slice has for each part its words, and rows and places of its terms in these.
TERMS_AT_ONCE, PART = 1 << 21, 1 << 23
PARTS = "part int, slice long, n int, words binary, gaps binary"
#: Pairs that are counted at once.
TILE = 1 << 21

Pairs = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def pairs_of_row(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Numbers a n + b, a < b, of all pairs of distinct codes of a row."""
    row, code = np.divmod(np.unique(row * n + code), n)
    ends, at, out = np.searchsorted(row, row, "right"), np.arange(len(code)), [np.empty(0, np.int64)]
    for step in range(1, len(code) + 1):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        out.append(code[at] * n + code[at + step])
    return np.concatenate(out)


def pairs_nearby(reach: int) -> Pairs:
    """Of different codes up to ``reach`` places apart in a row."""

    def run(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = [np.empty(0, np.int64)]
        for step in range(1, reach + 1):
            a, b = code[:-step], code[step:]
            met = (row[:-step] == row[step:]) & (a != b)
            out.append(np.minimum(a, b)[met] * n + np.maximum(a, b)[met])
        return np.concatenate(out)

    return run


def packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)


def packed_numbers(x: np.ndarray) -> bytes:
    """Lowest bytes of all, then the next ones, as many as the largest needs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return packed(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpacked_numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(unpacked(data), np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8").reshape(n)


def slice_lists(t: pa.ListArray, pairs: Pairs, side: int) -> pa.RecordBatch | None:
    """``LISTS`` of the pairs of some rows' terms; places among the terms follow their order."""
    coded = t.flatten().dictionary_encode()
    n = len(coded.dictionary)
    order = pa.compute.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    words = coded.dictionary.take(pa.array(order)).to_pylist()
    found = pairs(rank[coded.indices.to_numpy()], np.repeat(np.arange(len(t)), np.diff(t.offsets.to_numpy())), n)
    if not len(found):
        return None
    found.sort()
    first = np.flatnonzero(np.diff(found, prepend=-1))
    counts = np.diff(np.append(first, len(found))).astype(np.int32)
    found = found[first]
    del first
    a, b = (x.astype(np.int32) for x in np.divmod(found, n))
    del found
    part = np.array([zlib.crc32(w.encode()) for w in words]) % side
    sizes, place, told = np.bincount(part, minlength=side), np.empty(n, np.int64), []
    for p in range(side):
        own = np.flatnonzero(part == p)
        place[own] = np.arange(len(own))
        told.append(packed("\n".join(words[i] for i in own).encode()))
    cell = (part.astype(np.int32)[a] * side + part.astype(np.int32)[b]).astype(np.min_scalar_type(side * side))
    order = np.argsort(cell, kind="stable")
    a, b, counts, cell = a[order], b[order], counts[order], cell[order].astype(np.int32)
    del order
    key = place[a] * sizes[part][b] + place[b]
    del a, b
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    rows = []
    for x, z in zip(starts, np.append(starts[1:], len(cell)), strict=True):
        p, q = divmod(int(cell[x]), side)
        rows.append((int(cell[x]), int(z - x), told[p], told[q], packed_numbers(np.diff(key[x:z], prepend=0)), packed_numbers(counts[x:z])))
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["cell", "n", "src", "dst", "gaps", "counts"])


class Cell:
    """A cell's pairs so far, added up: its words in the order they came, and keys and counts of its pairs in order of the keys."""

    def __init__(self) -> None:
        self.words = {c: pa.array([], pa.string()) for c in ("src", "dst")}
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _codes(self, c: str, told: list[pa.Array]) -> list[np.ndarray]:
        flat = pa.concat_arrays(told)
        fresh = flat.filter(pa.compute.invert(pa.compute.is_in(flat, value_set=self.words[c]))).unique()
        self.words[c] = pa.concat_arrays([self.words[c], fresh])
        return np.split(pa.compute.index_in(flat, value_set=self.words[c]).to_numpy().astype(np.int64), np.cumsum([len(x) for x in told])[:-1])

    def add(self, rows: list[dict]) -> None:
        told = {c: [pa.array(unpacked(r[c]).decode().split("\n"), pa.string()) for r in rows] for c in self.words}
        src, dst = (self._codes(c, told[c]) for c in ("src", "dst"))
        keys, counts = [self.keys], np.concatenate([self.counts, *(unpacked_numbers(r["counts"], r["n"]) for r in rows)])
        for r, x, y in zip(rows, src, dst, strict=True):
            a, b = np.divmod(np.cumsum(unpacked_numbers(r["gaps"], r["n"])), len(y))
            keys.append(x[a] << 32 | y[b])
        self.keys = np.concatenate(keys)
        del keys, a, b
        order = np.argsort(self.keys)
        self.keys, counts = self.keys[order], counts[order]
        del order
        first = np.flatnonzero(np.diff(self.keys, prepend=-1))
        self.keys, self.counts = self.keys[first], np.add.reduceat(counts, first)

    def pairs(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.keys), ROWS_OUT):
            here = self.keys[at : at + ROWS_OUT]
            yield pa.RecordBatch.from_arrays([self.words["src"].take(pa.array(here >> 32)), self.words["dst"].take(pa.array(here & 0xFFFFFFFF)), pa.array(self.counts[at : at + ROWS_OUT])], names=["src", "dst", "weight"])


def cell_counts(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """src, dst, weight of a cell from all its lists, which are added up ``LISTED`` pairs at a time, so that a task holds the cell's distinct pairs and so many more."""
    cell, held, size = Cell(), [], 0
    for r in rows:
        if held and size + r["n"] > LISTED:
            cell.add(held)
            held, size = [], 0
        held.append(r)
        size += r["n"]
    if held:
        cell.add(held)
    del held
    yield from cell.pairs()


def counted_pairs(found: DataFrame, pairs: Pairs, most: Callable[[np.ndarray], np.ndarray], expected: float) -> DataFrame:
    """src, dst, weight: how often ``pairs`` of the terms of each row (t) meet in all. ``most`` tells from rows' lengths how many pairs they have at most; about ``expected`` are in the lists of all slices."""
    cores = found.sparkSession.sparkContext.defaultParallelism
    side = max(1, math.ceil(math.sqrt(max(expected / CELL, min(4 * cores, 16 * expected / CELL)))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t")
            run = np.cumsum(most(np.diff(t.offsets.to_numpy()).astype(np.int64)))
            at = 0
            while at < len(t):
                end = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                lists = slice_lists(pa.concat_arrays([t[at:end]]), pairs, side)
                if lists is not None:
                    yield lists
                at = end

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({c: batch.column(c)[i].as_py() for c in batch.schema.names} for batch in batches for i in range(batch.num_rows))
        for _, own in groupby(rows, lambda r: r["cell"]):
            yield from cell_counts(own)

    lists = found.select("t").mapInArrow(cut, LISTS)
    return lists.repartitionById(side * side, "cell").sortWithinPartitions("cell").mapInArrow(added, "src string, dst string, weight long")


def slice_parts(t: pa.ListArray, parts: int, name: int) -> pa.RecordBatch:
    """``PARTS`` of some rows' distinct terms."""
    coded = t.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    part = np.array([zlib.crc32(w.encode()) for w in words], np.int64) % parts
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    code = np.empty(len(words), np.int64)
    code[order] = np.arange(len(words))  # those of a part follow each other
    key = np.unique(np.repeat(np.arange(len(t)), np.diff(t.offsets.to_numpy())) * max(1, len(words)) + code[coded.indices.to_numpy()])
    row, code = np.divmod(key, max(1, len(words)))
    own = part[order][code]
    at = np.argsort(own.astype(np.min_scalar_type(parts)), kind="stable")
    row, code, cuts, rows = row[at], code[at], np.searchsorted(own[at], np.arange(parts + 1)), []
    for p in range(parts):
        a, z = cuts[p], cuts[p + 1]
        if z > a:
            gaps = np.diff(row[a:z] * (ends[p + 1] - ends[p]) + code[a:z] - ends[p], prepend=0)
            rows.append((p, name, int(z - a), packed("\n".join(words[i] for i in order[ends[p] : ends[p + 1]]).encode()), packed_numbers(gaps)))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "slice", "n", "words", "gaps"])


def _words(slices: list[tuple[int, bytes, bytes]]) -> tuple[pa.Array, list[np.ndarray]]:
    """Words of a part, and the place of each slice's words among them."""
    told = [pa.array(unpacked(words).decode().split("\n"), pa.string()) for _, words, _ in slices]
    coded = pa.concat_arrays(told).dictionary_encode()
    return coded.dictionary, np.split(coded.indices.to_numpy(), np.cumsum([len(x) for x in told])[:-1])


def _entries(n: int, gaps: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a slice's terms, in order, and codes of these."""
    row, place = np.divmod(np.cumsum(unpacked_numbers(gaps, n)), len(codes))
    return row, codes[place]


def part_pairs(left: list[tuple[int, bytes, bytes]], right: list[tuple[int, bytes, bytes]] | None) -> Iterator[pa.RecordBatch]:
    """src, dst, weight of the terms of two parts, or of one with itself, from the n, words and gaps of their slices in the same order."""
    words, codes = _words(left)
    others, other_codes = (words, codes) if right is None else _words(right)
    code, start, met, dst, held = [], [], [], [], 0
    for i, (n, _, gaps) in enumerate(left):
        row, own = _entries(n, gaps, codes[i])
        if right is None:  # in each row in the order of the part, so that a pair has one order in all slices
            row, own = np.divmod(np.sort(row * len(words) + own), len(words))
        there, other = (row, own) if right is None else _entries(right[i][0], right[i][2], other_codes[i])
        ends = np.cumsum(np.bincount(there, minlength=int(row[-1]) + 1))
        first, last = np.arange(1, n + 1) if right is None else np.append(0, ends)[row], ends[row]
        some = last > first
        code.append(own[some].astype(np.int32))
        met.append((last - first)[some].astype(np.int32))
        start.append((first + held)[some].astype(np.uint32))
        dst.append(other.astype(np.int32))
        held += len(other)
    code = np.concatenate(code)  # one after another, and in place, as these are the most that a task holds
    start = np.concatenate(start)
    met = np.concatenate(met)
    dst = np.concatenate(dst)
    if not len(code):
        return
    # terms of the left part in order, each with its rows' terms of the right one
    order = code.astype(np.int64)
    order <<= 32
    order |= np.arange(len(code), dtype=np.uint32)
    order.sort()
    order &= 0xFFFFFFFF
    code = code[order]
    start = start[order]
    met = met[order]
    told = pa.concat_arrays([words] if right is None else [words, others])
    order, rank = pa.compute.sort_indices(told).to_numpy(), np.empty(len(told), np.int32)
    rank[order] = np.arange(len(told))
    told, ranks, other_ranks = told.take(pa.array(order)), rank[: len(words)], rank[-len(others) :]
    firsts = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
    run, n = np.append(0, np.cumsum(met, dtype=np.int64)), len(others)
    at, till, term = 0, run[firsts], code[firsts[:-1]]
    while at < len(term):  # a tile of as many terms as have TILE pairs, or of one
        end = int(np.searchsorted(till, till[at] + TILE, "right")) - 1
        a, base = int(firsts[at]), int(term[at])
        end = max(at + 1, min(end, int(np.searchsorted(term, base + (1 << 32) // n))))  # keys have four bytes
        sums, last = np.zeros(n, np.int64) if end == at + 1 else None, int(firsts[end])
        while a < last:
            z = min(last, max(a + 1, int(np.searchsorted(run, run[a] + TILE, "right")) - 1))
            many = met[a:z]
            places = np.repeat(start[a:z] - (run[a:z] - run[a]), many) + np.arange(run[z] - run[a])
            if sums is None:
                keys = np.repeat((code[a:z] - base).astype(np.uint32) * np.uint32(n), many)
                keys += dst[places].astype(np.uint32)
            else:
                sums += np.bincount(dst[places], minlength=n)
            a = z
        if sums is None:
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=keys[0] + 1))
            weight, (x, y) = np.diff(np.append(first, len(keys))), np.divmod(keys[first], np.uint32(n))
        else:
            y = np.flatnonzero(sums)
            weight, x = sums[y], np.zeros(len(y), np.uint32)
        x, y = ranks[x.astype(np.int64) + base], other_ranks[y]
        src, dst_ = np.minimum(x, y), np.maximum(x, y)
        for cut in range(0, len(src), ROWS_OUT):
            here = slice(cut, cut + ROWS_OUT)
            yield pa.RecordBatch.from_arrays([told.take(pa.array(src[here])), told.take(pa.array(dst_[here])), pa.array(weight[here].astype(np.int64))], names=["src", "dst", "weight"])
        at = end


def pairs_within(found: DataFrame, expected: float) -> DataFrame:
    """src, dst, weight: how many rows (t) have both of two terms. About ``expected`` distinct terms are in all rows.

    Each row's terms are shuffled once; each task reads two of the parts, so what is read, but not what is written, grows with their number."""
    cores = found.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(max(expected / PART, min(math.sqrt(8 * cores), 16 * expected / PART))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.ListArray] = []
        made = size = 0
        for batch in batches:
            at, ends = 0, batch.column("t").offsets.to_numpy()
            while at < batch.num_rows:
                end = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + TERMS_AT_ONCE - size, "right")) - 1))
                held.append(batch.column("t")[at:end])
                size, at, task = size + int(ends[end] - ends[at]), end, batch.column("task")[0].as_py()
                if size >= TERMS_AT_ONCE or at < batch.num_rows:
                    yield slice_parts(pa.concat_arrays(held), parts, task << 32 | made)
                    held, made, size = [], made + 1, 0
        if held:
            yield slice_parts(pa.concat_arrays(held), parts, task << 32 | made)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int], list[dict]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                cells.setdefault((row["p"], row["q"]), []).append(row)
        for p, q in list(cells):
            rows = cells.pop((p, q))
            yield from part_pairs([(r["n"], r["words"], r["gaps"]) for r in rows], None if p == q else [(r["m"], r["others"], r["steps"]) for r in rows])

    dealt = found.select("t", F.spark_partition_id().alias("task")).mapInArrow(cut, PARTS).repartitionById(parts, "part")
    left = dealt.select(F.col("part").alias("p"), "slice", "n", "words", "gaps")
    same = F.col("part") == F.col("p")  # a part with itself is read once
    right = dealt.select("part", F.col("slice").alias("other"), F.col("n").alias("m"), F.col("words").alias("others"), F.col("gaps").alias("steps"))
    both = left.hint("shuffle_replicate_nl").join(right, (F.col("slice") == F.col("other")) & (F.col("p") <= F.col("part")))
    cell = both.select("p", F.col("part").alias("q"), "n", "words", "gaps", F.when(~same, F.col("m")).alias("m"), F.when(~same, F.col("others")).alias("others"), F.when(~same, F.col("steps")).alias("steps"))
    return cell.mapInArrow(counted, "src string, dst string, weight long")
