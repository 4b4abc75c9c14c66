"""Phrase collocations by Apriori passes over n-grams, level by level.

A text is lower-cased in A-Z and split at ``. , ; : ! ?`` and line ends into pieces, and these at spaces
and tabs into words. Level k counts the phrases of k words of each language that occur ``LEAST`` times
or more. A phrase of k words can be that frequent only if its first and its last k - 1 words are, so
pass k emits a phrase only where level k - 1 holds both; phrases are counted in the task's batches
before they are shuffled, so no phrase is a hot key. What each pass broadcasts of level k - 1 is a map of ``BITS``
bits, set at the hashes of its phrases: its size is fixed, however large the level, and a phrase that
a chance bit lets through is counted like others and then dropped, so counts are exact.

Level tables then give every number that a phrase's cuts need: cut after its first words, a phrase
that occurs a times, in n words, of parts that occur l and r times, scores floor(1000 a n / (l r)); the
lowest cut counts, of equal ones the shortest first part. A phrase is dropped if a longer one
that contains it occurs as often. The best ``TOP`` of each language are given.

Defined results: null texts count as empty; a null language is ``und``; long texts are read whole, a piece
of them at a time; repeated rows count as often as they occur; ties in score go to the more frequent
phrase, then to the smaller in the order of UTF-8 bytes; a language without a frequent phrase gives
no row, and so does an empty table; other columns are not read. Counts are exact up to 2**63, scores
are worked out in decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .op09_near_dups import mixed, powers
from .shared import arrow_of, read, slices, stored

LEAST, LONGEST, TOP = 100, 5, 2000
BITS = 26  # of an index: the map has 2**26 bits, 8 MB
SLICE_BYTES = 4 << 20
PIECE_BYTES = 64 << 20  # of a long text that is cut into words at once

_U = np.uint64
_KIND = np.zeros(256, np.uint8)  # 0 inside a word, 1 between words, 2 between pieces
_KIND[[*b" \t"]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a binary array."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, sizes = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], sizes)
    parts = (data.astype(_U) + _U(1)) * powers(0x9E3779B97F4A7C15, int(sizes.max(initial=1)))[place]
    return mixed(np.add.reduceat(parts, ends[:-1] - ends[0]) + sizes.astype(_U)) if len(words) else np.empty(0, _U)


def phrase_hashes(hashes: list[np.ndarray], lang: str) -> np.ndarray:
    """Hashes of phrases from those of their first, second, ... words."""
    total = np.full(len(hashes[0]), xxhash.xxh64_intdigest(lang, 1), _U)
    for h in hashes:
        total = mixed(total * _U(0xD6E8FEB86659FD93) + h)
    return total


class Words:
    """The words of some texts: ids of equal words are equal; pieces are numbered on."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        kind = _KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        begins, sizes = edge[::2], edge[1::2] - edge[::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[begins]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
        coded = found.dictionary_encode()
        self.ids, self.dictionary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.hashes = word_hashes(self.dictionary)

    def phrases(self, k: int, lang: str, frequent: np.ndarray | None) -> tuple[list[pa.Array], np.ndarray]:
        """The words of each phrase of k words whose parts may be frequent, and how often it occurs."""
        at = np.arange(max(0, len(self.ids) - k + 1))
        at = at[self.piece[at] == self.piece[at + k - 1]]
        if k > 1:
            shorter = lambda s: has_bits(frequent, phrase_hashes([self.hashes[self.ids[s + j]] for j in range(k - 1)], lang))
            at = at[shorter(at)]
            at = at[shorter(at + 1)]
        code, distinct = self.ids[at], len(self.dictionary)
        for j in range(1, k):  # codes of the first j + 1 words, as small as they are many
            code = code * len(self.dictionary) + self.ids[at + j]
            if j + 1 < k and distinct * len(self.dictionary) ** 2 >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                distinct = int(code.max(initial=0)) + 1
            else:
                distinct *= len(self.dictionary)
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        return [self.dictionary.take(pa.array(self.ids[at[first] + j])) for j in range(k)], n


def has_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> _U(64 - (64 * len(bits)).bit_length() + 1)
    return (bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1


def hash_map(level: DataFrame, k: int) -> Broadcast:
    """Broadcast map of 2**BITS bits, those at the hashes of the level's phrases set."""
    ddl = "word long, bits long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, int] = {}
        for b in batches:
            for lang in pc.unique(b.column("lang")).to_pylist():
                own = b.filter(pc.equal(b.column("lang"), lang))
                words = pc.split_pattern(own.column("phrase"), " ").flatten().cast(pa.binary())
                hashes = word_hashes(words).reshape(-1, k)
                for at in (phrase_hashes(list(hashes.T), lang) >> _U(64 - BITS)).tolist():
                    bits[at >> 6] = bits.get(at >> 6, 0) | 1 << (at & 63)
        found = np.array(list(bits.values()), np.uint64).view(np.int64)
        yield pa.record_batch([pa.array(list(bits), pa.int64()), pa.array(found)], schema=arrow_of(ddl))

    # at most 2**(BITS - 6) rows
    rows = level.select("lang", "phrase").mapInArrow(run, ddl).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(1 << BITS - 6, _U)
    whole[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return level.sparkSession.sparkContext.broadcast(whole)


def cut(text: bytes) -> list[bytes]:
    """A long text cut at ends of pieces into parts of about PIECE_BYTES."""
    parts, rest = [], text
    while len(rest) > PIECE_BYTES:
        end = np.flatnonzero(_KIND[np.frombuffer(rest[PIECE_BYTES:], np.uint8)] == 2)
        if not len(end):
            break
        parts.append(rest[: PIECE_BYTES + int(end[0])])
        rest = rest[PIECE_BYTES + int(end[0]) :]
    return [*parts, rest]


def level(docs: DataFrame, k: int, frequent: Broadcast | None, least: int) -> DataFrame:
    """Stored rows lang, phrase, f: phrases of k words that occur ``least`` times or more; with k = 1 also a row for each lang with a null phrase and the number of all words."""
    ddl = "lang string, phrase string, f long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, bits = arrow_of(ddl), frequent and frequent.value
        for b in slices(batches, "text", SLICE_BYTES):
            texts: dict[str, list[list[bytes]]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for i, part in enumerate(cut(text.encode())):
                    groups = texts.setdefault(lang, [[]])
                    if i:
                        groups.append([])
                    groups[-1].append(part)
            for lang, groups in texts.items():
                for group in groups:
                    words = Words(group)
                    found, n = words.phrases(k, lang, bits)
                    phrases = pc.binary_join_element_wise(*found, b" ") if k > 1 else found[0]
                    phrases, n = phrases.cast(pa.string()), pa.array(n, pa.int64())
                    if k == 1:
                        phrases, n = pa.concat_arrays([phrases, pa.nulls(1, pa.string())]), pa.concat_arrays([n, pa.array([len(words.ids)])])
                    yield pa.record_batch([pa.array([lang] * len(n), pa.string()), phrases, n], schema=schema)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(run, ddl).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return stored(counts.where((F.col("f") >= least) | F.col("phrase").isNull()), f"level{k}")


def levels(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f, k of all frequent phrases, and lang, n."""
    first = level(docs, 1, None, least)
    found, below = [first.where("phrase is not null").withColumn("k", F.lit(1))], first.where("phrase is not null")
    for k in range(2, longest + 1):
        bits = hash_map(below, k - 1)
        below = level(docs, k, bits, least)
        bits.unpersist()
        found.append(below.withColumn("k", F.lit(k)))
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    return both, stored(first.where("phrase is null").select("lang", F.col("f").alias("n")), "totals")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    found, totals = levels(docs, longest, least)
    candidates = found.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", F.split("phrase", " ").alias("w"))
    piece = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", piece(F.lit(1), F.col("cut")).alias("one"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    part = lambda name, its: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(its))
    met = cuts.join(part("one", "l"), ["lang", "one"]).join(part("rest", "r"), ["lang", "rest"])
    lowest = met.groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("cut", "l", "r")).alias("cuts"))  # at most longest - 1
    big = lambda c: c.cast("decimal(38,0)")
    score = lambda c: F.call_function("div", big(F.lit(1000)) * big(F.col("a")) * big(F.col("n")), big(c["l"]) * big(c["r"]))
    # what is counted by language has few rows, and so is joined last
    scored = lowest.join(totals, "lang").withColumn("best", F.array_min(F.transform("cuts", lambda c: F.struct(score(c).alias("score"), c["cut"].alias("cut"), c["l"].alias("l"), c["r"].alias("r")))))
    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: piece(i, m))))
    inside = candidates.where("k > 2").select("lang", "a", F.explode(starts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS one, array_to_string(w[c + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
judged AS (SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = one JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS i FROM judged) WHERE i = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT j.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest j LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a) WHERE rank <= 2000
"""
