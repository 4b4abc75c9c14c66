"""Language identification: script ranges, per-word scores, and Viterbi over a text's words.

A word is a run of letters. Its score for a language is the sum of log probabilities of its letter
trigrams (each letter with its neighbours, lower-cased, hashed to ``BUCKETS``), counted over the
learned documents. The script of its first letter narrows the candidates to the languages that use
the script. Viterbi finds the best sequence of languages when each switch costs ``SWITCH``; runs of
words of one language are the spans; the query gives them as ``start-end:language``, in characters. A text's language has the most letters, and its share of the
letters is the score (equal shares: the language that sorts first).

The trigram and script counts cover every learned document; they are summed by Spark and are as
many as languages times buckets, however large the corpus.

Defined results: null texts and texts without a letter are ``und`` with score 0; very long texts are
judged by all of their words; with nothing
learned every text is ``und``; repeated rows are judged each; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_of, held_out_fold, id_and_text, read, slices

BUCKETS = 1 << 16
SWITCH = 10.0
SMOOTH = 0.5
SLICE_BYTES = 4 << 20
SCRIPT_SHARE = 0.01  # a language uses a script that has this share of its letters
EXCLUDED = np.float32(-1e4)

#: First code points of script blocks, in order, with the script from there on.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0x10000, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})

_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, 0 if it is no letter, and its script."""
    if not _TABLES:
        lower = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                small = c.lower()
                lower[i] = ord(small) if len(small) == 1 else i
        firsts = [first for first, _ in SCRIPTS]
        names = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.uint8)
        script = names[np.searchsorted(firsts, np.arange(sys.maxunicode + 1), "right") - 1]
        _TABLES.append((lower, script))
    return _TABLES[0]


@dataclass
class Words:
    """Trigram bucket of each letter, and where the words and their texts start."""

    buckets: np.ndarray
    scripts: np.ndarray  # of each word
    firsts: np.ndarray  # of each word, its first letter
    letters: np.ndarray  # in each word
    places: np.ndarray  # of each word in the joined texts
    counts: np.ndarray  # words of each text


def words_of(texts: list[str]) -> Words:
    lower, script = tables()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    small = lower[points]
    inside = small > 0
    at = np.flatnonzero(inside)
    padded = np.concatenate([small, [np.uint32(0)]])
    before = np.where(at > 0, padded[at - 1], np.uint32(0))
    key = before * np.uint32(0x9E3779B1) ^ padded[at] * np.uint32(0x85EBCA77) ^ padded[at + 1] * np.uint32(0xC2B2AE3D)
    buckets = ((key * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int32)
    firsts = np.flatnonzero(before == 0)
    places = at[firsts]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(buckets, script[points[places]], firsts, np.diff(np.concatenate([firsts, [len(at)]])), places, np.diff(np.searchsorted(places, starts)))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages) log probabilities
    allowed: np.ndarray  # (scripts, languages)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of ``docs``; buckets from BUCKETS on count letters of a script."""
    ddl = "lang string, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, "text", SLICE_BYTES):
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                w = words_of([texts[i] for i in np.flatnonzero(langs == lang)])
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                total[:BUCKETS] += np.bincount(w.buckets, minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(w.scripts, w.letters, len(SCRIPT_NAMES)).astype(np.int64)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], schema=arrow_of(ddl))

    return docs.select("lang", "text").mapInArrow(run, ddl).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> Model:
    """Model of all rows of ``docs`` that have a text and a lang."""
    known = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = trigram_counts(known).toPandas()
    languages = sorted(set(counts["lang"]))
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    table[counts["bucket"], [languages.index(x) for x in counts["lang"]]] = counts["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    weights = np.log((grams + SMOOTH) / (grams.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, weights, allowed)


def word_scores(words: Words, model: Model) -> np.ndarray:
    if not len(words.firsts):
        return np.zeros((0, len(model.languages)), np.float32)
    scores = np.add.reduceat(model.weights[words.buckets], words.firsts, axis=0)
    return scores + np.where(model.allowed[words.scripts], np.float32(0), EXCLUDED)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word. All texts go forward together, one word a step, the longest first."""
    n, k = scores.shape
    order = np.argsort(-counts, kind="stable")
    first, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    going = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    kind = np.uint8 if k <= 256 else np.uint32
    state, back, own = np.zeros((len(order), k), np.float32), np.empty((n, k), kind), np.arange(k, dtype=kind)
    for t, active in enumerate(going.tolist()):
        at, now = first[:active] + t, state[:active]
        if t:
            best = now.max(axis=1, keepdims=True)
            stay = now >= best - switch
            back[at] = np.where(stay, own, now.argmax(axis=1)[:, None])
            now = np.where(stay, now - best, -switch)
        state[:active] = now + scores[at]
    path = np.empty(n, kind)
    last = state.argmax(axis=1).astype(kind)
    for t in range(len(going) - 1, -1, -1):
        active = going[t]
        at = first[:active] + t
        path[at] = last[:active]
        if t:
            last[:active] = back[at, last[:active]]
    return path


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, Words, np.ndarray]:
    """Language and share of each text, its words and their languages."""
    words, k = words_of(texts), max(1, len(model.languages))
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), words, np.zeros(len(words.firsts), np.uint8)
    path = viterbi(word_scores(words, model), words.counts)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    letters = np.bincount(doc * k + path, words.letters, len(texts) * k).reshape(-1, k)
    total, top = letters.sum(axis=1), letters.argmax(axis=1)
    share = np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)
    return [model.languages[i] if n else "und" for i, n in zip(top, total, strict=True)], share, words, path


def runs_of(texts: list[str], words: Words, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of runs of words of one language in each text; start, end (in the text's characters) and language of each run."""
    doc = np.repeat(np.arange(len(texts)), words.counts)
    first = np.flatnonzero((np.diff(path.astype(np.int64), prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    last = np.concatenate([first[1:], [len(path)]])[: len(first)] - 1
    own = doc[first]
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])[own]
    return np.bincount(own, minlength=len(texts)), words.places[first] - base, (words.places + words.letters)[last] - base, path[first]


def spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, language) of the runs of words of one language, in characters."""
    if not model.languages:
        return []
    _, _, words, path = predict([text], model)
    return [(a, z, model.languages[i]) for a, z, i in zip(*(x.tolist() for x in runs_of([text], words, path)[1:]), strict=True)]


def slice_bytes(model: Model) -> int:
    """Bytes of text worked at once; a word has a score for each language."""
    return max(1 << 16, SLICE_BYTES * 4 // max(4, len(model.languages)))


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and, with_spans, span_start, span_end and span_lang."""
    ddl = "doc_id long, lang_pred string, score double" + ", span_start array<int>, span_end array<int>, span_lang array<string>" * with_spans
    least = slice_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_of(ddl)
        for b in slices(batches, "text", least):
            texts = b.column("text").to_pylist()
            found, share, words, path = predict(texts, model)
            columns = [b.column("doc_id"), pa.array(found, pa.string()), pa.array(share, pa.float64())]
            if with_spans:
                counts, *parts = runs_of(texts, words, path) if model.languages else (np.zeros(len(texts), np.int64), *[np.zeros(0, np.int64)] * 3)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                langs = pa.DictionaryArray.from_arrays(pa.array(parts[2], pa.int32()), pa.array(model.languages, pa.string())).cast(pa.string())
                columns += [pa.ListArray.from_arrays(ends, x) for x in (pa.array(parts[0], pa.int32()), pa.array(parts[1], pa.int32()), langs)]
            yield pa.record_batch(columns, schema=schema)

    return id_and_text(docs).mapInArrow(run, ddl)


def in_one_language(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of ``docs``, with their columns, whose language has at least ``least`` of the letters; ``und`` goes."""
    size = slice_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", size):
            found, share, *_ = predict(b.column("text").fill_null("").to_pylist(), model)
            yield b.filter(pa.array([lang != "und" and bool(s >= least) for lang, s in zip(found, share, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned_fold(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out_fold(F.col("doc_id")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(learned_fold(docs)), with_spans=True)
    told = F.transform(F.arrays_zip("span_start", "span_end", "span_lang"), lambda x: F.concat(x["span_start"].cast("string"), F.lit("-"), x["span_end"].cast("string"), F.lit(":"), x["span_lang"]))
    return found.select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("span_lang").cast("long").alias("n_spans"), F.array_join(told, " ").alias("spans"))
