"""Quality by a sparse ensemble of rules.

Every text gets the statistics in ``STATISTICS``. Shallow trees of a random forest, trained by Spark
on the labelled rows, are taken apart: each path from a root to a node is a conjunction of
conditions on statistics, a rule. A logistic regression with an L1 penalty (lasso) weighs the rules
and leaves most at zero. The rest are compiled into one Spark column expression, so scoring is a
projection over the statistics.

Trees and weights are trained by Spark over all labelled rows of the learning fold. Each tree of the
forest draws its own ``SUBSAMPLE`` of them, as random forests do; the weights are fitted to all.
Nothing is sent to the driver but the rules (at most ``TREES`` times 2 ** (``DEPTH`` + 1)).

Defined results: null and empty texts have statistics of 0 and get a score like others; labels that
are null or name no document are not used; of several labels for one id the largest counts, and of
several texts with one id the one whose statistics sort first is learned from; with labels of one
kind only, or none, every score is that kind's share (0.5 without any); repeated rows are scored
each; very long texts are read whole, in time and memory linear in their length; an empty table gives an empty result; other columns of the input are not read, whatever their
names, and ``good_documents`` gives them back as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .op09_near_dups import word_hashes
from .shared import arrow_of, held_out_fold, read, slices, stored

STATISTICS = [
    "chars", "words", "lines", "word_length", "line_length", "upper_share", "digit_share", "mark_share",
    "symbol_share", "space_share", "exclaims_a_word", "pipes_a_word", "stops_a_word", "distinct_share",
    "repeat_share", "line_repeat_share", "top_symbol_words",
]
COLUMNS = ["_stat_" + s for s in STATISTICS]
TREES, DEPTH = 24, 4
SUBSAMPLE = 0.7
PENALTY = 2e-4
SEED = 11
SLICE_BYTES = 1 << 19
FIRED_ROWS = 1000

_KIND = np.zeros((256, 8), bool)  # letters, upper, digits, marks, symbols, spaces, "!", "|"
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = [_i >= 128 or _c.isalpha(), _i < 128 and _c.isupper(), _i < 128 and _c.isdigit(), 32 < _i < 127 and not _c.isalnum(), _c in "#$%&*@^~<>{}[]\\|=+_", _c in " \t\r\n\v\f", _c == "!", _c == "|"]


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, STATISTICS); shares have the denominators 1 where there is nothing to share."""
    raws = [t.encode() for t in texts]
    sizes = np.array([len(r) + 1 for r in raws])
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    starts = np.cumsum(sizes) - sizes
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), starts).astype(float)
    letters, upper, digits, marks, symbols, spaces, exclaims, pipes = (count(_KIND[:, k][data]) for k in range(8))
    spaces -= 1  # the one that joins
    starts_char = count((data & 0xC0) != 0x80) - 1
    breaks = data == 10
    lines = count(breaks)
    stops = count(data == ord("."))
    # words for repetition are alphanumeric runs, for length and marks runs of anything but space
    space = _KIND[:, 5][data]
    tokens = count(~space & np.concatenate([[True], space[:-1]]))
    last_of_token = ~space & np.concatenate([space[1:], [True]])
    symbol_ends = count(last_of_token & _KIND[:, 4][data])
    hashes, words = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), words)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc, same, len(texts))
    distinct = _distinct(hashes, doc, len(texts))
    line_hash = _line_hashes(data, breaks)
    line_doc = np.repeat(np.arange(len(texts)), lines.astype(int))
    line_distinct = _distinct(line_hash, line_doc, len(texts))
    per = lambda a, b: a / np.maximum(b, 1)
    text_chars = np.maximum(starts_char, 0)
    return np.stack([
        text_chars, tokens, lines, per(text_chars - spaces, tokens), per(text_chars, lines), per(upper, letters), per(digits, text_chars), per(marks, text_chars),
        per(symbols, text_chars), per(spaces, text_chars), per(exclaims, tokens), per(pipes, tokens), per(stops, tokens), per(distinct, words),
        per(repeats, words), 1 - per(line_distinct, lines), per(symbol_ends, tokens),
    ], axis=1)


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    keys = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)


def _line_hashes(data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each line, whatever its place."""
    ends = np.flatnonzero(breaks)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts + 1
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    mix = (data.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    mix ^= mix >> np.uint64(29)
    return np.add.reduceat(mix * np.uint64(0xBF58476D1CE4E5B9), starts)


def with_statistics(docs: DataFrame, keep: Column) -> DataFrame:
    """``keep`` under its name, and one double column for each statistic of ``text``."""
    rows = docs.select(keep, F.col("text").alias("_text"))
    schema = T.StructType([rows.schema.fields[0], *(T.StructField(c, T.DoubleType()) for c in COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", SLICE_BYTES):
            table = statistics(b.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in table.T)], names=[b.schema.names[0], *COLUMNS])

    return rows.mapInArrow(run, schema)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row, stored."""
    return stored(with_statistics(docs, F.col("doc_id").cast("long").alias("doc_id")), "statistics")


def tree_paths(printed: str) -> list[tuple[tuple[int, str, float], ...]]:
    """Conditions (statistic, "<=" or ">", threshold) from the root to each node of a printed forest."""
    paths, above = set(), []
    for line in printed.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if found:
            depth = len(found[1])
            above = [x for x in above if x[0] < depth] + [(depth, (int(found[2]), found[3], float(found[4])))]
            paths.add(tightest(tuple(x[1] for x in above)))
        elif re.match(r" *Tree \d+", line):
            above = []
    return sorted(paths)


def tightest(conditions: tuple[tuple[int, str, float], ...]) -> tuple[tuple[int, str, float], ...]:
    """One condition for each statistic and side."""
    best: dict[tuple[int, str], float] = {}
    for i, op, at in conditions:
        best[i, op] = at if (i, op) not in best else (min if op == "<=" else max)(best[i, op], at)
    return tuple(sorted((i, op, at) for (i, op), at in best.items()))


def rule_column(rule: tuple[tuple[int, str, float], ...]) -> Column:
    out = F.lit(True)
    for i, op, at in rule:
        c = F.col(COLUMNS[i])
        out = out & (c <= at if op == "<=" else c > at)
    return out


def fired(training: DataFrame, label: str, rules: list[tuple]) -> DataFrame:
    """The label as a double and, for each rule, 1 where it holds, else 0. ``FIRED_ROWS`` rows are worked at once."""
    ddl = "label double, fired array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_of(ddl)
        for b in batches:
            for at in range(0, b.num_rows, FIRED_ROWS):
                part = b.slice(at, FIRED_ROWS)
                table = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS], axis=1)
                holds = np.ones((len(table), len(rules)))
                for k, rule in enumerate(rules):
                    for i, op, bound in rule:
                        holds[:, k] *= table[:, i] <= bound if op == "<=" else table[:, i] > bound
                yield pa.record_batch([part.column("label"), pa.array(list(holds), schema.types[1])], schema=schema)

    return training.select(F.col(label).cast("double").alias("label"), *COLUMNS).mapInArrow(run, ddl)


def fit_rules(training: DataFrame, label: str) -> tuple[float, list[tuple[float, tuple]]]:
    """Intercept and weighted rules from a frame with COLUMNS and a 0/1 label."""
    said = training.agg(F.count(label).alias("n"), F.sum(label).alias("ones")).first()
    n, ones = said["n"], said["ones"] or 0
    if not n or ones in (0, n):
        share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share))), []
    assembled = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(training.withColumn("label", F.col(label).cast("double")))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=SUBSAMPLE, seed=SEED).fit(assembled)
    rules = tree_paths(forest.toDebugString)
    if not rules:
        share = ones / n
        return float(np.log(share / (1 - share))), []
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=60, tol=1e-5)
    model = lasso.fit(fired(training, label, rules).select("label", array_to_vector("fired").alias("features")))
    weights = model.coefficients.toArray()
    return float(model.intercept), [(float(w), r) for w, r in zip(weights, rules, strict=True) if w]


def score_column(intercept: float, rules: list[tuple[float, tuple]]) -> Column:
    """The rules' weights summed into a probability. Additions are nested as a balanced tree, which keeps the expression shallow."""
    terms = [F.lit(intercept), *(F.when(rule_column(r), F.lit(w)).otherwise(F.lit(0.0)) for w, r in rules)]
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def learned_score(found: DataFrame, labels: DataFrame, label: str = "quality", learned: Column | None = None) -> Column:
    """The score as a column over COLUMNS, from ``found`` (doc_id and COLUMNS) and ``labels``.

    Labels of rows where ``learned`` (a condition on doc_id) is false are not looked at."""
    told = labels.where(F.col(label).isin(0, 1) & (F.lit(True) if learned is None else learned)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("_label"))
    one = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("its")).select("doc_id", "its.*")
    training = stored(one.join(told, "doc_id"), "training")
    return score_column(*fit_rules(training, "_label"))


def good_documents(docs: DataFrame, labels: DataFrame, learned: Column | None = None, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, with their columns, that score ``least`` or more. The second pass over the texts is without a shuffle.

    A row travels as one struct, so its columns can't clash with those made here."""
    score = learned_score(document_statistics(docs), labels, learned=learned)
    return with_statistics(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).where(score >= least).select("row.*")


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = held_out_fold(F.col("doc_id"))
    found = document_statistics(read(spark, sf_dir, "documents"))
    score = learned_score(found, read(spark, sf_dir, "labels"), learned=~fold)
    scored = found.select("doc_id", fold.alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
