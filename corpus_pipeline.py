"""A corpus pipeline of four stages: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame. ``run`` writes a stage's rows as Parquet
in the folder all executors share and reads them back as the next stage's ``docs``. All but the
last give the rows they keep with the columns of ``documents``, whatever else these are named.

Defined results: each stage says what it does with null and empty texts. Of rows that repeat an id and
a text, the first two stages judge each alike and the third keeps one. An empty table gives an empty
result at every stage. Very long texts are read whole by all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op03_curve_packing, op04_rules, op08_language, op09_near_dups
from tessera.llm.encoding import default_path
from tessera.llm.shared import held_out_fold, read, stored

#: A document must be of its main language for this share of its letters.
LEAST_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble calls good (score of 0.5 or more).

    Null and empty texts are scored like others; a score of just 0.5 stays; without labels every score
    is 0.5 and all rows stay."""
    return op04_rules.good_documents(docs, read(spark, sf_dir, "labels"), learned=~held_out_fold(F.col("doc_id")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language has at least half of the letters.

    Null and empty texts and those without letters have no language and go; where two languages have
    just half each, the document stays."""
    model = op08_language.learn(op08_language.learned_fold(docs))
    return op08_language.in_one_language(docs, model, LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest doc_id.

    Null and empty texts are one class; a null id counts as the largest; rows equal in id and text are
    one document."""
    return op09_near_dups.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens along the curve.

    Null and empty texts have their end id only; equal texts follow each other in the order of their rows."""
    return op03_curve_packing.pack_documents(docs, default_path(), with_ids=False)


STAGES = [("quality classifier", quality), ("language ID", language), ("near-dedup", near_duplicates), ("packing", packing)]

#: SQL cannot train the classifiers or encode tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs
