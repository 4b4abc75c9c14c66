"""Lexical retrieval: postings and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from .impact import B, K1, MOST_WORDS, SHARD, Counted, counted_rows, impact_index, topk
from .sizes import materialized, small, spread
from .text import tokenize

#: Documents of a shard at least, where there are fewer shards than cores.
LEAST = 2_048


def postings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, term, tf."""
    return tokenize(docs, id_col).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def doc_freq(found: DataFrame) -> DataFrame:
    """Documents of each term; postings have a row for each document and term."""
    return found.groupBy("term").agg(F.count("*").alias("df"))


def weighted(docs: DataFrame, words: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Postings term, doc_id, part (what each adds to a BM25 score), and the number of documents; with ``words`` (term), only of these terms.

    The texts are read and cut once. What is kept of them, with a row without a term for each
    document, is written; document frequencies, the number of documents and their mean length all
    come from that. Null texts count as documents without words."""
    tokens = spread(docs.select("doc_id", "text")).select("doc_id", terms(F.col("text")).alias("t")).select("doc_id", F.greatest(F.size("t"), F.lit(0)).cast("long").alias("dl"), F.explode(F.concat(F.coalesce("t", F.array()), F.array(F.lit(None).cast("string")))).alias("term"))
    if words is not None:
        asked = words.select("term").unionByName(words.sparkSession.range(1).select(F.lit(None).cast("string").alias("term"))).withColumnRenamed("term", "word")
        tokens = tokens.join(small(asked), F.col("term").eqNullSafe(F.col("word")), "left_semi")
    kept = materialized(tokens.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf")))
    corpus = kept.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl") > 0, F.col("tf")))).alias("avgdl")).first()
    n, found = corpus["n"], kept.where("term is not null")
    weights = materialized(doc_freq(found).select("term", idf(n, F.col("df")).alias("idf")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(corpus["avgdl"])))
    return found.join(small(weights), "term").select("term", "doc_id", part.alias("part")), n


def weighted_postings(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    return weighted(docs, words)[0]


def cut(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents (doc_id, text) as doc_id and t, their terms, and about how many parts these have."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cores, parts = docs.sparkSession.sparkContext.defaultParallelism, max(1, docs.rdd.getNumPartitions())
    return spread(docs).select("doc_id", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("t")), max(parts, min(cores, 32 * parts))


def idf(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def index(docs: DataFrame, words: DataFrame | None = None, shard: int = SHARD) -> Counted | DataFrame:
    """The stored index of ``docs``, made once for any number of questions; with ``words``, only of these terms.

    Tasks make lists of the documents they read, so no posting is a row and nothing but a small file's texts and the terms'
    frequencies is shuffled. Where an id comes again, its postings add up in an index of impacts instead."""
    n, cores, (found, parts) = docs.count(), docs.sparkSession.sparkContext.defaultParallelism, cut(docs)
    shards = max(1, -(-n // shard), min(cores, n // LEAST))  # smaller ones where a few would not keep the cores busy
    rows = counted_rows(found, parts, shards, shard)
    if words is not None:
        asked = words.select("term").unionByName(words.sparkSession.range(1).select(F.lit("").alias("term")))
        rows = rows.join(small(asked, MOST_WORDS), "term", "left_semi")  # so that lists stay where they are
    rows = materialized(rows)
    whole = rows.where("term = ''")
    if whole.select(F.explode("docs").alias("d")).groupBy("d").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return impact_index(*weighted(docs, words), shard=shard)
    corpus = whole.select(F.explode("dls").alias("dl")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("mean")).first()
    idfs = materialized(rows.where("term != ''").groupBy("term").agg(F.sum("df").alias("df")).select("term", idf(corpus["n"], F.col("df")).alias("idf")))
    return Counted(rows, idfs, corpus["mean"] or 1.0, shards)


def bm25_scores(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """question_id, doc_id, score for all pairs that share a term. For the k best, ``bm25_topk`` makes far fewer.

    Only postings of question terms are kept before anything else is joined. Null and empty questions
    have no terms and so no rows."""
    asked = materialized(tokenize(questions, "question_id").select("question_id", "term").distinct())
    met = weighted_postings(docs, asked.select("term").distinct()).join(small(asked), "term")
    return met.groupBy("question_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def best(scores: DataFrame, k: int, group: str = "question_id", item: str = "doc_id") -> DataFrame:
    """The k best of each group, ties to the smaller item; Spark cuts groups before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(group, "rank", item, "score")


def bm25_topk(questions: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """question_id, rank, doc_id, score of the k best documents, from an index of the questions' terms."""
    asked = materialized(tokenize(questions, "question_id").select("term").distinct())
    return best(topk(questions, index(docs, asked), k), k)


def filtered_retrieval(questions: DataFrame, docs: DataFrame, k: int = 5, lang: str | None = None, source: str | None = None) -> DataFrame:
    """BM25 within the documents of a language or source; the filter reaches the scan."""
    for name, value in (("lang", lang), ("source", source)):
        docs = docs if value is None else docs.where(F.col(name) == value)
    return bm25_topk(questions, docs, k)
