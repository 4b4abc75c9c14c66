"""Rows that operators must stand, and plain versions of what they compute."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.op04_rules import COLUMNS

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Columns of the input that have the names operators use inside.
CLASHING = "row key part shard at band block rep comp times tie media before range inside first_doc class_id keep learned _label _hash _kept_id _kept_hash kept_id kept_hash id hash copy copies its _text chars score rank held_out n_bytes n_tokens ids bands shingles text_hash tensors deltas feature".split()
CLASHING += COLUMNS

#: Null id, null and empty texts, repeated rows and ids, ties, white space, odd characters, one long text.
ODD = [
    (1, "A quick brown fox jumps over the lazy dog, and <|endoftext|> then it stops. It's fine."),
    (2, None), (3, ""), (None, "a row without an id"), (4, "the same row"), (4, "the same row"), (5, "the same row"),
    (6, "Été à 東京, नमस्ते दुनिया!\x1cnext\x00end 🙂🙂🙂"), (7, " \n\t  \n"), (8, "word " * 60_000 + "x" * 3000), (9, "!!!!!!!!! aaaaaaaaaaaa"),
]


def with_clashes(df):
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING if c not in df.columns))


def odd_docs(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return with_clashes(df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}))


def no_docs(spark):
    return odd_docs(spark, [])


def same_rows_left(kept, docs):
    """Every row kept is a row of ``docs``, in all columns."""
    assert kept.schema == docs.schema
    return not counted(kept.collect()) - counted(docs.collect())


def tables_of(path, **frames):
    """A folder of tables for registered queries."""
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


_TOKENIZERS = {}


def word_ids(text, end=None):
    if WORD not in _TOKENIZERS:
        _TOKENIZERS[WORD] = Tokenizer.from_file(WORD)
    return _TOKENIZERS[WORD].encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def counted(rows):
    return Counter(tuple(r) for r in rows)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
