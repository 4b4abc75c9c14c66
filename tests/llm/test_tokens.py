"""Token shards, prefix counts, packing and byte-level BPE against the libraries themselves."""

import base64
import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from cases import BYTES, ODD, WORD, counted, crc, documents, no_docs, odd_docs, word_ids  # noqa: E402

from tessera.llm import encoding, op01_repair, op02_prefix_counts, op03_curve_packing, op05_byte_bpe, registry  # noqa: E402

ALPHABET = [*"aaabbe  \n\t\r\x1c\x1f\x85\xa0'sstld.!!--012東नकǕİßＡ🙂\x00", "<|endoftext|>", "hello", "</w>"]


def odd_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_joined_pieces_have_the_librarys_ids():
    tokenizer = encoding.library(WORD)
    told = ["é́'s", "́a", "\x7fa", "b\x7f", "한", "ᆫ", "ẍ́", "ΑΣ", "İ", "'s", "it's.", "x" * 3000, "a1b22--c", "<|endoftext|>x", "<|", "~", "\x00"]
    pieces = [*told, *(p for t in odd_texts(3000) for p in encoding.cut_at_spaces(t))]
    flat, sizes = encoding.JoinedEncoder(tokenizer)(pieces)
    want = [x.ids for x in tokenizer.encode_batch(pieces, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


# 1: shards


def check_shards(rows, pairs):
    assert counted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == counted((i, len(ids), crc(ids)) for i, ids in ((i, word_ids(t, 1)) for i, t in pairs))
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i))


def test_shards_of_all_documents(spark, sf):
    rows = registry.queries()["op1_repair_shards"](spark, sf).collect()
    check_shards(rows, [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()])


def test_shards_of_odd_rows(spark):
    check_shards(op01_repair.read_documents(op01_repair.write_shards(odd_docs(spark), WORD)).collect(), ODD)
    assert op01_repair.read_documents(op01_repair.write_shards(no_docs(spark), WORD)).count() == 0


@pytest.mark.parametrize("most_id", [40, 50_000, 3_000_000])
def test_repair_is_exact_and_random_access(most_id):
    r = np.random.default_rng(most_id)
    phrases = [r.integers(0, most_id, 5) for _ in range(20)]
    docs = [np.concatenate([phrases[k] for k in r.integers(0, 20, r.integers(1, 40))]) for _ in range(60)] + [np.array([3]), np.full(500, 7)]
    sizes = np.array([len(d) for d in docs])
    shard = op01_repair.Shard(*op01_repair.shard_row(np.arange(len(docs)), np.concatenate(docs), sizes))
    assert len(shard.rules) and len(shard.symbols) < sizes.sum() / 2
    for i, want in enumerate(docs):
        assert (shard.document(i) == want).all()
        for a in (0, len(want) // 3, len(want)):
            for z in (a, a + 1, len(want)):
                assert (shard.ids(i, a, z) == want[a:z]).all()
    # lengths are those of the rules' expansions, and no rule spans two documents
    assert [len(shard.expand(np.array([shard.first + k], shard.symbols.dtype))) for k in range(len(shard.rules))] == shard.lengths.tolist()
    assert shard.documents()[1].tolist() == sizes.tolist()


# 2: counts


def test_counts_of_all_documents(spark, sf):
    rows = registry.queries()["op2_prefix_counts"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    want = [(i, len(t.encode()), n := len(word_ids(t)), n > 2048) for i, t in texts.items()]
    assert counted(r[:4] for r in rows) == counted(want) and any(r["over_limit"] for r in rows)
    for r in rows:
        text = texts[r["doc_id"]]
        assert len(word_ids(text[: r["cut_at"]])) <= 2048 and (len(word_ids(text[: r["cut_at"] + 1])) > 2048) == r["over_limit"]


def test_counts_are_answered_from_what_is_stored(spark, sf, monkeypatch):
    """Stored tables whose counts are cleared give no tokens, so the columns come from nowhere else."""
    keep = op02_prefix_counts.stored
    monkeypatch.setattr(op02_prefix_counts, "stored", lambda df, name: keep(df.withColumn("deltas", F.lit(bytearray(b"\1\1"))), name))
    assert {(r["n_tokens"], r["cut_at"]) for r in registry.queries()["op2_prefix_counts"](spark, sf).collect()} == {(2, 2)}


def test_counts_of_odd_rows(spark):
    counts = op02_prefix_counts.prefix_counts(odd_docs(spark), WORD)
    rows = op02_prefix_counts.budget_answers(counts, 2048).collect()
    assert counted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == counted((i, len((t or "").encode()), len(word_ids(t))) for i, t in ODD)
    assert all(len(r["deltas"]) == len(dict(ODD)[r["doc_id"]] or "") for r in counts.collect())
    assert op02_prefix_counts.prefix_counts(no_docs(spark), WORD).count() == 0


MARKS = [*"ab'sreté한각e\u0301\u0323\u0344\u1161\u11a8\u0958\u093c\u0b92\u0bd7İΣ\u212b\u0f73。!!5", "e\u0301", "\u1100\u1161\u11a8", "'"]


def marked_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(MARKS) for _ in range(r.randint(1, 16))) for _ in range(n)]


def test_a_long_word_that_normalization_changes():
    """Linear in the word: at the square of it this would take hours."""
    r = random.Random(8)
    for text in ("".join(r.choice("東京都大阪府日本語文字列") for _ in range(99_000)) + "e\u0301" + "漢" * 1000, "abce\u0301" * 20_000, "e" + "\u0301" * 20_000):
        counts = op02_prefix_counts.counter(WORD).word_counts(text)
        assert len(counts) == len(text) + 1
        for k in [1, 2, 3, 4, 5, 999, 1000, 1001, 1002, len(text) // 2, len(text) - 1001, len(text) - 1000, len(text) - 1, len(text)]:
            assert counts[k] == len(word_ids(text[:k])), k


def test_every_prefix_has_the_librarys_count():
    texts = [*odd_texts(300), *marked_texts(1500), ODD[0][1], ODD[7][1]]
    for text, deltas in zip(texts, op02_prefix_counts.PrefixCounter(WORD).deltas(texts), strict=True):
        want = [len(word_ids(text[:i])) for i in range(len(text) + 1)]
        raw = deltas.tobytes()
        assert [op02_prefix_counts.tokens_before(raw, i) for i in range(len(text) + 1)] == want, text
        for budget in (0, 1, 3):
            assert op02_prefix_counts.longest_prefix(raw, budget) == max(i for i, n in enumerate(want) if n <= budget), text


# 3: packing


def check_pieces(rows, pairs, length=4096):
    ids = {i: word_ids(t, 2) for i, t in pairs}
    by_sequence = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sum(p["length"] for p in by_sequence[r["sequence_id"]]) and r["length"] > 0
        by_sequence[r["sequence_id"]].append(r)
        mine = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(mine) and r["ids_crc32"] == crc(mine[r["start"] : r["start"] + r["length"]])
    sizes = [sum(p["length"] for p in by_sequence[k]) for k in sorted(by_sequence)]
    assert sorted(by_sequence) == list(range(len(sizes))) and all(n == length for n in sizes[:-1]) and all(n <= length for n in sizes[-1:])
    # along the sequences each document's pieces follow one another from 0 to its end
    open_at, seen = None, Counter()
    for r in (p for k in sorted(by_sequence) for p in by_sequence[k]):
        assert (r["doc_id"], r["start"]) == open_at if open_at else r["start"] == 0
        stop = r["start"] + r["length"]
        open_at = (r["doc_id"], stop) if stop < r["doc_tokens"] else None
        seen[r["doc_id"]] += stop == r["doc_tokens"]
    assert open_at is None and seen == Counter(i for i, _ in pairs)


def test_pieces_of_all_documents(spark, sf):
    rows = registry.queries()["op3_curve_packing"](spark, sf).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()])


def test_pieces_of_odd_rows(spark):
    pieces = op03_curve_packing.pack_documents(odd_docs(spark), WORD).cache()
    check_pieces(pieces.collect(), ODD)
    packed = op03_curve_packing.sequences(pieces).collect()
    assert sum(len(r["ids"]) for r in packed) == sum(len(word_ids(t, 2)) for _, t in ODD)
    assert op03_curve_packing.pack_documents(no_docs(spark), WORD).count() == 0


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_go_to_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = op03_curve_packing.hilbert_key(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_like_documents_get_close_keys():
    table = op03_curve_packing.projection(1 << 16)
    texts = ["red green blue " * 40, "red green blue " * 40 + "red", "seven ships sailed south " * 40]
    ids = [word_ids(t, 2) for t in texts]
    keys = op03_curve_packing.curve_keys(np.concatenate(ids).astype(np.uint16), np.array([len(x) for x in ids]), table)
    assert abs(keys[0] - keys[1]) < abs(keys[0] - keys[2])


# 5: byte-level BPE


@pytest.fixture(scope="module")
def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def char_spans(text, ids, bpe):
    """(start, end, split) of each token, by the characters that its bytes touch."""
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    at, out = 0, []
    for token in bpe.decode_tokens_bytes(ids):
        a, z = at, at + len(token)
        out.append((of_byte[a], of_byte[z - 1] + 1, a > 0 and of_byte[a - 1] == of_byte[a] or z < len(of_byte) and of_byte[z - 1] == of_byte[z]))
        at = z
    return out


def digests(doc_id, text, bpe):
    text = text or ""
    ids = bpe.encode_ordinary(text)
    found = char_spans(text, ids, bpe)
    offsets = zlib.crc32(np.array([x[0] for x in found] + [x[1] for x in found], "<u4").tobytes())
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), len(text), sum(x[2] for x in found), offsets


def test_decoding_goes_through_the_byte_table():
    """With two characters of the table exchanged, what is decoded has these two bytes exchanged."""
    bpe = op05_byte_bpe.ByteBpe(BYTES, public_tokenizers.PATTERN)
    ids, _ = bpe.encode(["a tale at last"])
    bpe.byte_of[[ord("a"), ord("t")]] = [ord("t"), ord("a")]
    assert bpe.decode(ids) == b"t atle ta ltsa"


def test_byte_bpe_of_all_documents(spark, sf, reference_bpe):
    rows = registry.queries()["op5_byte_bpe"](spark, sf).collect()
    assert counted(rows) == counted(digests(r["doc_id"], r["text"], reference_bpe) for r in documents(spark, sf).collect())


def test_byte_bpe_of_odd_rows(spark, reference_bpe):
    rows = op05_byte_bpe.round_trip_digests(odd_docs(spark), BYTES, public_tokenizers.PATTERN).collect()
    assert counted(rows) == counted(digests(i, t, reference_bpe) for i, t in ODD)
    assert op05_byte_bpe.round_trip_digests(no_docs(spark), BYTES, public_tokenizers.PATTERN).count() == 0
    encoded = op05_byte_bpe.encode_documents(odd_docs(spark), BYTES, public_tokenizers.PATTERN)
    back = op05_byte_bpe.decode_ids(encoded, BYTES, public_tokenizers.PATTERN).collect()
    assert counted(back) == counted((i, t or "") for i, t in ODD)


def test_byte_bpe_offsets_and_split_characters(reference_bpe):
    bpe = op05_byte_bpe.ByteBpe(BYTES, public_tokenizers.PATTERN)
    for text in [*odd_texts(400, 9), "a🙂b東京 नमस्ते", "x" * 5000]:
        ids, _ = bpe.encode([text])
        assert ids.tolist() == reference_bpe.encode_ordinary(text), text
        raw, at = text.encode(), bpe.byte_offsets(ids)
        assert [raw[a:z] for a, z in zip(at, at[1:], strict=False)] == reference_bpe.decode_tokens_bytes(ids.tolist())
        assert bpe.char_offsets(ids).tolist() == [[a, z] for a, z, _ in char_spans(text, ids.tolist(), reference_bpe)]
        stream = op05_byte_bpe.StreamDecoder(bpe)
        assert "".join(stream.push([i]) for i in ids) + stream.push([], last=True) == text
    assert bpe.decode_text(np.array([bpe.ranks[b"\xf0"]])) == "�"
