"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding.

The library works on characters, so each byte is mapped to a printable character; a rank file
becomes its vocabulary, and each way to build a token from two others a merge of that token's rank.
Where several merges make one token, rank order alone doesn't say which comes first, so pieces with
such a choice are settled by ``merge_bytes``, which merges by rank and then from the left.

A text is cut before every space that follows a character other than white space; no match of the
splitting pattern crosses such a cut, so the library sees each distinct cut once. Byte offsets of
the tokens are running sums of their lengths; character offsets count the bytes that start one.
Decoding looks up the ids' strings in the library's vocabulary and reverses the byte table: each
printable character goes back to its byte. A token may hold part of a character, so bytes are put
together before they are read as UTF-8, and ``StreamDecoder`` holds back an unfinished character.

Defined results: a null or empty text has no ids and decodes to no bytes; very long texts are encoded
whole, cut by cut; special strings are
ordinary text; repeated rows are encoded each; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .encoding import PieceMemo, default_path, flattened, id_type
from .op02_prefix_counts import byte_letters
from .shared import arrow_of, id_and_text, read, slices

SLICE_BYTES = 2 << 20
_CUT = re.compile(r"(?<=\S)(?= )")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the lowest rank is merged first, the leftmost of equal ones."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours' starts, n and -1 at the ends
    heap: list[tuple[int, int, int]] = []  # rank, start, end of what a merge would make

    def offer(start: int) -> None:
        if start >= 0 and after[start] < n:
            end = after[after[start]]
            rank = ranks.get(piece[start:end])
            if rank is not None:
                heapq.heappush(heap, (rank, start, end))

    for i in range(n - 1):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, start, end = heapq.heappop(heap)
        if gone[start] or after[start] >= n or after[after[start]] != end:
            continue
        middle = after[start]
        gone[middle], after[start] = 1, end
        if end < n:
            before[end] = start
        offer(start)
        offer(before[start])
    return [ranks[piece[i : after[i]]] for i in range(n) if not gone[i]]


class ByteBpe:
    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        letters = byte_letters()
        text = lambda raw: "".join([letters[b] for b in raw])
        merges = []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    merges.append((rank, left, right, token[:i], token[i:]))
        merges.sort(key=lambda x: x[:3])
        model = models.BPE(vocab={text(t): r for t, r in self.ranks.items()}, merges=[(text(a), text(b)) for *_, a, b in merges], ignore_merges=True)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = max(self.ranks.values()) + 1
        strings = [""] * size
        for token, rank in self.library.get_vocab().items():
            strings[rank] = token
        self.lengths = np.fromiter(map(len, strings), np.int32, size)
        #: the vocabulary's strings one after another, as code points, and the byte of each code point
        self.table = np.fromiter(map(ord, "".join(strings)), np.uint16)
        self.byte_of = np.zeros(1 + max(map(ord, letters)), np.uint8)
        self.byte_of[[ord(c) for c in letters]] = np.arange(256)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.digits = [b"%d," % i for i in range(size)]
        self.memo = PieceMemo(self.cut, lambda cuts: flattened(self.encode_cuts(cuts)), id_type(size))

    def cut(self, text: str) -> list[str]:
        """Cuts before each space that follows something other than white space."""
        parts = text.split(" ")
        if "  " in text or "\n " in text or "\t " in text or not text.isascii() or "\r" in text or "\v" in text or "\f" in text or text[:1] == " ":
            return _CUT.split(text) if text else []
        if not text:
            return []
        return [parts[0], *[" " + x for x in parts[1:]]]

    def encode_cuts(self, cuts: list[str]) -> list[list[int]]:
        found = [x.ids for x in self.library.encode_batch_fast(cuts, add_special_tokens=False)]
        for i, cut in enumerate(cuts):
            if _CHOICE.search(cut):
                found[i] = [t for piece in self.pattern.findall(cut) for t in merge_bytes(piece.encode(), self.ranks)]
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.memo.ids(texts)

    def byte_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte position of each token's start, and the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids], dtype=np.int64)])

    def char_offsets(self, ids: np.ndarray) -> np.ndarray:
        """(start, end) characters of each token; tokens that share a split character overlap."""
        return self.spans(self.decoded(ids), self.byte_offsets(ids))

    @staticmethod
    def spans(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Characters of the tokens that lie between the byte offsets ``at`` of ``raw``."""
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])
        return np.stack([np.maximum(begins[np.minimum(at[:-1] + 1, len(raw))] - 1, 0), begins[at[1:]]], axis=1)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids' strings, each character turned back by the byte table."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.byte_of[self.table[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decoded(ids).tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


#: Repeats of one character, where several merges of one token can overlap.
_CHOICE = re.compile(r"(.)\1\1", re.DOTALL)


class StreamDecoder:
    """Decodes ids as they arrive; bytes of an unfinished character wait for the next ones."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe, self.rest = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids, last: bool = False) -> str:
        return self.rest.decode(self.bpe.decode(np.asarray(ids, np.int64)), last)


_MADE: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = ByteBpe(path, pattern)
    return _MADE[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, and the (start, end) characters of each id."""
    ddl = "doc_id long, ids array<int>, starts array<int>, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = byte_bpe(path, pattern), arrow_of(ddl)
        for b in slices(batches, "text", SLICE_BYTES):
            flat, sizes = bpe.encode(b.column("text").to_pylist())
            ids = np.split(flat, np.cumsum(sizes)[:-1])
            spans = [bpe.char_offsets(x) for x in ids]
            yield pa.record_batch([b.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], schema.types[1]), *(pa.array([x[:, k].astype(np.int32) for x in spans], schema.types[1]) for k in (0, 1))], schema=schema)

    return id_and_text(docs).mapInArrow(run, ddl)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of a frame with doc_id and ids; null ids give null, invalid UTF-8 U+FFFD."""
    ddl = "doc_id long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = byte_bpe(path, pattern), arrow_of(ddl)
        for b in batches:
            texts = [None if x is None else bpe.decode_text(np.asarray(x, np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, ddl)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the bytes decoded from them, and of the offsets.

    ``n_chars`` are the decoded characters, ``split_tokens`` the tokens that begin or end inside one, and
    ``offsets_crc32`` covers the tokens' starts and then their ends in characters, as little-endian
    unsigned 32-bit integers."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long, split_tokens long, offsets_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = byte_bpe(path, pattern), arrow_of(ddl)
        for b in slices(batches, "text", SLICE_BYTES):
            flat, sizes = bpe.encode(b.column("text").to_pylist())
            raw, at, ends = bpe.decoded(flat), bpe.byte_offsets(flat), np.cumsum(sizes)
            spans = bpe.spans(raw, at)
            # a token is split from what follows or comes before it where a byte in the middle of a character starts one
            inside = np.concatenate([(raw[at[:-1]] & 0xC0) == 0x80, [False]])
            broken = np.concatenate([[0], np.cumsum(inside[:-1] | inside[1:])])
            first = ends - sizes
            base = np.concatenate([spans[:, 0], [0]])[first]  # where each text's characters start
            chars = np.where(sizes > 0, np.concatenate([[0], spans[:, 1]])[ends] - base, 0)
            spans = (spans - np.repeat(base, sizes)[:, None]).astype("<u4")
            offsets = [zlib.crc32(spans[a:z, 1].tobytes(), zlib.crc32(spans[a:z, 0].tobytes())) for a, z in zip(first.tolist(), ends.tolist(), strict=True)]
            digits, view = [bpe.digits[i] for i in flat.tolist()], memoryview(raw)
            written = [hashlib.sha256(b"".join(digits[e - n : e])[:-1]).hexdigest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            decoded = [hashlib.sha256(view[at[e - n] : at[e]]).hexdigest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes), pa.array(written), pa.array(decoded), pa.array(chars.astype(np.int64)), pa.array(broken[ends] - broken[first]), pa.array(offsets, pa.int64())], schema=schema)

    return id_and_text(docs).mapInArrow(run, ddl)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(read(spark, sf_dir, "documents"), default_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
