"""Exact token counts at every prefix of a text, by dynamic programming over its words.

White space separates words, and a word's tokens depend on no other word. For each distinct word a
table holds, at every prefix, the token that ends there and the number of tokens so far: of the
vocabulary's strings that end at a position, the right one is the one that byte pair encoding keeps
apart from the token before it, and there is exactly one. New words are worked in sorted order, so a word takes
over the table of the one before it as far as they begin alike. A prefix that stops inside a word ends in
a word-end token, so its count is that of a shorter inner prefix plus one. A text's counts are those
of its words, kept as one signed byte of change for each character (``deltas``); their running sum
answers how many tokens text[:i] has, where to cut for a budget, and what a range costs, without
encoding anything again.

The counts are those of the library for ``text[:i]``. Special strings in a text count as one token
where they are complete and as ordinary text before. A word that normalization changes is
normalized once. Most of its prefixes normalize to a prefix of that; where one does not (it stops
within a composed character) the few characters that differ are counted as a branch off the word's
table, so such words too cost time in proportion to their length. (Only a run of combining marks
that canonical ordering rearranges costs the square of the run's length.)

The query stores the counts of every prefix and works out its columns from what it reads back.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each;
an empty table gives an empty result; other columns of the input are not read. One more character
changes a count by less than the longest token has bytes; should a vocabulary with tokens above 127
bytes ever change one by more than a signed byte holds, OverflowError is raised.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .encoding import SPACE, cut_at_spaces, default_path
from .shared import arrow_of, id_and_text, read, slices, stored

SLICE_BYTES = 4 << 20
MOST_WORDS = 800_000
MOST_PIECES = 400_000
MOST_PAIRS = 500_000
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_CONTRACTIONS = {"'re", "'ve", "'ll", "'s", "'t", "'m", "'d"}
_RUNS = {True: regex.compile(r"\p{L}*"), False: regex.compile(r"[^\s\p{L}\p{N}]*")}
_LETTER = regex.compile(r"\p{L}")
_END = "</w>"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b if b in plain else spare)
        spare += b not in plain
    return out


@cache
def joining() -> frozenset[str]:
    """Characters that may compose with one before them: second parts of canonical decompositions, and Hangul vowels and finals."""
    parts = (unicodedata.decomposition(chr(i)).split() for i in range(0x30000))
    return frozenset(chr(int(x[1], 16)) for x in parts if len(x) == 2 and x[0][0] != "<") | frozenset(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))


def lowered(text: str) -> str:
    """Lower case of each character by itself, as the library's normalizer has it."""
    return "".join([c.lower() for c in text])


def segments(word: str) -> list[str]:
    """Parts of a word that compose by themselves: NFC of the word is that of its parts, one after another."""
    starts = [0]
    for i in range(1, len(word)):
        if word[i] < "\u0300":
            starts.append(i)
        else:
            first = unicodedata.normalize("NFD", word[i])[0]
            if not unicodedata.combining(first) and first not in joining():
                starts.append(i)
    return [word[a:z] for a, z in zip(starts, [*starts[1:], len(word)], strict=True)]


class PrefixCounter:
    def __init__(self, path: str) -> None:
        said = json.load(open(path, encoding="utf-8"))
        model = said["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge_rank = {pair: i for i, pair in enumerate(pairs)}
        #: rank and halves of the merge that makes a token; single characters have none
        self.made_by = {a + b: (i, a, b) for i, (a, b) in reversed(list(enumerate(pairs)))}
        # inner tokens, and word-end tokens under their text without the mark
        inner = {x for x in model["vocab"] if not x.endswith(_END)}
        final = {x.removesuffix(_END): x for x in model["vocab"] if x.endswith(_END)}
        self.tokens = {x: (x if x in inner else None, final.get(x)) for x in inner | final.keys()}
        #: length of the longest token that ends in two given characters
        self.longest: dict[str, int] = {}
        for x in self.tokens:
            self.longest[x[-2:]] = max(len(x), self.longest.get(x[-2:], 1))
        self.letters = byte_letters()
        specials = [x["content"] for x in said["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials)))
        #: positions that a branch looks back, one more than the longest token
        self.reach = max(self.longest.values()) + 1
        self.apart: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def _kept_apart(self, a: str, b: str) -> bool:
        """Whether encoding keeps tokens a and b beside each other.

        Undoes the merges inside both, the latest first: at each time the two symbols that then met
        at the border must not have had a merge that came before the one undone last (of equal
        merges the left one came first)."""
        rank, made = self.merge_rank, self.made_by
        undone = (1 << 60, 0)
        while True:
            across = rank.get((a, b))
            if across is not None and (across, 1) < undone:
                return False
            left, right = made.get(a), made.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[0] > right[0]:
                undone, a = (left[0], 1), left[2]
            else:
                undone, b = (right[0], 2), right[1]

    def _apart(self, a: str, b: str) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > MOST_PAIRS:
                self.apart.clear()
            found = self.apart[a, b] = self._kept_apart(a, b)
        return found

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of piece[:k] for k = 1 ..., where the piece is one match of the splitting pattern."""
        if piece in _CONTRACTIONS:
            return [sum(self._count(x)[-1] for x in _PIECE.findall(piece[:k])) for k in range(1, len(piece) + 1)]
        return self._count(piece)

    def _count(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is None:
            known = self._work([piece])[0]
        return known

    def learn(self, words: list[str]) -> None:
        """Work out the pieces of new words, in sorted order."""
        new = {x for w in words for x in _PIECE.findall(w.lower()) if len(x) <= 24} - self.pieces.keys()
        pieces = sorted(new)
        if len(self.pieces) + len(pieces) > MOST_PIECES:
            self.pieces.clear()
        self.pieces.update(zip(pieces, self._work(pieces), strict=True))

    def _mapped(self, piece: str, raw: bytes) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in raw])

    def _grow(self, s: str, raw: bytes, first: int, last: list[str], count: list[int], ended: list[int]) -> None:
        """Carry the tables on from position ``first`` to the end of ``s``.

        They hold, at each position, the token that ends there inside a word, the tokens so far, and
        the tokens if the word ended there."""
        tokens, apart, longest, n = self.tokens, self.apart, self.longest, len(s)
        for k in range(first, n + 1):
            opened, closed = k < n, k == n or raw[k] & 0xC0 != 0x80
            ended.append(0)
            for i in range(max(0, k - longest.get(s[max(0, k - 2) : k], 1)), k):  # the longest candidate first
                token = tokens.get(s[i:k])
                if token is None:
                    continue
                inner, final = token
                left = last[i]
                if opened and inner is not None:
                    ok = not i or apart.get((left, inner))
                    if self._apart(left, inner) if ok is None else ok:
                        last.append(inner)
                        count.append(count[i] + 1)
                        opened = False
                if closed and final is not None:
                    ok = not i or apart.get((left, final))
                    if self._apart(left, final) if ok is None else ok:
                        ended[k] = count[i] + 1
                        closed = False
                if not (opened or closed):
                    break

    def _work(self, pieces: list[str]) -> list[list[int]]:
        found = []
        last, count, ended, before = [""], [0], [0], ""
        for piece in pieces:
            raw = piece.encode()
            s = self._mapped(piece, raw)
            n, k = len(s), 0
            most = min(n, len(before))
            while k < most and s[k] == before[k]:
                k += 1
            before, k = s, max(k, 1)
            del last[k:], count[k:], ended[k:]
            self._grow(s, raw, k, last, count, ended)
            found.append([x for x in ended if x] if len(s) > len(piece) else ended[1:])
        return found

    def _total(self, text: str) -> int:
        return sum(self._count(x)[-1] for x in _PIECE.findall(text))

    def _changed_counts(self, word: str) -> list[int]:
        """Counts of word[:k], k = 0 ..., for a word that normalization changes."""
        parts = segments(word)
        made = [lowered(unicodedata.normalize("NFC", x)) for x in parts]
        main = "".join(made)
        pieces = [(m.start(), m[0]) for m in _PIECE.finditer(main)]
        starts, counts = [a for a, _ in pieces], [0]
        for _, piece in pieces:
            base = counts[-1]
            counts += [base + n for n in self.piece_counts(piece)]
        tables: dict[int, tuple] = {}

        def branch(p: int, tail: str) -> int:
            """Tokens of main[:p] + tail, whose end is another than that of main."""
            at = bisect_right(starts, p - 1) - 1
            # an apostrophe close by may make a contraction with what follows
            while at > 0 and p - starts[at - 1] <= 2 and main[starts[at - 1]] == "'":
                at -= 1
            q, piece = pieces[at] if at >= 0 else (0, "")
            if p - q <= 2:
                return counts[q] + self._total(main[q:p] + tail)
            lead = "" if piece in _CONTRACTIONS else _RUNS[bool(_LETTER.match(piece))].match(tail)[0]
            if not lead:
                return counts[p] + self._total(tail)
            if at not in tables:
                raw = piece.encode()
                s, last, count, ended = self._mapped(piece, raw), [""], [0], [0]
                self._grow(s, raw, 1, last, count, ended)
                tables[at] = s, raw, last, count, ended
            s, raw, last, count, ended = tables[at]
            b = len(main[q:p].encode())
            low, more = max(0, b - self.reach), lead.encode()
            ended = ended[low:b]
            self._grow(s[low:b] + "".join([self.letters[x] for x in more]), raw[low:b] + more, b - low, last[low:b], count[low:b], ended)
            return counts[q] + ended[-1] + self._total(tail[len(lead) :])

        out, p = [0], 0
        for part, whole in zip(parts, made, strict=True):
            tail, along = "", True  # ``along``: the tail is the beginning of ``whole``
            for j, c in enumerate(part):
                same = j > 1 and unicodedata.combining(c) and unicodedata.combining(c) == unicodedata.combining(part[j - 1]) and tail.endswith(part[j - 1]) and not unicodedata.decomposition(c)
                if same:  # it stands after a mark of its class that did not compose, so it neither moves nor composes
                    small = c.lower()
                    along = along and whole.startswith(small, len(tail))
                    tail += small
                else:
                    tail = lowered(unicodedata.normalize("NFC", part[: j + 1]))
                    along = whole.startswith(tail)
                out.append(counts[p + len(tail)] if along else branch(p, tail))
            p += len(whole)
        return out

    def _plain_counts(self, word: str) -> list[int]:
        """Counts of word[:k], k = 0 ..., for a word without special strings."""
        if not word.isascii():
            lower = lowered(word)
            if len(lower) != len(word) or not unicodedata.is_normalized("NFC", word):
                return self._changed_counts(word)
        else:
            lower = word.lower()
        out, base = [0], 0
        for piece in _PIECE.findall(lower):
            out += [base + n for n in self.piece_counts(piece)]
            base = out[-1]
        return out

    def word_counts(self, word: str) -> list[int]:
        out, at, base = [0], 0, 0
        for found in self.special.finditer(word):
            # up to the last character of a special string it is ordinary text
            counts = self._plain_counts(word[at : found.end() - 1])
            out += [base + n for n in counts[1:]]
            base += counts[found.start() - at] + 1
            out.append(base)
            at = found.end()
        return out + [base + n for n in self._plain_counts(word[at:])[1:]]

    def word_deltas(self, word: str) -> bytes:
        """Change of the count at each character; a byte holds it, for the count changes by a few tokens at most."""
        counts = self.word_counts(word)
        try:
            return struct.pack(f"{len(word)}b", *map(sub, counts[1:], counts))
        except struct.error as e:
            raise OverflowError("a count changed by more than a signed byte") from e

    def deltas(self, texts: list[str]) -> list[np.ndarray]:
        """Change of the token count at each character of each text."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        cuts, known = [cut_at_spaces(t) for t in texts], self.words
        new = {w for words in cuts for w in words if w not in known}
        self.learn([w for w in new if len(w) <= 64])
        fresh = {w: self.word_deltas(w) for w in new}
        known.update((w, d) for w, d in fresh.items() if len(w) <= 64)
        out = []
        for text, words in zip(texts, cuts, strict=True):
            joined = b"".join([known[w] if w in known else fresh[w] for w in words])
            whole = np.zeros(len(text), np.int8)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            whole[~_SPACE[np.minimum(points, len(_SPACE) - 1)]] = np.frombuffer(joined, np.int8)
            out.append(whole)
        return out


_SPACE = np.array([chr(i) in SPACE for i in range(0x3002)])
_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def tokens_before(deltas: bytes, at: int) -> int:
    """Tokens of the first ``at`` characters."""
    return int(np.frombuffer(deltas, np.int8)[:at].sum(dtype=np.int64))


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and deltas: the count's change at each character, a signed byte each."""
    ddl = "doc_id long, n_bytes long, deltas binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, schema = counter(path), arrow_of(ddl)
        for b in slices(batches, "text", SLICE_BYTES):
            texts = b.column("text").to_pylist()
            found = prefix.deltas(texts)
            yield pa.record_batch([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([d.tobytes() for d in found], pa.binary())], schema=schema)

    return id_and_text(docs).mapInArrow(run, ddl)


def budget_answers(counts: DataFrame, limit: int) -> DataFrame:
    """From stored prefix counts: n_tokens, over_limit, and cut_at, the characters of the longest prefix within the limit."""
    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_of(ddl)
        for b in slices(batches, "deltas", SLICE_BYTES):
            deltas = b.column("deltas").to_pylist()
            totals = [tokens_before(d, len(d)) for d in deltas]
            cuts = [longest_prefix(d, limit) if n > limit else len(d) for d, n in zip(deltas, totals, strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(cuts, pa.int64())], schema=schema)

    return counts.mapInArrow(run, ddl)


def op2_prefix_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    return budget_answers(stored(prefix_counts(read(spark, sf_dir, "documents"), default_path()), "prefixes"), limit)
