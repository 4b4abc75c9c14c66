"""Fast exact encoding of whole texts: the library sees each distinct piece once.

A tokenizer whose pieces never cross a cut gives the same ids for a text as for its cuts one after
the other. ``PieceMemo`` keeps the ids of the pieces that a worker has met, has the library encode
the new ones in a batch, and puts texts together with array operations. It starts afresh when it
holds ``MOST_PIECES`` or ``MOST_CHARACTERS``, so its memory is bounded; that changes the speed only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

MOST_PIECES = 1_000_000
MOST_CHARACTERS = 32_000_000


class _Codes(dict):
    """Piece to code; a new piece gets the next code and waits for its ids."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        self.waiting.append(piece)
        return code


class PieceMemo:
    """``encode`` gives the ids of pieces one after another and the number of each piece's."""

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type) -> None:
        self.cut, self.encode, self.dtype = cut, encode, dtype
        self._clear()

    def _clear(self) -> None:
        self.codes, self.characters = _Codes(), 0
        self.table, self.used = np.empty(1 << 16, self.dtype), 0
        self.starts, self.lengths = np.empty(1 << 15, np.int32), np.empty(1 << 15, np.int32)

    def _learn(self) -> None:
        """Ids of the waiting pieces go to the table."""
        pieces, self.codes.waiting = self.codes.waiting, []
        first = len(self.codes) - len(pieces)
        self.characters += sum(map(len, pieces))
        for at in range(0, len(pieces), 20_000):
            found, sizes = self.encode(pieces[at : at + 20_000])
            total, n = len(found), first + at
            while self.used + total > len(self.table):
                self.table = np.resize(self.table, 2 * len(self.table))
            while n + len(sizes) > len(self.starts):
                self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
            self.table[self.used : self.used + total] = found
            self.lengths[n : n + len(sizes)] = sizes
            self.starts[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
            self.used += total

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        if len(self.codes) > MOST_PIECES or self.characters > MOST_CHARACTERS:
            self._clear()
        pieces: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.cut(text)
            counts[i] = len(found)
            pieces += found
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int32, len(pieces))
        if self.codes.waiting:
            self._learn()
        sizes = self.lengths[codes]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.table[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(total)]
        per = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(per)


_LIBRARY: dict[str, object] = {}


def library(path: str):
    """The tokenizers library's object for a .json file, one for each worker."""
    if path not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LIBRARY[path] = Tokenizer.from_file(path)
        _LIBRARY[path].no_truncation()
        _LIBRARY[path].no_padding()
    return _LIBRARY[path]


#: What Unicode calls white space.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")


def cut_at_spaces(text: str) -> list[str]:
    """Pieces between white space; str.split() would also cut at U+001C to U+001F."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [x for x in _SPACES.split(text) if x]
    return text.split()


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes


#: The splitting pattern whose matches ``JoinedEncoder`` can count, and the mark of a token that ends one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Kinds of printable ASCII: 0 space, 1 letter, 2 digit, 3 anything else.
_KIND = np.array([3 if 32 < i < 127 else 0 for i in range(128)], np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[48:58] = 1, 2


class JoinedEncoder:
    """Encodes pieces joined into longer strings, which costs the library about half of what single ones do.

    A space parts the pieces, so none changes another's ids. A plain piece (printable ASCII without
    an apostrophe or special string) has a match of the pattern wherever the kind of character
    changes and at each digit, and each match ends in a word-end token, so its ids can be told apart
    by counting those. Other pieces are joined by a control character that is none of their own and
    whose token so marks the border; what holds that character or a special string is encoded alone."""

    JOINED = 200
    MARK = "\x7f"

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        said = json.loads(tokenizer.to_str())
        split, model = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0], said["model"]
        mark = self._encode([self.MARK])[0]
        self.known = split.get("pattern") == {"Regex": WORD_PATTERN} and model.get("end_of_word_suffix") == WORD_END and len(mark) == 1
        self.mark = mark[0] if mark else None
        self.alone = re.compile("|".join(map(re.escape, [self.MARK, *(x["content"] for x in said["added_tokens"])])))
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], between: str) -> np.ndarray:
        """Ids of the pieces with ``between`` after each."""
        made = self._encode([between.join([*pieces[i : i + self.JOINED], ""]) for i in range(0, len(pieces), self.JOINED)])
        return np.concatenate([np.array(x, np.int64) for x in made])

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(pieces, " ")
        kind = _KIND[np.frombuffer(" ".join(["", *pieces]).encode(), np.uint8)]
        starts = (kind > 0) & ((kind != np.roll(kind, 1)) | (kind == 2))
        matches = np.add.reduceat(starts.astype(np.int64), np.flatnonzero(kind == 0))
        ends = np.flatnonzero(self.ends[ids])[np.cumsum(matches) - 1] + 1
        return ids, np.diff(ends, prepend=0)

    def _marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(pieces, f" {self.MARK} ")
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.known:
            return flattened(self._encode(pieces))
        kinds: tuple[list[int], list[int], list[int]] = [], [], []
        for i, piece in enumerate(pieces):
            if self.alone.search(piece):
                kinds[2].append(i)
            elif piece.isascii() and piece.isprintable() and "'" not in piece:
                kinds[0].append(i)
            else:
                kinds[1].append(i)
        parts = []
        for at, encode in zip(kinds, (self._plain, self._marked, lambda x: flattened(self._encode(x))), strict=True):
            if at:
                parts.append((at, *encode([pieces[i] for i in at])))
        flat, sizes = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
        starts = np.cumsum(sizes) - sizes
        # back into the order of the pieces
        back = np.argsort(np.concatenate([np.array(x[0], np.int64) for x in parts]), kind="stable")
        sizes, starts = sizes[back], starts[back]
        ends = np.cumsum(sizes)
        return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(len(flat))], sizes


def id_type(n: int) -> type:
    """The smallest type that holds ids below ``n``."""
    return np.uint16 if n <= 1 << 16 else np.uint32


_MEMOS: dict[str, PieceMemo] = {}


def word_memo(path: str) -> PieceMemo:
    """Memo for a tokenizer that drops white space and so never has a token across it."""
    if path not in _MEMOS:
        tokenizer = library(path)
        _MEMOS[path] = PieceMemo(cut_at_spaces, JoinedEncoder(tokenizer), id_type(tokenizer.get_vocab_size()))
    return _MEMOS[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(flat: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` after each text's."""
    out = np.full(len(flat) + len(sizes), end, flat.dtype)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes + 1) - 1] = False
    out[keep] = flat
    return out, sizes + 1
