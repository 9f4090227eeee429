"""Token ids by the ``tokenizers`` library, with each distinct word encoded once per worker.

Both vocabularies cut texts at white space before they merge bytes, so a text's ids are its words' ids in a row.
A bounded cache keeps the ids of words already met; a text whose white space would not cut that way, or that holds
an added token's literal, is encoded whole.  The result is the library's own for every text
(tests/llm/test_operators.py compares them).
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Parts of words kept in a worker (about 150 bytes each); when there are more, all are dropped.
CACHE_PIECES = 500_000
#: White space beyond blank and 09 to 0D, on which libraries differ: texts that hold it take the careful way.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_ASCII = "\x1c\x1d\x1e\x1f"
_BEFORE_BLANK = tuple(c + " " for c in " \t\n\x0b\x0c\r" + _ODD_ASCII)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_NONE = np.zeros(0, np.uint16)
BLANK = "\u0120"  # how byte-level vocabularies spell a blank
#: Marks that may end a word; a run of them is one piece of its own in either vocabulary.
_MARKS = ".,;:!?*$#%&|)(-"
#: A blank inside a run of white space, or one that ends such a run at the end of the text.
_INNER_BLANK = re.compile(r"\s (?:\s|\Z)")
#: Ids are below this, so statistics by id have a bounded size whatever the input.
TERMS = 1 << 16
#: Bytes whose words are hashed at once, to bound a worker's memory.
BLOCK_BYTES = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses


def _made_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, b, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


@lru_cache(maxsize=2)
def _block_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(base, BLOCK_BYTES + 1)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch of the bytes: with both, a chance collision is out of the question.

    Stretches come in order and do not overlap, so long data is hashed block by block.
    """
    out = np.empty((2, len(starts)), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, side="right")))
        part = data[low : int(ends[to - 1])].astype(np.uint64) + np.uint64(1)
        first, last = starts[at:to] - low, ends[at:to] - low
        for n, base in enumerate(_BASES):
            power, inverse = _block_powers(base) if len(part) <= BLOCK_BYTES else _made_powers(base, len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=sums[1:])
            h = ((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)) * np.uint64(base)
            out[n, at:to] = h ^ (h >> np.uint64(32))
        at = to
    return out[0], out[1]


def words_in(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row, and each word's start, end and text; words end at ``[\\x20\\x09-\\x0D]``."""
    data = b" ".join(texts)
    bounds = np.concatenate([[0], np.cumsum([len(text) + 1 for text in texts])])
    cuts = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8)])
    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    return data, starts, ends, np.searchsorted(bounds, starts, side="right") - 1


class _Words:
    """Ids of words by their hashes: an open-addressing table of numbers, and the ids of all words as one flat array.

    The table has a fixed size (84 MB) and starts anew when it is half full.
    """

    SLOTS = 1 << 22

    def __init__(self, encode) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self.a, self.b = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.number = np.full(self.SLOTS, -1, np.int32)
        self.lengths = np.zeros(1024, np.int32)
        self.starts = np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, np.uint16), 0

    def __len__(self) -> int:
        return self.count

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The words' numbers; -1 for new ones."""
        slot = (a & np.uint64(self.SLOTS - 1)).astype(np.int64)
        found = self.number[slot]
        left = np.flatnonzero((found >= 0) & ((self.a[slot] != a) | (self.b[slot] != b)))
        while len(left):
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)
            at = slot[left]
            found[left] = self.number[at]
            left = left[(found[left] >= 0) & ((self.a[at] != a[left]) | (self.b[at] != b[left]))]
        return found

    def _insert(self, a: np.ndarray, b: np.ndarray) -> None:
        """Numbers for new words, each of which stands once."""
        slot = (a & np.uint64(self.SLOTS - 1)).astype(np.int64)
        left = np.arange(len(a))
        while len(left):
            at = slot[left]
            free = self.number[at] < 0
            self.number[at[free]] = self.count + left[free]  # of several words for one slot the last stays
            placed = free & (self.number[at] == self.count + left)
            self.a[at[placed]], self.b[at[placed]] = a[left[placed]], b[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)
        self.count += len(a)

    def numbers(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of the words that stand at ``starts`` to ``ends``; new ones are encoded."""
        a, b = segment_hashes(np.frombuffer(data, np.uint8), starts, ends)
        found = self._find(a, b)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((b[new], a[new]))]
            first = order[np.flatnonzero((np.diff(a[order], prepend=~a[order[:1]]) != 0) | (np.diff(b[order], prepend=~b[order[:1]]) != 0))]
            if self.count + len(first) > self.SLOTS // 2:  # half full: all start anew
                self.clear()
                return self.numbers(data, starts, ends)
            words = [data[i:j].decode() for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            self._add(self.count, self.encode(words))
            self._insert(a[first], b[first])
            found[new] = self._find(a[new], b[new])
        return found.astype(np.int64)

    def _add(self, first: int, ids: list) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, end = int(sizes.sum()), first + len(ids)
        while end > len(self.lengths):
            self.lengths, self.starts = np.resize(self.lengths, 2 * len(self.lengths)), np.resize(self.starts, 2 * len(self.starts))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.lengths[first:end] = sizes
        self.starts[first:end] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint16, total)
        self.used += total

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.lengths[numbers]
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        at += np.arange(total, dtype=np.int32)
        return self.flat[at], sizes


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes themselves, the rest from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordTokenizer:
    """``encode(texts)`` gives each text's ids; ``blanks`` says whether a word carries the blank before it."""

    def __init__(self, path: str, blanks: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Literals that the library finds before it cuts a text at white space; both vocabularies take them as written.
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.blanks = blanks
        self.letters = _byte_letters()
        self.words, self.pieces = _Words(self._new_words), {}

    @staticmethod
    def _inner_blank(text: str) -> bool:
        if text.isascii() and not any(pair in text for pair in _BEFORE_BLANK):
            return False
        return _INNER_BLANK.search(text) is not None

    @staticmethod
    def _odd_space(text: str) -> bool:
        if text.isascii():
            return any(c in text for c in _ODD_ASCII)
        return _ODD_SPACE.search(text) is not None

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, piece: str) -> tuple[int, ...]:
        """Ids of one run of letters or of marks, by the vocabulary's merges alone."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        if self.blanks:
            piece = piece.replace(" ", BLANK)
        return tuple([token.id for token in self.tokenizer.model.tokenize(piece)])

    def _new_words(self, words: list[str]) -> list[tuple[int, ...] | list[int]]:
        """A word of Latin-1 letters and closing marks is two pieces; the library encodes any other."""
        out: list = []
        other: list[str] = []
        where: list[int] = []
        blank, pieces, merged = " " if self.blanks else "", self.pieces, self._merged
        for word in words:
            stem = word if word.isalpha() else word.rstrip(_MARKS)
            if not (stem.isalpha() and (self.blanks or stem.isascii() or max(stem) < "\u0100")):
                where.append(len(out))
                other.append(blank + word)
                out.append(())
                continue
            piece = blank + stem if self.blanks else stem.lower()
            ids = pieces.get(piece)
            if ids is None:
                ids = pieces[piece] = merged(piece)
            if len(stem) < len(word):
                tail = word[len(stem) :]
                more = pieces.get(tail)
                if more is None:
                    more = pieces[tail] = merged(tail)
                ids = ids + more
            out.append(ids)
        if other:
            for n, ids in zip(where, self._batch(other), strict=True):
                out[n] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The texts' ids.  The many small objects made here form no cycles, so the collector rests meanwhile."""
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if resting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        whole = [n for n, text in enumerate(texts) if self._is_whole(text)]
        apart = set(whole)
        out: list[np.ndarray] = [_NONE] * len(texts)
        regular = [n for n in range(len(texts)) if n not in apart]
        held, block = 0, []
        for n in regular:
            data = texts[n].encode()
            if block and held + len(data) > BLOCK_BYTES:
                self._encode_block(block, out)
                held, block = 0, []
            block.append((n, data))
            held += len(data) + 1
        if block:
            self._encode_block(block, out)
        if self.blanks:
            heads = self._batch([texts[n].partition(" ")[0] for n in regular])
            for n, ids in zip(regular, heads, strict=True):
                if ids:
                    out[n] = np.concatenate([np.array(ids, np.uint16), out[n]])
        for n in whole:
            out[n] = np.array(self._batch([texts[n]])[0], np.uint16)
        return out

    def _is_whole(self, text: str) -> bool:
        """Whether a text must be encoded as a whole."""
        if any(token in text for token in self.added):
            return True
        return self._inner_blank(text) if self.blanks else self._odd_space(text)

    def _encode_block(self, block: list[tuple[int, bytes]], out: list[np.ndarray]) -> None:
        """The ids of some texts' words, without their heads if words carry blanks."""
        data = b" ".join(text for _, text in block)
        sizes = np.array([len(text) + 1 for _, text in block])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        letters = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(letters == 32) if self.blanks else np.flatnonzero(_SPACE[letters])
        starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
        owner = np.searchsorted(bounds, starts, side="right") - 1
        keep = starts > bounds[owner] if self.blanks else ends > starts  # a text's first stretch is its head
        starts, ends, owner = starts[keep], ends[keep], owner[keep]
        flat, lengths = self.words.ids(self.words.numbers(data, starts, ends))
        places = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(owner, np.arange(len(block) + 1))]
        for (n, _), a, b in zip(block, places[:-1].tolist(), places[1:].tolist(), strict=True):
            out[n] = flat[a:b]


def term_counts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of the distinct terms of each document, in order of document and term."""
    lengths = np.array([len(one) for one in ids], np.int64)
    kind = np.uint32 if len(ids) < TERMS else np.uint64  # 32-bit numbers are sorted faster
    keys = np.repeat(np.arange(len(ids), dtype=kind) << kind(16), lengths)
    keys |= np.concatenate(ids) if ids else keys
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    tf = np.diff(first, append=len(keys))
    keys = keys[first]
    return (keys >> kind(16)).astype(np.int64), (keys & kind(TERMS - 1)).astype(np.int64), tf


@lru_cache(maxsize=4)
def tokenizer(path: str, blanks: bool) -> WordTokenizer:
    """One tokenizer and cache per worker process."""
    return WordTokenizer(path, blanks)


def public_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
