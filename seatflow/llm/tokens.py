"""Whole texts to token ids with the ``tokenizers`` library.

Encoding a text word by word gives the same ids as encoding it whole, as long
as it is cut only where the tokenizer's own word pattern must end a word.
Texts repeat words, so each distinct word is encoded once per worker and
remembered (up to a fixed number of words, then the memory starts afresh): the
library is the costly part by far.  Words of an optional space and Latin
letters go to the library's BPE model directly, all others through its whole
chain.

Cuts are made before a white-space byte that follows a non-space character,
between a letter and ASCII punctuation, after a single line break or tab, and
on both sides of the tokenizer's added tokens, which a text may hold and which
stay whole, as the library has it by default.  Next to bytes that may belong to a
Unicode space, or to a character that is not plainly a letter, no cut is made.
A byte-level tokenizer whose words are letter runs, digit runs, punctuation
runs and space runs allows these cuts; the tests compare with whole-text
encoding.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa

from seatflow.llm.textvec import SPACE, Spans, gather, process_memory

SLOTS = 1 << 22  # of the word memory; half of them are used at most
ENCODE_BATCH = 20_000
# a word that the byte-level pattern keeps whole
_PLAIN = re.compile(rb"[ ]?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

# byte classes: white space, ASCII letter, ASCII punctuation, part of a longer character
_WS, _LETTER, _MARK, _HIGH = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[SPACE] = _WS
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
_CLASS[128:] = _HIGH
# first bytes of the characters that may be white space beyond ASCII
_MAY_SPACE = np.zeros(256, bool)
_MAY_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _whole(buf: np.ndarray, off: np.ndarray, added: re.Pattern | None) -> list[tuple[int, int]]:
    """Spans of added tokens that lie inside one text."""
    spans: list[tuple[int, int]] = []
    raw, at = (buf.tobytes(), 0) if added is not None else (b"", -1)
    while at >= 0 and (m := added.search(raw, at)):
        border = int(off[np.searchsorted(off, m.start(), "right")])
        if m.end() <= border:
            spans.append(m.span())
        at = m.end() if m.end() <= border else border
    return spans


def _cuts(buf: np.ndarray, off: np.ndarray, added: re.Pattern | None = None) -> np.ndarray:
    """Positions where a piece starts, texts' own starts included."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        kind = _CLASS[buf]
        prev, cur = kind[:-1], kind[1:]
        at = 1 + np.flatnonzero((cur & ~prev & _WS) | (cur & _MARK & (prev << 1 | prev >> 1)))
        after = buf[at - 1]
        high = np.flatnonzero(after >= 0x80)
        if len(high):  # what ends there must be a Latin letter, or, before white space, no Unicode space
            h, last = at[high], after[high]
            two, three = buf[h - 2], buf[np.maximum(h - 3, 0)]
            letter = (two == 0xC3) & (last != 0x97) & (last != 0xB7)
            plain = (two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3))
            ok = letter | (plain & SPACE[buf[h]])
            at = np.delete(at, high[~ok])
        cut[at] = True
        # a lone break is a word of its own: cut after it as well
        lone = at[SPACE[buf[at]] & (buf[at] != 32) & (at < n - 1)] + 1
        cut[lone[~SPACE[buf[lone]] & ~_MAY_SPACE[buf[lone]]]] = True
    for a, b in _whole(buf, off, added):
        cut[a:b] = False
        cut[[a, b]] = True
    cut[off] = True
    return np.flatnonzero(cut[:n])


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabularies write for it: printable
    Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Encoder:
    """Ids of texts, one distinct word at a time.  Words are remembered by
    their 64-bit hash in an open-addressing table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        tokens = self.tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError("added tokens that take their surroundings in are not supported")
        names = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model, self.letters = self.tok.model, _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.slot_key = np.zeros(SLOTS, np.uint64)
        self.slot_word = np.zeros(SLOTS, np.int32)
        self.n = self.used = 0
        self.at = np.zeros(1 << 16, np.int64)
        self.len = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Word number of each key, -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            found = self.slot_key[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_word[slot[hit]]
            on = ~hit & (found != 0)
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _insert(self, keys: np.ndarray) -> None:
        word = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.slot_key[slot] == 0)
            self.slot_key[slot[free]] = keys[free]
            mine = free[self.slot_key[slot[free]] == keys[free]]
            self.slot_word[slot[mine]] = word[mine]
            on = np.ones(len(keys), bool)
            on[mine] = False
            keys, word, slot = keys[on], word[on], (slot[on] + 1) & (SLOTS - 1)

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest, letters, tokenize = [], self.letters, self.model.tokenize
        space, plain = letters[32], _PLAIN.fullmatch
        for i, w in enumerate(words):
            if plain(w):
                if w.isascii():
                    w = space + w[1:].decode() if w[0] == 32 else w.decode()
                else:
                    w = w.decode("latin-1").translate(letters)
                out[i] = [t.id for t in tokenize(w)]
            else:
                rest.append(i)
        for i in range(0, len(rest), ENCODE_BATCH):
            part = rest[i:i + ENCODE_BATCH]
            for j, e in zip(part, self.tok.encode_batch_fast([words[j].decode() for j in part],
                                                             add_special_tokens=False)):
                out[j] = e.ids
        return out

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids = self._ids(words)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(length.sum())
        self.at, self.len = _room(self.at, self.n + len(ids)), _room(self.len, self.n + len(ids))
        self.pool = _room(self.pool, self.used + total)
        self.pool[self.used:self.used + total] = np.fromiter((x for w in ids for x in w), np.uint32, total)
        self.at[self.n:self.n + len(ids)] = self.used + np.cumsum(length) - length
        self.len[self.n:self.n + len(ids)] = length
        self._insert(keys)
        self.n, self.used = self.n + len(ids), self.used + total

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of consecutive texts and the offsets of each text in them."""
        start = _cuts(buf, off, self.added)
        if len(start) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        end = np.concatenate((start[1:], [len(buf)]))
        keys = Spans(buf).hash(start, end) | np.uint64(1)  # 0 marks a free slot
        word = self._find(keys)
        new = np.flatnonzero(word < 0)
        if self.n + len(new) > SLOTS // 2:
            self.forget()
            new = np.arange(len(keys))
        if len(new):
            some, first = np.unique(keys[new], return_index=True)
            raw, first = buf.tobytes(), new[first]
            self._learn(some, [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
            word[new] = self._find(keys[new])
        at, length = self.at[word], self.len[word]
        sums = np.concatenate(([0], np.cumsum(length)))
        return gather(self.pool, at, length), sums[np.searchsorted(start, off, "left")]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n - len(a), len(a)), a.dtype)))


def encoder(path: str) -> Encoder:
    """One per worker process and file; its memory serves the next tasks too."""
    held = process_memory().setdefault("encoders", {})
    if path not in held:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held.clear()
        held[path] = Encoder(path)
    return held[path]


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    from seatflow.llm.textvec import text_buffer

    ids, off = encoder(path)(*text_buffer(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
