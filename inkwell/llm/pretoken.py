"""Vectorised splitting by the byte-level BPE pattern, and encoding that calls a tokenizer once for a distinct piece."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np

from inkwell.llm import vectext

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Code points that \s matches (the Unicode property White_Space).
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Places of an encoder's table (a power of two), and ids that it holds before it starts anew.
TABLE_BITS, POOL = 21, 12_000_000


@functools.cache
def _kinds() -> np.ndarray:
    first = {"L": LETTER, "N": NUMBER}
    kinds = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kinds[WHITE_SPACE] = SPACE
    return kinds


def pieces(chunk: vectext.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pieces start (a last entry closes them), and the bounds of each text's pieces.

    The pattern is that of public_tokenizers.PATTERN: contractions; an optional U+0020 with a run of letters, numbers or
    others; runs of white space, which leave their last character when something else follows.
    """
    data, n_bytes = chunk.data, len(chunk.data)
    if n_bytes == 0:
        return np.zeros(1, np.int64), np.zeros(len(chunk) + 1, np.int64)
    point = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(point)
    text_start = np.zeros(n + 1, bool)
    text_start[np.searchsorted(at, chunk.bounds)] = True
    kind = _kinds()[point]
    space = kind == SPACE
    start = np.ones(n, bool)
    start[1:] = np.where(space[:-1], point[:-1] != 32, kind[1:] != kind[:-1])
    before, after = np.ones(n, bool), np.zeros(n, bool)
    before[1:] = ~space[:-1]
    after[:-1] = ~space[1:] & ~text_start[1:n]
    start = np.where(space, before | after, start) | text_start[:n]
    marks = np.flatnonzero((point == 39) & start)
    if len(marks):
        padded = np.concatenate([point, np.zeros(3, np.uint32)])
        open_ = np.concatenate([~text_start[1:n], np.zeros(4, bool)])  # whether the next point is of the same text
        one, two = padded[marks + 1], padded[marks + 2]
        single = np.isin(one, [ord(c) for c in "stmd"]) & open_[marks]
        pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & open_[marks] & open_[marks + 1]
        for hit, length in ((marks[single], 2), (marks[pair], 3)):
            start[hit + 1] = False
            end = hit + length
            start[end[end < n]] = True
    where = np.flatnonzero(start)
    return np.append(at[where], n_bytes), np.searchsorted(at[where], chunk.bounds)


class PieceEncoder:
    """Encodes texts through ``encode`` (pieces to id lists), remembering pieces in a table of fixed size.

    ``mapping`` gives each byte the code point under which ``encode`` wants it. A piece that finds its place in the
    table taken replaces the former one, and the table is emptied when ``POOL`` ids are held, so memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], mapping: np.ndarray) -> None:
        self.encode, self.mapping = encode, mapping.astype(np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot = np.zeros(1 << TABLE_BITS, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.offset, self.length = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        self.used, self.learnt = 0, 0

    def _learn(self, found: list[list[int]]) -> np.ndarray:
        """Put id lists into the pool; their slots."""
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))
        at, end = self.learnt, self.learnt + len(found)
        while end > len(self.offset):
            self.offset, self.length = np.concatenate([self.offset] * 2), np.concatenate([self.length] * 2)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool] * 2)
        self.length[at:end] = lengths
        self.offset[at:end] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used, self.learnt = self.used + len(flat), end
        return np.arange(at, end, dtype=np.int32)

    def chunk_ids(self, chunk: vectext.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of the texts of a chunk, and the bounds of each text's ids."""
        cut, bounds = pieces(chunk)
        if len(cut) == 1:
            return np.zeros(0, np.uint32), bounds
        if self.used > POOL:
            self._forget()
        key = vectext.span_hash(chunk.data, cut[:-1], cut[1:])
        place = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        slots = self.slot[place]
        missed = np.flatnonzero(self.key[place] != key)
        if len(missed):
            new, first, which = np.unique(key[missed], return_index=True, return_inverse=True)
            spelled, spans = self.mapping[chunk.data].tobytes().decode("utf-32-le"), missed[first]
            own = self._learn(self.encode([spelled[a:b] for a, b in zip(cut[spans].tolist(), cut[spans + 1].tolist(), strict=True)]))
            slots[missed] = own[which]
            place = (new >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            self.key[place], self.slot[place] = new, own  # of two with one place, both take the later
        length = self.length[slots]
        ends = np.cumsum(length, dtype=np.int64)
        shift = self.offset[slots] - (ends - length).astype(np.int32)
        take = np.arange(int(ends[-1]), dtype=np.int32)
        take += np.repeat(shift, length)
        return self.pool[take], np.concatenate([[0], ends])[bounds]


class AddedTokenEncoder(PieceEncoder):
    """A PieceEncoder that first cuts texts at the tokenizer's added tokens (bytes to id), as Tokenizer.encode does."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], mapping: np.ndarray, added: dict[bytes, int]) -> None:
        super().__init__(encode, mapping)
        self.added = added
        self.pattern = re.compile(b"|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)))  # the longest at a place

    def chunk_ids(self, chunk: vectext.Chunk) -> tuple[np.ndarray, np.ndarray]:
        raw = chunk.data.tobytes()
        if not any(x in raw for x in self.added):
            return super().chunk_ids(chunk)
        texts = zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True)
        hits = [m for a, b in texts for m in self.pattern.finditer(raw, a, b)]
        spans = np.array([m.span() for m in hits], np.int64).reshape(-1, 2)
        cut = np.unique(np.concatenate([chunk.bounds, spans.ravel()]))
        ids, bounds = super().chunk_ids(vectext.Chunk(chunk.first, chunk.data, cut))
        own = np.searchsorted(cut, spans[:, 0])
        keep = np.ones(len(ids), bool)
        for k in own.tolist():
            keep[bounds[k] + 1 : bounds[k + 1]] = False
        ids[bounds[own]] = [self.added[m.group()] for m in hits]
        ends = np.concatenate([[0], np.cumsum(keep)])[bounds]
        return ids[keep], ends[np.searchsorted(cut, chunk.bounds)]


def byte_letters() -> np.ndarray:
    """The code points by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, np.uint32)
    out[shown] = shown
    hidden = np.setdiff1d(np.arange(256), shown)
    out[hidden] = 256 + np.arange(len(hidden))
    return out


@functools.cache  # one for a worker process
def library_encoder(file: str) -> PieceEncoder:
    """The model of the tokenizers library for a byte-level vocabulary file; special tokens' strings are ordinary text."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(file).model
    return PieceEncoder(lambda texts: [[t.id for t in model.tokenize(x)] for x in texts], byte_letters())


@functools.cache
def full_encoder(file: str) -> PieceEncoder:
    """The ids of Tokenizer.encode without a post-processor: as library_encoder, and added tokens' strings give their ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    added = tokenizer.get_added_tokens_decoder()
    if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
        raise ValueError(f"{file}: added tokens that depend on their surroundings are not supported")
    plain = library_encoder(file)
    spelled = {t.content.encode(): i for i, t in added.items()}
    return AddedTokenEncoder(plain.encode, plain.mapping, spelled) if spelled else plain
