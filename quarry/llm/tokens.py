"""Whole-document token ids, with the ids of words remembered.

The vocabulary drops white space, and its tokens never join what its pre-tokenizer parts: runs of letters
and runs of other signs. A text's ids are therefore those of its pieces one after another. Pieces are
hashed in numpy for many texts at once; only distinct ones that a worker has not met go to the
tokenizer, many in one text. What the rule below does not surely part (digits, apostrophes, special
tokens, scripts other than Latin) is given to the tokenizer as it stands between ASCII white space.
"""

from __future__ import annotations

import os

import numpy as np

from .textvec import LOWER, SPACE, U64, Chunk, chunks, valid

VOCABULARY = "word_bpe_49k.json"

_SPACE, _LETTER, _SIGN, _OTHER = range(4)
#: The class of each byte. Bytes from 0xC3 to 0xC9 begin the letters of U+00C0 to U+024F.
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[SPACE] = _SPACE
for _c in range(33, 127):
    CLASS[_c] = _LETTER if chr(_c).isalpha() else _OTHER if chr(_c) in "'<0123456789" else _SIGN
CLASS[0x80:0xC0] = _LETTER
CLASS[0xC3:0xCA] = _LETTER


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of `sizes[i]` each, one after another."""
    to = np.cumsum(sizes)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - sizes), sizes)


class Table:
    """Sorted piece hashes and where each one's ids lie."""

    def __init__(self) -> None:
        self.hash = np.zeros(0, U64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def find(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted queries: whether each is there, and its start and size."""
        if not len(self.hash):
            return np.zeros(len(query), bool), np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        at = np.minimum(np.searchsorted(self.hash, query), len(self.hash) - 1)
        return self.hash[at] == query, self.start[at], self.size[at]

    def add(self, hash_: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(np.concatenate([self.hash, hash_]), kind="stable")
        self.hash, self.start, self.size = (np.concatenate(x)[order] for x in ((self.hash, hash_), (self.start, start), (self.size, size)))


class Encoder:
    """Ids of texts. At most `most` pieces are remembered, some 50 bytes each; then the memory starts anew."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.main, self.recent = Table(), Table()
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Put ids into the store; where they begin."""
        at = self.used
        while at + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _apart(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has, encoded by itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.array([i for x in found for i in x], np.uint32), sizes

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces with one end-of-word token each, as texts of many, parted behind those tokens."""
        texts = []
        for at in range(0, len(starts), group):
            s, n = starts[at : at + group], (ends - starts)[at : at + group]
            out = np.full(int(n.sum()) + len(n), 32, np.uint8)
            out[_gather(np.cumsum(n + 1) - n - 1, n)] = data[_gather(s, n)]
            texts.append(out.tobytes().decode())
        ids, sizes = [], []
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = np.array(e.ids, np.uint32)
            to = np.flatnonzero(self.ends[own]) + 1
            n = min(group, len(starts) - k * group)
            if len(to) != n:
                at = slice(k * group, k * group + n)
                own, own_sizes = self._apart([data[s:t].tobytes() for s, t in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            else:
                own_sizes = np.diff(to, prepend=0)
            ids.append(own)
            sizes.append(own_sizes)
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, c: Chunk, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunk's rows, each with the end id behind it, and `at`: row i has at[i]:at[i + 1]."""
        raw = c.data
        kind = CLASS[raw]
        bad = kind == _OTHER
        before = raw[:-1]
        bad[1:] |= (before == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (before == 0xC4) & (raw[1:] == 0xB0) | (before == 0xC9) & (raw[1:] > 0x8F)
        data = LOWER[raw]
        starts, ends = c.pieces(kind == _SPACE)
        total = np.concatenate([[0], np.cumsum(bad)])
        whole = total[ends] > total[starts]
        part = kind[1:] != kind[:-1]
        part &= (kind[1:] != _SPACE) & (kind[:-1] != _SPACE)
        if whole.any():
            depth = np.zeros(len(raw) + 1, np.int8)
            depth[starts[whole]] += 1
            depth[ends[whole]] -= 1
            inside = np.cumsum(depth[:-1], dtype=np.int8) > 0
            part &= ~inside[1:]
            data = np.where(inside, raw, data)
        # also part the pieces of letters from those of signs, but not across rows
        cuts = np.flatnonzero(part) + 1
        edge = np.zeros(len(raw) + 1, bool)
        edge[starts] = True
        cuts = cuts[~edge[cuts]]
        edge[cuts] = True
        first = np.flatnonzero(edge)
        edge[:] = False
        edge[ends] = True
        edge[cuts] = True
        last = np.flatnonzero(edge)
        slow = total[last] > total[first]

        h = Chunk(0, data, c.offsets).hashes(first, last)
        unique, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.main.hash) + len(self.recent.hash) + len(unique) > self.most:
            self._forget()
        known, start, size = self.main.find(unique)
        also, start2, size2 = self.recent.find(unique)
        start[also], size[also] = start2[also], size2[also]
        missing = np.flatnonzero(~known & ~also)
        if len(missing):
            by_itself = slow[where[missing]]
            for rows, apart in ((missing[~by_itself], False), (missing[by_itself], True)):
                for s in range(0, len(rows), 100_000):
                    own = rows[s : s + 100_000]
                    a, b = first[where[own]], last[where[own]]
                    if apart:
                        ids, n = self._apart([data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    else:
                        ids, n = self._joined(data, a, b)
                    size[own] = n
                    start[own] = self._keep(ids) + np.cumsum(n) - n
            self.recent.add(unique[missing], start[missing], size[missing])
            if len(self.recent.hash) > 100_000:
                self.main.add(self.recent.hash, self.recent.start, self.recent.size)
                self.recent = Table()

        pieces_at = np.searchsorted(first, c.offsets)
        counts = np.concatenate([[0], np.cumsum(size[back])])
        rows_at = counts[pieces_at] + np.arange(len(c.offsets))
        out = np.full(rows_at[-1], end, np.uint32)
        hole = np.ones(rows_at[-1], bool)
        hole[rows_at[1:] - 1] = False
        out[hole] = self.store[_gather(start[back], size[back])]
        return out, rows_at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(column, path: str, end: int):
    """(first row, ids, at) for parts of an Arrow text column in order: row first + i has ids[at[i]:at[i + 1]], the end id last."""
    enc = encoder(path)
    for c in map(valid, chunks(column)):
        yield c.first, *enc.encode(c, end)
