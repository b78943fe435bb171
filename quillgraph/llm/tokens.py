"""Token ids of whole texts, with a public tokenizer file of the `tokenizers` library.

The byte-level BPE starts a new piece at each single space or line end between two characters
that are not white space, whatever surrounds it; a special token in a text (which the library
finds before all else) holds no white space and so lies in one piece. So a text may be cut there,
and only the distinct pieces of a batch need encoding: pieces are told apart by a 64-bit hash and
their length, and the ids of the pieces met first stay in a worker's bounded table. With a file
whose added tokens hold or strip white space, texts are not cut.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .words import _BYTE, mix, powers

END = 0
SLOTS = 1 << 22  # of the table, at most half of them used
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True
_ASCII_WS = np.zeros(256, bool)
_ASCII_WS[[0x20, 9, 10, 11, 12, 13, 28, 29, 30, 31]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # of white space beyond ASCII


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _space_at(b: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether a white space character beyond ASCII begins at i."""
    x, y, z = (b[np.minimum(i + k, len(b) - 1)] for k in range(3))
    two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    general = (x == 0xE2) & (((y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
    return two | general | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))


def piece_starts(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places in b, texts beginning at off, where a piece begins."""
    c = np.flatnonzero(_CUT[b[1:-1]]) + 1 if len(b) > 2 else np.zeros(0, np.int64)
    c = c[~_ASCII_WS[b[c - 1]] & ~_ASCII_WS[b[c + 1]]]
    odd = (b[c - 1] >= 0x80) | (b[c + 1] >= 0x80)
    o = c[odd]
    drop = np.zeros(len(c), bool)
    drop[odd] = _space_at(b, o + 1) | _space_at(b, np.maximum(o - 2, 0)) & (b[np.maximum(o - 2, 0)] == 0xC2) | _space_at(b, np.maximum(o - 3, 0)) & (b[np.maximum(o - 3, 0)] >= 0xE0)
    begins = off[:-1][off[:-1] < off[1:]]
    ends = off[1:][off[:-1] < off[1:]]
    begin = np.zeros(len(b), bool)
    begin[c[~drop]] = True
    full = off[:-1] < off[1:]
    begin[off[1:][full] - 1] = False  # a space at the end of a text stays with it
    begin[off[:-1][full]] = True
    return np.flatnonzero(begin)


def _plain(b: np.ndarray, s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a piece begins with a space or line end and holds no other white space."""
    space = _ASCII_WS[b]
    odd = np.flatnonzero(_LEADS[b])
    space[odd[_space_at(b, odd)]] = True
    return _CUT[b[s]] & (np.add.reduceat(space, s, dtype=np.int64) == 1) & (size > 1)


class Encoder:
    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized or any(c.isspace() for c in t.content) for t in added)
        self.begins = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for piece, i in self.tok.get_vocab().items():
            self.begins[i] = piece.startswith(("Ġ", "Ċ"))
        self.key, self.at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.ids, self.start, self.n = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Table numbers of hashes, -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            k = self.key[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.at[slot[hit]]
            go = ~hit & (k != 0)
            todo, slot = todo[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _keep(self, h: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Adds distinct unknown hashes and their ids to the table."""
        end = int(self.start[self.n])
        if len(self.ids) < end + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(ids)), np.uint32)])
        if len(self.start) < self.n + len(h) + 1:
            self.start = np.concatenate([self.start, np.zeros(max(len(self.start), len(h)), np.int64)])
        self.ids[end : end + len(ids)] = ids
        self.start[self.n + 1 : self.n + len(h) + 1] = end + np.cumsum(lengths)
        todo, slot = np.arange(len(h)), (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = self.key[slot] == 0
            won = np.zeros(len(todo), bool)
            won[np.unique(slot, return_index=True)[1]] = True  # one for each slot
            won &= free
            self.key[slot[won]], self.at[slot[won]] = h[todo[won]], self.n + todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & (SLOTS - 1)
        self.n += len(h)

    def _encode(self, b: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the pieces, their ids in this order, number of ids of each): the plain ones, of one
        leading space or line end and no other white space, are encoded together, as each then
        begins where an id with it does; the rest one by one."""
        done: tuple[list, list, list] = ([], [], [])
        rest = np.flatnonzero(~plain).tolist()
        together = np.flatnonzero(plain)
        for k in range(0, len(together), 4000):
            some = together[k : k + 4000]
            edge = np.concatenate([[0], np.cumsum(size[some])])
            text = b[np.arange(edge[-1]) + np.repeat(start[some] - edge[:-1], size[some])].tobytes().decode()
            ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(some) and at[0] == 0:
                for x, y in zip(done, (some, ids, np.diff(np.append(at, len(ids))))):
                    x.append(y)
            else:
                rest += some.tolist()
        for i in rest:
            ids = self.tok.encode(b[start[i] : start[i] + size[i]].tobytes().decode(), add_special_tokens=False).ids
            for x, y in zip(done, ([i], np.array(ids, np.uint32), [len(ids)])):
                x.append(y)
        return tuple(map(np.concatenate, done))

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in b that begin at off, each text's followed by END, and the
        number of ids of each text."""
        s = off[:-1][off[:-1] < off[1:]] if self.whole else piece_starts(b, off)
        if len(s):
            size = np.diff(np.append(s, len(b)))
            rel = np.arange(len(b)) - np.repeat(s, size)
            with np.errstate(over="ignore"):
                h = mix(np.add.reduceat(_BYTE[b] * powers(int(size.max()) + 1)[rel], s) + size.astype(np.uint64)) | np.uint64(1 << 63)
            at = self._find(h)
            lens = np.zeros(len(s), np.int64)
            begin = np.zeros(len(s), np.int64)
            known = at >= 0
            begin[known] = self.start[at[known]]
            lens[known] = self.start[at[known] + 1] - begin[known]
            pool = self.ids
            if not known.all():
                new, first, back = np.unique(h[~known], return_index=True, return_inverse=True)
                first = np.flatnonzero(~known)[first]
                order, ids, n = self._encode(b, s[first], size[first], _plain(b, s, size)[first])
                used = int(self.start[self.n])
                own, count = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
                own[order], count[order] = used + np.cumsum(n) - n, n
                begin[~known], lens[~known] = own[back], count[back]
                if self.n + len(new) <= SLOTS // 2:
                    self._keep(new[order], ids, n)
                    pool = self.ids
                else:
                    pool = np.concatenate([pool[:used], ids])
        else:
            lens = begin = np.zeros(0, np.int64)
            pool = self.ids
        ends = np.concatenate([[0], np.cumsum(lens)])
        edge = np.searchsorted(s, off)
        n = ends[edge[1:]] - ends[edge[:-1]] + 1
        out = np.full(int(n.sum()), END, np.uint32)
        last = np.zeros(len(out), bool)
        last[np.cumsum(n) - 1] = True
        out[~last] = pool[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], lens)]
        return out, n


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
