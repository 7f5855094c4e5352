"""Byte-pair merges of many words at once, for public word-level vocabularies whose tokens mark a word's end.

Words are rows of a matrix of symbols. At each step every row merges the leftmost of its pairs that come first in
the vocabulary's order, which is what the vocabulary's own tokenizer does one word and one pair at a time; rows without
such a pair are done.
"""

from __future__ import annotations

import json

import numpy as np

#: Ends the last token of a word in the vocabulary.
WORD_END = "</w>"
#: Bytes of a word, and words of a matrix.
LONGEST, ROWS = 48, 20_000
NEVER = np.iinfo(np.int32).max


def byte_names() -> list[str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """A vocabulary's merges. ``usable`` is false if the file describes another kind of vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f).get("model", {})
        vocab, names = model.get("vocab"), byte_names()
        odd = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback")
        self.usable = model.get("type") == "BPE" and model.get("end_of_word_suffix") == WORD_END and not odd and all(n in vocab and n + WORD_END in vocab for n in names)
        if not self.usable:
            return
        self.inner, self.last = (np.array([vocab[n + end] for n in names], np.int64) for end in ("", WORD_END))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.word_of = {n: vocab[n + WORD_END] for n in names}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge's place in the vocabulary's order; NEVER for pairs that don't merge or lack a side (-1)."""
        key = (a << 24) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NEVER)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of words of 1 to LONGEST bytes each."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        for lo in range(0, len(words), ROWS):
            some = order[lo : lo + ROWS]
            n = sizes[some]
            raw = np.frombuffer(b"".join(words[i] for i in some.tolist()), np.uint8)
            ids = np.full((len(some), int(n.max())), -1, np.int64)
            ids[np.arange(ids.shape[1]) < n[:, None]] = self.inner[raw]
            ids[np.arange(len(some)), n - 1] = self.last[raw[np.cumsum(n) - 1]]
            rank = self.rank(ids[:, :-1], ids[:, 1:])
            while len(some):
                place = rank.argmin(1) if rank.shape[1] else np.zeros(len(some), np.int64)
                least = rank[np.arange(len(some)), place] if rank.shape[1] else np.full(len(some), NEVER)
                done = least == NEVER
                if done.any():
                    end = ids[done]
                    there = end >= 0
                    flat, cuts = end[there].astype("<u4").tobytes(), (4 * np.cumsum(there.sum(1))).tolist()
                    for i, a, b in zip(some[done].tolist(), [0, *cuts], cuts):
                        out[i] = flat[a:b]
                    some, ids, rank, place, least = some[~done], ids[~done], rank[~done], place[~done], least[~done]
                    if not len(some):
                        break
                row, column = np.arange(len(some)), np.arange(ids.shape[1] - 1)
                new = self.made[least]
                ids = np.where(column <= place[:, None], ids[:, :-1], ids[:, 1:])
                ids[row, place] = new
                rank = np.where(column[:-1] < place[:, None], rank[:, :-1], rank[:, 1:])
                if rank.shape[1]:
                    before = place > 0
                    rank[row[before], place[before] - 1] = self.rank(ids[row[before], place[before] - 1], new[before])
                    after = place < rank.shape[1]
                    rank[row[after], place[after]] = self.rank(new[after], ids[row[after], place[after] + 1])
        return out
