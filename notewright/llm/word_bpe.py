"""Token ids of many texts at once for a word-level BPE tokenizer file.

Ids equal those of the `tokenizers` library. Texts are cut at ASCII white space,
which this kind of tokenizer drops anyway; each distinct word of a task is encoded
once, all new words together in numpy, and ids of texts are gathered from those.
Words with characters whose normal form or lower case needs more than a table look-up,
and words that hold an added token such as <|endoftext|>, which the library takes for
that token, go to the library itself.
"""

from __future__ import annotations

import json
from itertools import chain, repeat

import numpy as np
import regex
from tokenizers import Tokenizer

MAX_FAST = 48
ABSENT = np.iinfo(np.int32).max


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class HashIndex:
    """Places of int64 keys: two hash tables, the second for what collides in the first."""

    BITS = 20

    def __init__(self, key: np.ndarray):
        self.key = np.append(key, -1)
        rng = np.random.default_rng(1)
        while True:
            self.mult = rng.integers(1 << 62, size=2, dtype=np.int64) * 2 + 1
            self.slots = np.full((2, 1 << self.BITS), len(key), np.int32)
            left = np.arange(len(key))
            for i in range(2):
                h = self._hash(key[left], i)
                at = np.unique(h, return_index=True)[1]
                self.slots[i, h[at]] = left[at]
                left = np.delete(left, at)
            if not len(left):
                return

    def _hash(self, key: np.ndarray, i: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(self.mult[i])) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def index(self, key: np.ndarray) -> np.ndarray:
        """The key's place, or ABSENT."""
        a = self.slots[0, self._hash(key, 0)]
        bad = np.flatnonzero(self.key[a] != key)
        b = self.slots[1, self._hash(key[bad], 1)]
        a[bad] = np.where(self.key[b] == key[bad], b, ABSENT)
        return a


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The library cuts texts at these before anything else, even within a word.
        self.added = [t["content"].encode() for t in spec.get("added_tokens", ())]
        model = spec["model"]
        if model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix"):
            raise ValueError("only BPE files whose words end in </w> are known")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern + "| ")
        vocab, letters = model["vocab"], _byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in letters], np.int32)
        a, b = (np.array([vocab[m[i]] for m in merges], np.int64) for i in range(2))
        self.merged = np.array([vocab[x + y] for x, y in merges], np.int32)
        self.pairs = HashIndex(a << 20 | b)
        self._plain = regex.compile(r"[\x21-\x7e¡-įı-ɏ ]*+")

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.index(a.astype(np.int64) << 20 | b)

    def _merge(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids flat, count of each row) of pieces of equal byte length: the lowest-ranked pair is merged, the leftmost first."""
        rows, n = raw.shape
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        size, result = np.full(rows, n), np.zeros((rows, n), np.int32)
        row = np.arange(rows)
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, n - 1) if n > 1 else np.zeros((rows, 0), np.int32)
        while rank.shape[1]:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(row)), at]
            done = low == ABSENT
            if done.any():
                result[row[done], : ids.shape[1]] = ids[done]
                go = ~done
                row, ids, rank, at, low = row[go], ids[go], rank[go], at[go], low[go]
                if not len(row):
                    break
            k = np.arange(len(row))
            ids[k, at] = self.merged[low]
            place = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            place = place[:-1]
            rank = np.take_along_axis(rank, place + (place >= at[:, None]), axis=1)
            size[row] -= 1
            for shift in (-1, 0):
                ok = np.flatnonzero((at + shift >= 0) & (at + shift < rank.shape[1]) & (at + shift + 1 < size[row]))
                where = at[ok] + shift
                rank[ok, where] = self._rank(ids[ok, where], ids[ok, where + 1])
        if len(row):
            result[row, : ids.shape[1]] = ids
        return result[np.arange(n) < size[:, None]], size

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids flat, start and count of each piece's ids)."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start, count, flat, used = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), [np.zeros(0, np.uint32)], 0
        order = np.argsort(size, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            n = int(size[own[0]]) if len(own) else 0
            if not n:
                continue
            if n > MAX_FAST:
                ids, got = self._by_library([raw[k].decode() for k in own.tolist()])
            else:
                ids, got = self._merge(np.frombuffer(b"".join([raw[k] for k in own.tolist()]), np.uint8).reshape(len(own), n))
            flat.append(ids.astype(np.uint32))
            count[own], start[own] = got, used + np.cumsum(got) - got
            used += len(ids)
        return np.concatenate(flat), start, count

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids flat, number of ids of each word); a word has no ASCII white space."""
        text = b" ".join(words).decode() + " "
        marked = any(a.decode() in text for a in self.added)
        if marked or not self._plain.fullmatch(text):
            plain = np.fromiter((w.isascii() or bool(self._plain.fullmatch(w.decode())) for w in words), bool, len(words))
            if marked:
                plain &= np.fromiter((not any(a in w for a in self.added) for w in words), bool, len(words))
            size, parts = np.zeros(len(words), np.int64), []
            for mask, encode in ((plain, self._plain_words), (~plain, lambda t: self._by_library(t[:-1].split(" ")))):
                if mask.any():
                    flat, size[mask] = encode(b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if m]).decode() + " ")
                    parts.append((mask, flat))
            out, start = np.zeros(int(size.sum()), np.uint32), np.cumsum(size) - size
            for mask, flat in parts:
                n = size[mask]
                out[np.repeat(start[mask] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
            return out, size
        return self._plain_words(text)

    def _plain_words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of words that are each followed by a space."""
        found = self.pattern.findall(text.lower())
        pieces = list(dict.fromkeys(found))
        number = {p: k for k, p in enumerate(pieces)}
        flow = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        pieces[number[" "]] = ""  # the end of a word has no ids
        flat, start, count = self._pieces(pieces)
        size = count[flow]
        ends = np.cumsum(size)
        total = ends[flow == number[" "]]
        return flat[np.repeat(start[flow] - (ends - size), size) + np.arange(int(ends[-1]))], np.diff(total, prepend=0)


class WordCache:
    """Ids of whole texts, with the words seen so far; starts anew beyond `most` words, which bounds its memory."""

    def __init__(self, bpe: WordBpe, most: int = 500_000):
        self.bpe, self.most = bpe, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 100_000):
            part = words[lo : lo + 100_000]
            (flat, size), n = self.bpe.encode_words(part), len(self.index)
            while len(self.pool) < self.used + len(flat):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            while len(self.start) < n + len(part):
                self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
            self.pool[self.used : self.used + len(flat)] = flat
            self.size[n : n + len(part)] = size
            self.start[n : n + len(part)] = self.used + np.cumsum(size) - size
            self.used += len(flat)
            self.index.update(zip(part, range(n, n + len(part)), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list({words[i] for i in missing.tolist()})
            if len(self.index) + len(new) > self.most:
                self._clear()
                new, missing = list(set(words)), np.arange(len(words))
            self._add(new)
            at[missing] = np.fromiter((self.index[words[i]] for i in missing.tolist()), np.int64, len(missing))
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.pool[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[np.cumsum([len(ws) for ws in split])] if split else []
        return np.split(flat, cuts[:-1]) if len(split) else []
