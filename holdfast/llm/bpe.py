"""Byte-pair encoding with word ends, as a `tokenizers` file describes it, for many texts at once.

A pre-token is merged in a contiguous rank array: its parts and the ranks of adjacent parts stand in two lists; the
smallest rank is looked for again and again, the boundary there is deleted and the two neighbouring ranks are refreshed.
Texts are cut at ASCII white space, which no pre-token crosses; what each distinct piece encodes to is kept in arrays.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import regex

from holdfast.llm.textops import U, Words, same_spans

_SPACE = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _SPACE + r"\p{L}\p{N}]+")
_NONE = 1 << 30
_BITS, _FREE, _SPREAD = 18, -1, 0x9E3779B1
#: Pre-tokens of so many bytes at most are merged many at once, in matrices.
WIDE = 24
#: Beyond so many parts a heap finds the smallest rank.
SHORT = 200
#: What one worker remembers: pre-tokens (some 350 bytes each), pieces between white space (32), and bytes of those. It stays in
#: memory between tasks, beside what other stages need there.
WORDS_KEPT, PIECES_KEPT, BYTES_KEPT = 150_000, 800_000, 20_000_000


def _byte_chars() -> list[str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """The vocabulary, merges and added tokens of a tokenizer file's JSON."""

    def __init__(self, source: str):
        whole = json.loads(source)
        model = whole["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.end = end
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.names = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for name, i in [*ids.items(), *self.special.items()]:
            self.names[i] = name
        chars = _byte_chars()
        self.inner = [ids[c] for c in chars]
        self.last = [ids[c + end] for c in chars]
        self.rank, self.merged = {}, []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank.setdefault(ids[a] << 16 | ids[b], r)
            self.merged.append(ids[a + b])
        self.pairs = np.full(1 << _BITS, _FREE, np.int64)
        self.pair_ranks = np.full(1 << _BITS, _NONE, np.int32)
        for key, r in self.rank.items():
            i = (key * _SPREAD & 0xFFFFFFFF) >> (32 - _BITS)
            while self.pairs[i] != _FREE:
                i = (i + 1) & ((1 << _BITS) - 1)
            self.pairs[i], self.pair_ranks[i] = key, r
        self.merged_at = np.array(self.merged, np.int32)
        self.inner_at, self.last_at = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words: dict[str, tuple[int, ...]] = {}
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, U), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.at = np.zeros(1, np.int64)
        self.bytes, self.bytes_at = np.zeros(8, np.uint8), np.zeros(1, np.int64)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of the bytes of one pre-token."""
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank, merged = self.rank, self.merged
        ranks = [rank.get(a << 16 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            parts[i] = new = merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] << 16 | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank.get(new << 16 | parts[i + 1], _NONE)
        return tuple(parts)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, from an open hash table; _NONE for pairs without."""
        key = a.astype(np.int64) << 16 | b
        i = (key * _SPREAD & 0xFFFFFFFF) >> (32 - _BITS)
        found = self.pairs[i]
        out = np.where(found == key, self.pair_ranks[i], _NONE)
        again = np.flatnonzero((found != key) & (found != _FREE))
        while len(again):
            i[again] = (i[again] + 1) & ((1 << _BITS) - 1)
            found = self.pairs[i[again]]
            hit = found == key[again]
            out[again[hit]] = self.pair_ranks[i[again[hit]]]
            again = again[~hit & (found != _FREE)]
        return out

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge() of each word: those of up to WIDE bytes stand in the rows of a matrix of parts and one of ranks."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(size > WIDE).tolist():
            out[i] = self.merge(words[i])
        for low, high in ((1, 8), (9, 16), (17, WIDE)):
            who = np.flatnonzero((size >= low) & (size <= high))
            if not len(who):
                continue
            n = size[who]
            raw = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in who.tolist()), np.uint8).reshape(len(who), high)
            parts = self.inner_at[raw]
            rows = np.arange(len(who))
            parts[rows, n - 1] = self.last_at[raw[rows, n - 1]]
            cols = np.arange(high)
            parts[cols >= n[:, None]] = 0
            ranks = self._ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(who), high - 1)
            ranks[cols[1:] >= n[:, None]] = _NONE
            ranks = np.concatenate((ranks, np.full((len(who), 1), _NONE, ranks.dtype)), 1)
            done, live = parts.copy(), rows
            while len(live):
                at = ranks.argmin(axis=1)
                here = np.arange(len(live))
                best = ranks[here, at]
                more = best < _NONE
                if not more.all():
                    done[live[~more]] = parts[~more]
                    live, parts, ranks, at, best, n = live[more], parts[more], ranks[more], at[more], best[more], n[more]
                    here = np.arange(len(live))
                    if not len(live):
                        break
                parts[here, at] = self.merged_at[best]
                after = cols[:-1] > at[:, None]  # the boundary behind `at` goes: what follows moves up
                parts[:, :-1] = np.where(after, parts[:, 1:], parts[:, :-1])
                ranks[:, :-1] = np.where(cols[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
                n = n - 1
                size[who[live]] = n
                left = np.maximum(at - 1, 0)
                ranks[here, left] = np.where(at > 0, self._ranks(parts[here, left], parts[here, at]), ranks[here, left])
                right = np.minimum(at + 1, high - 1)
                ranks[here, at] = np.where(at + 1 < n, self._ranks(parts[here, at], parts[here, right]), _NONE)
            for i, row, k in zip(who.tolist(), done.tolist(), size[who].tolist()):
                out[i] = tuple(row[:k])
        return out

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        rank, merged, n = self.rank, self.merged, len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] << 16 | parts[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = merged[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (s := rank.get(parts[k] << 16 | parts[after[k]], _NONE)) < _NONE:
                    heapq.heappush(heap, (s, k, parts[k], parts[after[k]]))
        return tuple(p for p in parts if p >= 0)

    def _pre_tokens(self, piece: str) -> list:
        """The pre-tokens of a text; special tokens' strings become ids."""
        if "<|" in piece:
            parts = self.special_split.split(piece)
            if len(parts) > 1:
                return [x for p in parts for x in ([self.special[p]] if p in self.special else self._pre_tokens(p))]
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
        return _SPLIT.findall(piece.lower() if "Σ" not in piece else "".join(c.lower() for c in piece))  # each on its own: no final sigma

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        split = [self._pre_tokens(p) for p in pieces]
        words = self.words
        new = list({w for s in split for w in s if w not in words and not isinstance(w, int)})
        if len(words) + len(new) > WORDS_KEPT:
            words.clear()
            new = list({w for s in split for w in s if not isinstance(w, int)})
        words.update(zip(new, self.merge_many([w.encode() for w in new])))
        return [[i for w in s for i in ((w,) if isinstance(w, int) else words[w])] for s in split]

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def _apart(self, words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_texts(), without hashes of pieces."""
        raw = words.buf.tobytes()
        ids = self.encode_pieces([raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts.tolist(), words.ends.tolist())])
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        return np.array([i for x in ids for i in x], np.uint16), ends[words.first]

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (and the last one's end).

        A piece is looked up by a hash and compared with the bytes found there; if two pieces of one hash meet, the texts are
        encoded without it.
        """
        whole = b"".join(texts)
        # A-Z may go before normalisation unless they're part of a special token or take a combining mark.
        words = Words(texts, lower=b"<|" not in whole and b"\xcc" not in whole and b"\xcd" not in whole)
        if not len(words.starts):
            return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        keys, index, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > PIECES_KEPT or len(self.bytes) > BYTES_KEPT:
            self.forget()
        at, known = self._look_up(keys)
        size, first = words.ends - words.starts, index[inverse]
        met = self.slots[at[known]]
        begin = self.bytes_at[met]
        if not same_spans(words.buf, words.starts, size, words.buf, words.starts[first], size[first]) or not same_spans(words.buf, words.starts[index[known]], size[index[known]], self.bytes, begin, self.bytes_at[met + 1] - begin):
            return self._apart(words, texts)
        new = np.flatnonzero(~known)
        if len(new):
            raw = words.buf.tobytes()
            spans = zip(words.starts[index[new]].tolist(), words.ends[index[new]].tolist())
            ids = self.encode_pieces([raw[a:b].decode("utf-8", "replace") for a, b in spans])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(sizes.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(total, self.used) + (1 << 16), np.uint16)))
            self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint16, total)
            self.slots = np.insert(self.slots, at[new], len(self.at) - 1 + np.arange(len(new)))
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.at = np.concatenate((self.at, self.used + np.cumsum(sizes)))
            self.used += total
            self.bytes = np.concatenate((self.bytes[:-8], np.frombuffer(b"".join(raw[a:b] for a, b in zip(words.starts[index[new]].tolist(), words.ends[index[new]].tolist())) + bytes(8), np.uint8)))
            self.bytes_at = np.concatenate((self.bytes_at, self.bytes_at[-1] + np.cumsum(words.ends[index[new]] - words.starts[index[new]])))
            at, _ = self._look_up(keys)
        slot = self.slots[at]
        begin, size = self.at[slot], self.at[slot + 1] - self.at[slot]
        sizes = size[inverse]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(begin[inverse] - ends + sizes, sizes)]
        return ids, np.concatenate(([0], ends))[words.first]

    def decode(self, ids: list[int]) -> str:
        """Names of the tokens, joined by blanks: the file has no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids])


_HELD: dict[int, Vocabulary] = {}


def vocabulary(source: str) -> Vocabulary:
    """One for each process and file."""
    key = hash(source)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Vocabulary(source)
    return _HELD[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
