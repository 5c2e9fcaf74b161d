"""Words, word hashes and shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_M1, _M2, _K = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], U)
SHINGLE = 5


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U(33))
    h = h * _M1
    h = h ^ (h >> U(33))
    h = h * _M2
    return h ^ (h >> U(33))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a list of UTF-8 texts.

    buf: all texts, each followed by a newline, then 8 zero bytes. starts, ends: of each word in buf. first: the number
    of the first word of each text, and behind the last text the number of words.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        whole = b"\n".join(texts) + b"\n"
        if lower:
            whole = whole.lower()  # of bytes: A-Z alone
        n = len(whole)
        self.buf = np.frombuffer(whole + bytes(8), np.uint8)
        b = self.buf[:n]
        edges = np.flatnonzero(np.diff(np.concatenate(([1], ((b == 32) | ((b >= 9) & (b <= 13))).view(np.int8), [1]))))
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_ends = np.cumsum(sizes) - 1
        self.text_starts = self.text_ends - sizes + 1
        self.first = np.concatenate((np.searchsorted(self.starts, self.text_starts), [len(self.starts)]))

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step; buf ends with 8 spare bytes."""
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    size = ends - starts
    h = mix(size.astype(U) * _K + U(1))
    at, left, who = starts, size, None
    while len(at):
        x = lanes[at] & _MASK[np.minimum(left, 8)]
        if who is None:
            h = mix((h ^ x) * _K)
        else:
            h[who] = mix((h[who] ^ x) * _K)
        more = np.flatnonzero(left > 8)
        who = more if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def same_spans(buf: np.ndarray, starts: np.ndarray, size: np.ndarray, buf2: np.ndarray, starts2: np.ndarray, size2: np.ndarray) -> bool:
    """Whether each byte span of buf equals the one of buf2 at its place, eight bytes a step; both end with 8 spare bytes."""
    if not np.array_equal(size, size2):
        return False
    one, two = (np.ndarray((len(b) - 7,), "<u8", b, 0, (1,)) for b in (buf, buf2))
    a, b, left = starts, starts2, size
    while len(a):
        if ((one[a] ^ two[b]) & _MASK[np.minimum(left, 8)]).any():
            return False
        more = np.flatnonzero(left > 8)
        a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
    return True


def windows(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k values; one fewer than k values at the end have none."""
    if len(h) < k:
        return np.zeros(0, U)
    n = len(h) - k + 1
    acc = h[:n] * _K
    for i in range(1, k):
        acc = (acc ^ (acc >> U(29))) * _M1 + h[i : i + n]
    return mix(acc)


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of five words; of the whole sequence with fewer; none without words."""
    h = words.hashes()
    w = windows(h)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(w[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(windows(h[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out
