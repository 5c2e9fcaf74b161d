"""Longest-previous-factor arrays and anchors of texts, in numpy."""

from __future__ import annotations

import numpy as np

from holdfast.llm.textops import U, mix

LENGTH = 200
#: Bytes of an anchor's hash; any LENGTH bytes hold WINDOW starts of such.
GRAM = 40
WINDOW = LENGTH - GRAM + 1
_STEPS = (8, 16, 32, 64, 128)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    lanes = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    h = lanes[:n] * U(0x9E3779B97F4A7C15)
    for i in range(8, GRAM, 8):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93) + lanes[i : i + n]
    return mix(h)


def _sliding(x: np.ndarray, w: int, low: bool) -> np.ndarray:
    """Minimum (or maximum) of each w values in a row."""
    f, fill = (np.minimum, U(2**64 - 1)) if low else (np.maximum, U(0))
    n = len(x) - w + 1
    wide = np.full(-(-len(x) // w) * w, fill, U)
    wide[: len(x)] = x
    blocks = wide.reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[w - 1 : w - 1 + n])


def window_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a text's bytes: the gram hashes, and the smallest one within each LENGTH bytes. Equal LENGTH bytes have equal marks."""
    h = gram_hashes(data)
    return (h, _sliding(h, WINDOW, True)) if len(h) >= WINDOW else (h, np.zeros(0, U))


def anchors(data: np.ndarray) -> np.ndarray:
    """Hashes of the grams that are the smallest within some LENGTH bytes, one for each place."""
    h, marks = window_marks(data)
    if not len(marks):
        return np.zeros(0, U)
    edge = np.zeros(WINDOW - 1, U)
    return h[_sliding(np.concatenate((edge, marks, edge)), WINDOW, False) == h]


def runs(data: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, and mark, of the runs of LENGTH-byte windows with one mark, of marks in `shared` (sorted); and
    whether the run holds its mark twice, without which its own windows all differ."""
    h, marks = window_marks(data)
    if not len(marks) or not len(shared):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, bool)
    first = np.concatenate(([0], np.flatnonzero(marks[1:] != marks[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [len(marks) - 1]))
    mark = marks[first]
    at = np.minimum(np.searchsorted(shared, mark), len(shared) - 1)
    keep = shared[at] == mark
    first, last, mark = first[keep], last[keep], mark[keep]
    twice = [np.count_nonzero(h[a : b + WINDOW] == m) > 1 for a, b, m in zip(first.tolist(), last.tolist(), mark)]
    return first, last, mark, np.array(twice, bool)


def _smaller(position: np.ndarray) -> np.ndarray:
    """Place of the previous smaller value of each, -1 without one. All between a value and the place are larger."""
    at = np.arange(-1, len(position) - 1)
    todo = np.flatnonzero((at >= 0) & (position[at] > position))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (position[at[todo]] > position[todo])]
    return at


def other_factors(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factors: for each of `starts` (increasing positions, LENGTH bytes before the end of data at
    least) the length of the longest factor that also begins at an earlier, and at a later one of its group, counted in eights and
    up to LENGTH.

    Starts are sorted as suffixes by doubling ranks. In suffix order, the nearest earlier (smaller) positions on either side have
    the longest common prefixes of all earlier ones, and likewise the nearest larger ones of all later ones.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate((data, np.zeros(2 * LENGTH, np.uint8)))
    lanes = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))[: len(data)]
    rank = {8: np.unique(lanes, return_inverse=True)[1].astype(np.int64)}
    ahead = lambda x, k: np.concatenate((x[k:], np.zeros(min(k, len(x)), x.dtype)))
    for step in _STEPS[:-1]:
        rank[2 * step] = np.unique(rank[step] << 32 | ahead(rank[step], step), return_inverse=True)[1].astype(np.int64)
    full = np.unique(rank[128][starts] << 32 | rank[128][starts + LENGTH - 128], return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((starts, full, group))
    block = np.concatenate(([0], np.cumsum((full[order][1:] != full[order][:-1]) | (group[order][1:] != group[order][:-1]))))
    pos, own = starts[order], group[order]

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for step in reversed(_STEPS):
            a, b = np.minimum(i + out, len(data) - 1), np.minimum(j + out, len(data) - 1)
            out += np.where((rank[step][a] == rank[step][b]) & (i + out < len(data)) & (j + out < len(data)), step, 0)
        return np.minimum(out, LENGTH - 1)

    def longest(key: np.ndarray) -> np.ndarray:
        """Of each start in suffix order, the longest prefix in common with one of its group that has a smaller key."""
        best = np.zeros(n, np.int64)
        for turn in (1, -1):
            p = _smaller(key[::turn])
            if turn < 0:
                p = np.where(p >= 0, n - 1 - p, -1)[::-1]
            ok = np.flatnonzero((p >= 0) & (own[p] == own))
            alike = block[p[ok]] == block[ok]
            size = np.full(len(ok), LENGTH)
            size[~alike] = common(pos[p[ok[~alike]]], pos[ok[~alike]])
            best[ok] = np.maximum(best[ok], size)
        out = np.empty(n, np.int64)
        out[order] = best
        return out

    return longest(pos), longest(-pos)
