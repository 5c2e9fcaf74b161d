"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

Tokens are runs of word characters or of other visible ones. The field tags each as outside (0), begin (1) or inside (2)
of a secret by its shape and those of its neighbours, how its characters mix, the word before it, and features of the
whole document, and is decoded by Viterbi. Where a token's score for outside beats anything that transitions can make
up for, the best path is outside there; so it is enough to decode the stretches between such tokens, many at once.

The field is trained here, on a bounded sample of documents: the patterns' matches in them, invented secrets of random
alphabets, lengths, prefixes and parts put between their words, invented harmless strings, and stretches without any.
No known form of a secret (a vendor's prefix, a fixed length) is a feature or an example.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import passes, table
from holdfast.llm.textops import hash_spans

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: Documents that the field is fitted on, by hash of their id; tokens before (and, twice as many, behind) a training example's centre.
SAMPLE_DOCS, AROUND = 1000, 5
REDACTED = "[SECRET]"
#: Bytes of text that are tagged at once: a token has some 300 bytes of features and scores.
SCAN_BYTES = 500_000

_CLASS = np.full(256, 2, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *b"_+/-.", *range(128, 256)]] = 1
_SETS = {"digit": range(48, 58), "upper": range(65, 91), "lower": range(97, 123), "hex": [*range(48, 58), *range(97, 103)], "wide": range(128, 256), "vowel": b"aeiouyAEIOUY"}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _SETS.items()}
_CHAR = np.select([_TABLES["lower"], _TABLES["upper"], _TABLES["digit"]], [1, 2, 3], 0).astype(np.int8)
_JOINT = np.isin(np.arange(256), list(b"_-."))
#: Sizes of the tables of weights: classes of a token (the last is the text's edge), mixes, words before it by hash, file features.
_EDGE = 64
N_CLASSES, N_MIX, N_WORDS, N_FILE = 65, 56, 1025, 8
VIEWS = (N_CLASSES, N_CLASSES, N_CLASSES, N_CLASSES, N_MIX, N_WORDS, N_FILE)


class Tokens:
    """Tokens of texts: starts, ends, the text of each, and views, one column for each of VIEWS: the token's own class, those of the
    one before, two before and after, how its characters mix and whether it touches the token before, the word before it, its text's file feature."""

    def __init__(self, texts: list[bytes]):
        whole = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(whole + bytes(8), np.uint8)
        n = len(whole)
        c = _CLASS[self.buf[:n]]
        edge = np.flatnonzero(np.diff(c)) + 1
        edge = np.concatenate(([0], edge, [n]))
        visible = c[edge[:-1]] > 0
        self.starts, self.ends = edge[:-1][visible], edge[1:][visible]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_ends = np.cumsum(sizes) - 1
        self.text_starts = self.text_ends - sizes + 1
        self.first = np.concatenate((np.searchsorted(self.starts, self.text_starts), [len(self.starts)]))
        size = self.ends - self.starts
        upto = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int32)))
        got = {}
        for k, t in _TABLES.items():
            count = upto(t[self.buf[:n]])
            got[k] = count[self.ends] - count[self.starts]
        letters = got["upper"] + got["lower"]
        kind = np.select(
            [got["wide"] > 0, (got["digit"] > 0) & (letters == 0), (got["digit"] == 0) & (got["upper"] == 0), (got["digit"] == 0) & (got["upper"] == 1), (got["digit"] == 0) & (got["lower"] == 0), got["digit"] == 0, got["hex"] == size, got["upper"] == 0, got["lower"] == 0],
            [0, 1, 2, 3, 4, 5, 6, 7, 8],
            9,
        )
        cls = 4 + np.searchsorted([4, 8, 12, 20, 32], size, "right") * 10 + kind
        head = self.buf[self.starts]
        mark = c[self.starts] == 2
        cls[mark] = np.select([head[mark] == 61, head[mark] == 58, (head[mark] == 34) | (head[mark] == 39)], [0, 1, 2], 3)
        self.of = np.searchsorted(self.first[1:], np.arange(len(cls)), "right")

        # How letters of either case and digits alternate in a token, and its share of vowels.
        k = _CHAR[self.buf[:n]]
        turns = upto(np.concatenate(([False], (k[1:] != k[:-1]) & (k[1:] > 0) & (k[:-1] > 0))))
        turns = turns[self.ends] - turns[np.minimum(self.starts + 1, n)]
        vowels = np.where(letters > 0, 1 + np.searchsorted([0.15, 0.3], got["vowel"] / np.maximum(letters, 1), "right"), 0)
        mix = 8 * np.searchsorted([1, 2, 3, 4, 6, 10], turns, "right") + 2 * vowels
        mix[1:] += self.starts[1:] == self.ends[:-1]  # nothing stands between it and the token before

        # The last part of the nearest word before a token, at most three tokens away, in lower case.
        at = np.arange(len(cls))
        joint = np.maximum.accumulate(np.where(_JOINT[self.buf[:n]], np.arange(n), -1)) if n else np.zeros(0, np.int64)
        last = joint[self.ends - 1]
        part = np.where((last >= self.starts) & (last < self.ends - 1), last + 1, self.starts)
        low = np.frombuffer(whole.lower() + bytes(8), np.uint8)
        short = ~mark & (self.ends - part <= 16)
        word = np.full(len(cls), N_WORDS - 1)
        word[short] = (hash_spans(low, part[short], self.ends[short]) % np.uint64(N_WORDS - 1)).astype(np.int64)
        before = np.concatenate(([-1], np.maximum.accumulate(np.where(mark, -1, at))[:-1])) if len(at) else at
        near = (before >= self.first[self.of]) & (at - before <= 3)
        near = np.where(near, word[np.maximum(before, 0)], N_WORDS - 1)

        many = np.maximum(np.diff(self.first), 1)
        share = lambda x: np.bincount(self.of, x, len(texts)) / many
        file = (share((cls == 0) | (cls == 1)) > 0.02).astype(np.int64) + 2 * (share((got["digit"] > 0).astype(float)) > 0.05) + 4 * (many < 200)

        def beside(shift: int) -> np.ndarray:
            there = at + shift
            ok = (there >= self.first[self.of]) & (there < self.first[self.of + 1])
            return np.where(ok, cls[np.where(ok, there, 0)], _EDGE) if len(cls) else cls

        self.cls = cls
        self.views = np.stack([cls, beside(-1), beside(-2), beside(1), mix, near, file[self.of]], 1).astype(np.int32)


def base_matches(buf: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, by start and kind. No match crosses a newline."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(buf) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(buf)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(buf)]
    return sorted(found, key=lambda x: (x[0], x[2]))


@dataclass
class Field:
    """Weights: a table (values, 3) for each of VIEWS; move between tags."""

    tables: list[np.ndarray]
    move: np.ndarray

    def emissions(self, views: np.ndarray) -> np.ndarray:
        """Scores (tokens, 3)."""
        return sum((t[views[:, k]] for k, t in enumerate(self.tables)), np.zeros((len(views), 3)))

    def tags(self, views: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Viterbi's tags of all tokens; of: number of each token's text."""
        out = np.zeros(len(views), np.int8)
        if not len(views):
            return out
        e, m = self.emissions(views), self.move
        lift = max(m[a, x] + m[x, b] - m[a, 0] - m[0, b] for a in range(3) for x in (1, 2) for b in range(3))
        lift = max(lift, *(m[a, x] - m[a, 0] for a in range(3) for x in (1, 2)), *(m[x, b] - m[0, b] for b in range(3) for x in (1, 2)), 0.0)
        open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(axis=1) <= lift)
        if not len(open_):
            return out
        # Stretches of open tokens of one text; on either side stands an outside token or the text's edge.
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(open_) > 1) | (np.diff(of[open_]) > 0))))
        size = np.diff(np.concatenate((begin, [len(open_)])))
        first = open_[begin]
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        left = (first > 0) & (of[np.maximum(first - 1, 0)] == of[first])
        score = e[first] + np.where(left[:, None], m[0], 0.0)
        back = []
        for t in range(1, size[0]):
            k = int(np.searchsorted(-size, -t, "left"))  # stretches longer than t
            step = score[:k, :, None] + m[None]
            back.append(step.argmax(axis=1).astype(np.int8))
            score = np.concatenate((step.max(axis=1) + e[first[:k] + t], score[k:]))
        end = first + size - 1
        after = np.minimum(end + 1, len(views) - 1)
        right = (end + 1 < len(views)) & (of[after] == of[end])
        tag = (score + np.where(right[:, None], m[:, 0], 0.0)).argmax(axis=1)
        out[end] = tag
        for t in range(size[0] - 1, 0, -1):
            k = len(back[t - 1])
            tag[:k] = back[t - 1][np.arange(k), tag[:k]]
            out[first[:k] + t - 1] = tag[:k]
        return out


def fit(examples: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.05, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam over all examples (views, tags) at once. Tokens stand by place, so that a step of the forward and
    backward passes, scaled at each place, is one small product for all examples."""
    w = [np.zeros((size, 3)) for size in VIEWS] + [np.zeros((3, 3))]
    w[0][:, 0] = 0.5
    if not examples:
        return Field(w[:-1], w[-1])
    examples = sorted(examples, key=lambda x: -len(x[1]))  # at each place, the examples that reach it are the first ones
    size = np.array([len(y) for _, y in examples])
    wide, n = size[0], len(examples)
    many = [int((size > t).sum()) for t in range(wide)]
    # By place, one place after another.
    start = np.cumsum(size) - size
    order = np.concatenate([start[: many[t]] + t for t in range(wide)])
    every = np.concatenate([v for v, _ in examples])[order]
    views = [np.ascontiguousarray(every[:, k]) for k in range(len(VIEWS))]
    tag = np.concatenate([y for _, y in examples])[order]
    hot = np.eye(3)[tag]
    at = np.concatenate(([0], np.cumsum(many)))
    real = np.zeros((3, 3))
    for t in range(1, wide):
        np.add.at(real, (tag[at[t - 1] : at[t - 1] + many[t]], tag[at[t] : at[t + 1]]), 1)
    m1, m2 = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for r in range(1, rounds + 1):
        e = sum(w[k][v] for k, v in enumerate(views))
        e = np.exp(e - e.max(axis=1, keepdims=True))
        move = np.exp(w[-1])
        a, b, low = np.empty_like(e), np.ones_like(e), np.empty((len(e), 1))
        for t in range(wide):
            here, prior = slice(at[t], at[t + 1]), slice(at[t - 1], at[t - 1] + many[t])
            now = (a[prior] @ move) * e[here] if t else e[here]
            low[here] = now.sum(axis=1, keepdims=True)
            a[here] = now / low[here]
        both = np.zeros((3, 3))
        for t in range(wide - 1, 0, -1):
            here, prior = slice(at[t], at[t + 1]), slice(at[t - 1], at[t - 1] + many[t])
            ahead = e[here] * b[here] / low[here]
            b[prior] = ahead @ move.T
            both += a[prior].T @ ahead
        d = a * b - hot
        grads = [np.stack([np.bincount(v, d[:, y], len(w[k])) for y in range(3)], 1) / n + l2 * w[k] for k, v in enumerate(views)]
        grads.append((both * move - real) / n + l2 * w[-1])
        for k, g in enumerate(grads):
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.99 * m2[k] + 0.01 * g * g
            w[k] = w[k] - rate * (m1[k] / (1 - 0.9**r)) / (np.sqrt(m2[k] / (1 - 0.99**r)) + 1e-8)
    return Field(w[:-1], w[-1])


# Words that name a secret, and ways to assign one.
_NAMES = "password passwd pwd pass passphrase secret token key apikey auth credential credentials bearer pin login cookie session signature".split()
_ASSIGNS = [(": ", ""), ("=", ""), (" = ", ""), ('="', '"'), (': "', '"'), ("='", "'"), (":", "")]
_LETTERS = string.ascii_letters + string.digits
_ALPHABETS = [_LETTERS, _LETTERS, string.ascii_letters, _LETTERS + "+/", _LETTERS + "-_", string.ascii_lowercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF"]


def _invented(r: random.Random, some: list[str]) -> tuple[str, str, str]:
    """Text before a secret, the secret, and text behind it. some: words of a document."""
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    name = r.choice(["", r.choice(some)[:8] + r.choice("_-."), ""]) + r.choice(_NAMES)
    name = r.choice([name, name, name.upper(), name.title()])
    begin, end = r.choice(_ASSIGNS)
    chars, form = r.choice(_ALPHABETS), r.random()
    if form < 0.2:
        return name + begin, r.choice([of(_LETTERS + r.choice(["", "!@#$%^&*?"]), r.randint(6, 20)), of(string.ascii_lowercase, r.randint(3, 9)) + of(string.digits, r.randint(1, 4)) + of("!@#$" + string.ascii_lowercase, r.randint(0, 4))]), end
    if form < 0.5:
        said = of(chars, r.randint(16, 64))
    elif form < 0.75:
        joint = r.choice("-._")
        said = joint.join(of(chars, r.randint(4, 24)) for _ in range(r.randint(2, 5)))
        said += of(chars, max(0, 20 - len(said)))
    else:
        said = of(r.choice([string.ascii_lowercase, _LETTERS]), r.randint(2, 6)) + r.choice("_-.") + of(chars, r.randint(16, 48))
    return r.choice([(name + begin, said, end), (r.choice(["", "", '"', "(", "id "]), said, "")])


def _harmless(r: random.Random, some: list[str]) -> str:
    """A string that isn't a secret but looks unlike prose."""
    w = lambda: r.choice(some)[:12].lower()
    n = lambda a, b: str(r.randint(a, b))
    return r.choice(
        [
            lambda: f"{w()}{r.choice([': ', '=', ' = '])}{r.choice([w(), n(0, 99999)])}",
            lambda: f"{w()}.{w()}{r.choice(['', n(0, 99)])}@{w()}.com",
            lambda: f"https://www.{w()}.com/{w()}/{w()}-{w()}-{n(1, 99999)}",
            lambda: f"/{w()}/{w()}_{w()}/{w()}-{n(1, 20)}.{w()[:3]}",
            lambda: f"20{n(10, 29)}-{n(10, 12)}-{n(10, 28)}T{n(10, 23)}:{n(10, 59)}:{n(10, 59)}",
            lambda: ".".join(n(0, 255) for _ in range(4)),
            lambda: f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}-{w()}",
            lambda: f"+{n(1, 99)}-{n(100, 999)}-{n(100, 999)}-{n(1000, 9999)}",
            lambda: n(10**9, 10**15),
            lambda: "".join(w().title() for _ in range(r.randint(2, 4))),
            lambda: "_".join(w() for _ in range(r.randint(2, 4))) + r.choice(["", f"_{n(1, 999)}"]),
            lambda: "-".join(w() for _ in range(r.randint(3, 6))),
            lambda: w().upper() + n(1, 9999),
            lambda: f"{r.choice(_NAMES)} {w()} {w()}",
        ]
    )()


def examples_of(doc_id: int | None, text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training examples (views, tags) of one document: around its matches, around an invented secret and harmless strings among its
    words, and without any."""
    r = random.Random(doc_id or 0)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def add(text: bytes, spans: list[tuple[int, int]], plain: int, also: tuple[int, int] = (0, 0)) -> None:
        t = Tokens([text])
        tags = np.zeros(len(t.cls), np.int64)
        for a, b in spans:
            inside = np.flatnonzero((t.starts < b) & (t.ends > a))
            tags[inside] = 2
            tags[inside[:1]] = 1
        centres = [int(i) for i in r.sample(range(len(tags)), len(tags)) if tags[i] == 1][:20]
        clear = [int(i) for i in np.flatnonzero(tags == 0)]
        odd = [i for i in clear if 4 <= t.cls[i] and t.cls[i] not in (6, 7, 16, 17, 26, 27, 36, 37)]
        centres += r.sample(clear, min(plain, len(clear))) + r.sample(odd, min(2 * plain, len(odd)))
        centres += [i for i in clear if also[0] <= t.starts[i] < also[1]][:2]
        for i in centres:
            a, b = max(0, i - AROUND), min(len(tags), i + 2 * AROUND)
            out.append((t.views[a:b], tags[a:b]))

    add(text, [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] + [(a, b) for a, b, k in base_matches(text) if k], 2)
    words = [w.decode() for w in text.split()] if text else []
    if words:
        for _ in range(4):
            at = r.randrange(len(words))
            some, behind = words[at : at + 6], words[at + 6 : at + 12]
            before, said, after = _invented(r, words)
            head = " ".join([*some, before]).encode()
            add(head + said.encode() + " ".join([after, *behind]).encode(), [(len(head), len(head) + len(said.encode()))], 1)
            other, head = _harmless(r, words).encode(), " ".join([*some, ""]).encode()
            add(head + other + " ".join(["", *behind]).encode(), [], 0, (len(head), len(head) + len(other)))
    return out


def _collect_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in passes(batches):
        rows = [(d, v.astype("<i4").tobytes(), y.astype(np.int8).tobytes()) for d, t in zip(batch.column("doc_id").to_pylist(), texts) for v, y in examples_of(d, t)]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["doc_id", "views", "tags"])


def fit_field(docs: DataFrame) -> Field:
    """Fit to SAMPLE_DOCS documents, those of the smallest id hash; one text of an id that rows repeat. Patterns and field then scan
    every document whole."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # SAMPLE_DOCS rows
    one = sample.groupBy("doc_id").agg(F.min("text").alias("text"))
    found = one.mapInArrow(_collect_examples, "doc_id long, views binary, tags binary").toArrow().to_pylist()
    found.sort(key=lambda x: (x["doc_id"], x["views"], x["tags"]))
    return fit([(np.frombuffer(x["views"], "<i4").reshape(-1, len(VIEWS)), np.frombuffer(x["tags"], np.int8).astype(np.int64)) for x in found])


def scan(texts: list[bytes], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, kind) of each text, in bytes of it, by start and kind. Of the field's, the parts are given that no pattern
    covers and that hold a word character."""
    t = Tokens(texts)
    whole = t.buf[: t.text_ends[-1] + 1].tobytes() if texts else b""
    base = base_matches(whole)
    tags = field.tags(t.views, t.of)
    on = np.flatnonzero(tags)
    added = []
    if len(on):
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(on) > 1) | (tags[on[1:]] == 1) | (np.diff(t.of[on]) > 0))))
        stop = np.concatenate((begin[1:], [len(on)])) - 1
        taken = np.zeros(len(whole) + 1, bool)
        for a, b, _ in base:
            taken[a:b] = True
        for a, b in zip(t.starts[on[begin]].tolist(), t.ends[on[stop]].tolist()):
            edge = np.flatnonzero(np.diff(np.concatenate(([True], taken[a:b], [True])).astype(np.int8))) + a
            added += [(x, y, 3) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()) if (_CLASS[t.buf[x:y]] == 1).any()]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = sorted(base + added, key=lambda x: (x[0], x[2]))
    of = np.searchsorted(t.text_ends, [a for a, _, _ in found], "left").tolist()
    starts = t.text_starts.tolist()
    for i, (a, b, k) in zip(of, found):
        out[i].append((a - starts[i], b - starts[i], k))
    return out


def in_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if not spans or text.isascii():
        return spans
    upto = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(upto[a]), int(upto[b]), k) for a, b, k in spans]


def _finder(field: Field):
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in passes(batches, limit=SCAN_BYTES):
            found = [in_points(t, s) for t, s in zip(texts, scan(texts, field))]
            counts = [pa.array([sum(k == kind for _, _, k in s) for s in found], pa.int64()) for kind in range(3)]
            base = [hashlib.sha256(said([x for x in s if x[2] < 3]).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([said(s) for s in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return find


def find_secrets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans) of documents (doc_id, text).

    spans: kind:start:end in code points, end exclusive, by start and kind, joined by commas; kinds are those of the
    patterns, and crf for what the field tags and no pattern covers, of any length. base_sha256: of the patterns' spans alone.

    Null text: as empty, without spans. Null doc_id stays null and is no training example; repeated rows are scanned
    each. Empty table: no rows, and a field without examples adds no span. Further columns are ignored. The field is
    fitted to SAMPLE_DOCS documents (see fit_field).
    """
    field = fit_field(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_finder(field), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: bytes, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of (overlapping) spans replaced by REDACTED."""
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], REDACTED.encode()]
        at = b
    return b"".join([*out, text[at:]]).decode()


def _redacter(field: Field):
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in passes(batches, limit=SCAN_BYTES):
            spans = scan(texts, field)
            given = batch.column("text").to_pylist()
            said = [redact_text(t, s) if s else g for t, s, g in zip(texts, spans, given)]
            cols = {c: batch.column(c) for c in batch.schema.names}
            cols["text"] = pa.array(said, batch.schema.field("text").type)
            if "n_chars" in cols:
                sizes = [len(t) if s else n for t, s, n in zip(said, spans, cols["n_chars"].to_pylist())]
                cols["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return redact


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; each stretch of secrets in text is replaced by REDACTED, and n_chars, where there is
    one, follows. Null or empty text stays as it is; repeated rows are treated each. Empty table: no rows."""
    return docs.mapInArrow(_redacter(fit_field(docs)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
