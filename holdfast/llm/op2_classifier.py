"""A quality classifier: histogram gradient-boosted trees over statistics of documents.

Trees grow level by level on binned statistics in numpy; a fitted forest is a set of flat arrays that are traversed for
many rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import passes, table
from holdfast.llm.textops import SHINGLE, Words, windows

#: The classifier is fitted on so many labelled documents at most, those of the smallest id hash.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = ("log_words", "log_chars", "word_length", "upper", "digits", "symbols", "stops", "bang", "non_ascii", "spaces", "capitalised", "distinct", "adjacent", "repeated", "lines", "dup_lines", "short_words", "one_byte_words")
_KIND = np.zeros((256, 6), np.float32)
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
_KIND[list(b"#*$%&|<>~^\\{}[]_=+@"), 2] = 1
_KIND[list(b".,;:?"), 3] = 1
_KIND[list(b"!"), 4] = 1
_KIND[128:, 5] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    words = Words(texts)
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    h = words.hashes()
    w = windows(h)
    size = words.ends - words.starts
    head = words.buf[words.starts]
    capital = (head >= 65) & (head <= 90)
    for r, (text, a, b, i, j) in enumerate(zip(texts, words.text_starts.tolist(), words.text_ends.tolist(), words.first[:-1].tolist(), words.first[1:].tolist())):
        if not text:
            continue
        n, c = j - i, len(text)
        hist = np.bincount(words.buf[a:b], minlength=256)
        kinds = hist @ _KIND / c
        lines = [x for x in text.split(b"\n") if x]
        row = [np.log1p(n), np.log1p(c), 0, *kinds, hist[32] / c]
        if n:
            s, z, five = h[i:j], size[i:j], w[i : max(i, j - SHINGLE + 1)]
            row[2] = z.mean()
            row += [capital[i:j].mean(), len(np.unique(s)) / n, float((s[1:] == s[:-1]).sum()) / n, 1 - len(np.unique(five)) / len(five) if len(five) else 0]
        else:
            row += [0, 0, 0, 0]
        row += [np.log1p(len(lines)), 1 - len(set(lines)) / len(lines) if lines else 0]
        row += [(size[i:j] <= 3).mean(), (size[i:j] == 1).mean()] if n else [0, 0]
        out[r] = row
    return out


@dataclass
class Forest:
    """Flat arrays, all trees one after another: node k tests feature[k] <= cut[k] and goes on to child[k] or child[k] + 1; in a
    leaf child[k] = k, so that a fixed number of steps ends there. roots: first node of each tree."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            child = self.child[at]
            at = np.where(child == at, at, child + (x[rows, self.feature[at]] > self.cut[at]))
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Boosted trees for labels 0 and 1. Without rows or with one label, a forest of no tree with the (smoothed) share of 1."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    out = Forest(base, depth, *(np.zeros(0, t) for t in (np.int64, np.int64, np.float32, np.int64, np.float64)))
    if not len(y) or y.min() == y.max():
        return out
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])).astype(np.float32) for f in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: cuts[b - 1] < x <= cuts[b]
    flat = binned + np.arange(d) * bins
    raw = np.full(len(y), base)
    roots, feature, cut, child, value = [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(child))
        feature.append(0), cut.append(0.0), child.append(len(child)), value.append(0.0)
        node, level = np.zeros(len(y), np.int64) + roots[-1], [roots[-1]]
        for _ in range(depth):
            place = {k: i for i, k in enumerate(level)}
            live = np.flatnonzero(np.isin(node, level))
            if not len(live):
                break
            slot = node[live] - level[0]  # a level's nodes are numbered in a row
            keys = (slot[:, None] * (d * bins) + flat[live]).ravel()
            g, h, n = (np.bincount(keys, np.repeat(v, d) if v is not None else None, len(level) * d * bins).reshape(len(level), d, bins).cumsum(axis=2) for v in (grad[live], hess[live], None))
            following = []
            for k, i in place.items():
                gt, ht, nt = g[i, 0, -1], h[i, 0, -1], n[i, 0, -1]
                gain = g[i] ** 2 / (h[i] + l2) + (gt - g[i]) ** 2 / (ht - h[i] + l2) - gt**2 / (ht + l2)
                gain[(n[i] < least) | (nt - n[i] < least)] = 0
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                feature[k], cut[k], child[k] = int(f), float(cuts[f][b]), len(child)
                mine = live[slot == i]
                node[mine] = child[k] + (binned[mine, f] > b)
                for _ in range(2):
                    following.append(len(child))
                    feature.append(0), cut.append(0.0), child.append(len(child)), value.append(0.0)
            level = following
            if not level:
                break
        first = roots[-1]
        sums = np.bincount(node - first, grad, len(child) - first), np.bincount(node - first, hess, len(child) - first)
        value[first:] = (-rate * sums[0] / (sums[1] + l2)).tolist()
        raw += np.array(value)[node]
    return Forest(base, depth, np.array(roots), np.array(feature), np.array(cut, np.float32), np.array(child), np.array(value))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in passes(batches):
        x = statistics(texts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Forest:
    """Fit on the labelled documents that aren't held out: at most SAMPLE_ROWS ids, of the smallest hash. Ids whose labels are
    null or disagree don't count."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where(F.col("quality") == F.col("other")).where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # SAMPLE_ROWS at most
    # An id that many rows repeat still gives one example.
    rows = found.mapInArrow(_examples, "doc_id long, quality int, x array<float>").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("e")).select("doc_id", "e.*").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows.column("quality").to_pylist(), np.float64))


def _scorer(forest: Forest):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in passes(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(forest.score(statistics(texts)))], ["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of documents (doc_id, text), fitted to labels (doc_id, quality).

    Null text: as empty, which has a score too. Null doc_id: not held out. Repeated rows get equal scores each. No
    labelled document: every score is 0.5. Empty table: no rows. Further columns are ignored.
    """
    forest = fit_quality(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scorer(forest), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keeper(forest: Forest):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in passes(batches):
            yield batch.filter(pa.array(forest.score(statistics(texts)) >= THRESHOLD))

    return keep


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents whose score is THRESHOLD or more, with all their columns."""
    return docs.mapInArrow(_keeper(fit_quality(docs, labels)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
