"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

One pass over the texts gives a row of statistics each, which is written. The trees are fitted on a
bounded sample of the labelled rows: features are binned by quantiles, each level of a tree is one set
of gradient histograms, and every tree is complete to the same depth, so that a forest is three flat
arrays. Scoring walks all trees of a batch of rows at once, one level per step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.llm.shared import PIECE, arrow_rows, held_out, stored, table, text_buffers, with_arrow, word_hashes

# About this many labelled rows are drawn for training.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 120, 4, 64, 0.12, 2.0, 1.0
ACCEPT = 0.7
_GROUPS = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "newline": (10,), "stop": (46,),
           "comma": (44,), "bar": (124,), "shout": (33, 63), "symbol": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 126),
           "bracket": (40, 41, 91, 93, 123, 125), "quote": (34, 39, 96), "dash": (45, 95, 47, 92), "mark": (58, 59), "wide": range(128, 256)}
_GROUP = np.full(256, len(_GROUPS))
for _i, _bytes in enumerate(_GROUPS.values()):
    _GROUP[list(_bytes)] = _i
NAMES = ["log_bytes", *_GROUPS, "log_words", "word_bytes", "distinct_words", "top_word", "same_as_before", "distinct_pairs",
         "same_as_two_before", "log_lines", "line_bytes", "distinct_bytes"]


def _byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, 256))
    row = 0
    while row < len(out):
        stop = min(len(out), row + 256, max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1))
        if stop == row + 1:
            out[row] = np.bincount(data[offsets[row]:offsets[stop]], minlength=256)
        else:
            owner = np.repeat(np.arange(stop - row) * 256, np.diff(offsets[row:stop + 1]))
            out[row:stop] = np.bincount(owner + data[offsets[row]:offsets[stop]], minlength=(stop - row) * 256).reshape(-1, 256)
        row = stop
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text; all zero for a null or empty text."""
    data, offsets = text_buffers(column)
    counts = _byte_counts(data, offsets)
    size = np.maximum(counts.sum(axis=1), 1)
    groups = np.stack([counts[:, _GROUP == i].sum(axis=1) / size for i in range(len(_GROUPS))], axis=1)
    lines = counts[:, 10] + 1
    words = np.zeros((len(column), 7))
    blank = counts[:, [9, 10, 11, 12, 13, 32]].sum(axis=1)
    for rows, hashes, ends in word_hashes(column):
        for row, a, b in zip(rows, ends[:-1], ends[1:]):
            n = b - a
            if n:
                w = hashes[a:b]
                _, many = np.unique(w, return_counts=True)
                pairs = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) if n > 1 else 1
                words[row] = (np.log1p(n), (counts[row].sum() - blank[row]) / n, len(many) / n, many.max() / n,
                              (w[1:] == w[:-1]).sum() / n, pairs / n, (w[2:] == w[:-2]).sum() / n)
    some = counts.sum(axis=1) > 0
    return np.column_stack([np.log1p(counts.sum(axis=1)), groups, words, np.log(lines) * some, np.log1p(size / lines) * some,
                            (counts > 0).sum(axis=1)]).astype(np.float32)


@dataclass
class Forest:
    """Per tree and node in heap order: the feature, the threshold (go right above it), the leaf's value."""
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        trees = np.arange(len(self.feature))
        for low in range(0, len(x) if len(trees) else 0, 1024):
            rows = x[low:low + 1024]
            at = np.zeros((len(rows), len(trees)), np.int64)
            line = np.arange(len(rows))[:, None]
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[line, self.feature[trees, at]] > self.threshold[trees, at])
            out[low:low + 1024] += self.value[trees, at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss; the share of ones only, if there is nothing to learn."""
    n, features = x.shape
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    nodes, inner = 2 ** (DEPTH + 1) - 1, 2 ** DEPTH - 1
    if n < 10 or y.min() == y.max():
        return Forest(np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes)), start)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(features)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(features)], axis=1)
    slot = binned + np.arange(features) * BINS
    table_ = np.full((features, BINS), np.inf)
    for f, c in enumerate(cuts):
        table_[f, :len(c)] = c
    margin = np.full(n, start)
    feature, threshold, value = np.zeros((TREES, nodes), int), np.full((TREES, nodes), np.inf), np.zeros((TREES, nodes))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, many = 2 ** depth - 1, 2 ** depth
            where = ((at - first)[:, None] * (features * BINS) + slot).reshape(-1)
            shape = (many, features, BINS)
            sums = [np.bincount(where, np.repeat(v, features), many * features * BINS).reshape(shape).cumsum(axis=2) for v in (g, h)]
            total = [s[:, :1, -1:] for s in sums]
            gl, hl = sums
            gr, hr = total[0] - gl, total[1] - hl
            gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
            gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT) | ~np.isfinite(table_)[None]] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(many, -1)[np.arange(many), best] > 1e-6):
                feature[t, first + k], cut = divmod(int(best[k]), BINS)
                threshold[t, first + k] = table_[feature[t, first + k], cut]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf_g, leaf_h = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        value[t, inner:] = -RATE * leaf_g / (leaf_h + RIDGE)
        margin += value[t, at]
    return Forest(feature, threshold, value, start)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, statistics`` (float32 values as bytes) of every row."""
    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([r.tobytes() for r in statistics(column)], pa.binary())]
    return with_arrow(docs.select("doc_id", "text"), ["text"], [T.StructField("statistics", T.BinaryType())], run).select("doc_id", "statistics")


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, len(NAMES))


def train(rows: DataFrame, labels: DataFrame) -> Forest:
    """A forest from ``rows(doc_id, statistics)`` and ``labels(doc_id, quality)`` that are not held out.

    Labels are drawn by a hash of the id, about ``SAMPLE`` of them; null labels are left out. Of several
    labels of a document each counts.
    """
    labels = labels.filter(~held_out() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, SAMPLE / max(1, labels.count()))
    drawn = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    got = rows.join(drawn, "doc_id").select("doc_id", "statistics", "quality").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    y = np.array(got["quality"].to_pylist(), float)
    return fit(_matrix(got["statistics"].to_pylist()), y)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score`` for every row of ``docs(doc_id, text)``: the chance of label 1.

    A null or empty text is scored from zero statistics. Without usable labels every score is 0.5.
    Rows that share a doc_id are scored one by one. Other columns are ignored.
    """
    arrow_rows(docs.sparkSession)
    rows = stored(with_statistics(docs), "statistics")
    forest = train(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(_matrix(batch.column(1).to_pylist())))], ["doc_id", "score"])
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Score of every whole text of documents, fitted on labelled rows that are not held out; a null or empty text has a score too."""
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
