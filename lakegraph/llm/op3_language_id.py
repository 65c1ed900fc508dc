"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits; one binary classifier per bit works on hashed byte
n-grams (1 to 4 bytes, A-Z as a-z) of the whole text. Decoding compares the bits' margins with every
codeword: the logistic loss of each bit is weighted by how well that bit's classifier did on that
language in training, the nearest codeword wins, and a second one almost as near marks the text as
ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.llm.shared import PIECE, arrow_rows, held_out, table, text_buffers, with_arrow

# About this many labelled documents per language, and altogether, are drawn for training.
SAMPLE_PER_LANGUAGE, SAMPLE = 1000, 6000
BITS = 12
BUCKETS = 1 << BITS
LONGEST_GRAM = 4
STEPS, RATE, MOMENTUM, DECAY = 80, 4.0, 0.9, 1e-5
# The loss is scaled by this before the softmax; two losses closer than this are ambiguous.
SHARPNESS, AMBIGUOUS = 4.0, 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD = _FOLD * np.uint32(2654435761) + np.uint32(12345)


def gram_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of hashed n-grams, one row per text, some texts at a time and long texts piece by piece."""
    data, offsets = text_buffers(column)
    row, n = 0, len(column)
    while row < n:
        stop = min(n, row + 32, max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1))
        counts = np.zeros((stop - row) * BUCKETS)
        low, high = offsets[row], offsets[stop]
        owner_all = np.repeat(np.arange(stop - row, dtype=np.int64), np.diff(offsets[row:stop + 1])) if high - low <= 2 * PIECE else None
        for at in range(low, high, 2 * PIECE):
            end = min(at + 2 * PIECE, high)
            part = _FOLD[data[at:min(end + LONGEST_GRAM - 1, high)]]
            owner = owner_all if owner_all is not None else np.zeros(len(part), np.int64)
            h = part
            for k in range(1, LONGEST_GRAM + 1):
                if k > 1:
                    h = (h[:len(part) - k + 1] * np.uint32(0x01000193)) ^ part[k - 1:]
                many = min(len(h), end - at)
                slot = ((h[:many] * np.uint32(2654435769)) >> np.uint32(32 - BITS)).astype(np.int64)
                slot += owner[:many] * BUCKETS
                if k > 1 and stop - row > 1:
                    slot = slot[owner[:many] == owner[k - 1:k - 1 + many]]
                counts += np.bincount(slot, minlength=len(counts))
        yield counts.reshape(stop - row, BUCKETS)
        row = stop


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Square roots of shares: rows of length one, or of zeros for a text without bytes."""
    for counts in gram_counts(column):
        yield np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """Rows of -1 and 1: every split of up to five languages, else 10 log2(K) random ones (at least 31)."""
    if languages <= 5:
        splits = [[1 if (s >> k) & 1 else -1 for k in range(languages)] for s in range(1, 1 << max(0, languages - 1))]
        return np.array(splits, np.float32).reshape(-1, languages).T
    rng = np.random.default_rng(3)
    while True:
        code = rng.choice(np.array([-1, 1], np.float32), (languages, max(31, int(10 * np.log2(languages)))))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        if len(np.unique(code, axis=0)) == languages:
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and whether another is almost as near."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margin = x @ self.weights + self.bias
        loss = np.einsum("kb,nkb->nk", self.trust, np.logaddexp(0, -self.code[None] * margin[:, None]))
        near = np.sort(loss, axis=1)
        p = np.exp(SHARPNESS * (near[:, :1] - loss)).sum(axis=1)
        return loss.argmin(axis=1), 1 / p, near[:, 1] - near[:, 0] < AMBIGUOUS


def fit(x: np.ndarray, y: list[str]) -> Model:
    """All bits' logistic regressions at once, by gradient steps with momentum."""
    languages = sorted(set(y))
    code = codewords(len(languages))
    k = np.searchsorted(languages, y)
    target = code[k]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    balance = (len(y) / len(languages) / np.bincount(k, minlength=len(languages)))[k][:, None].astype(np.float32)
    for _ in range(STEPS if len(languages) > 1 else 0):
        g = -balance * target / (1 + np.exp(target * (x @ w + b))) / len(x)
        vw = MOMENTUM * vw - RATE * (x.T @ g + DECAY * w)
        vb = MOMENTUM * vb - RATE * 0.1 * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = (target * (x @ w + b) > 0).astype(np.float32)
    trust = np.array([right[k == i].mean(axis=0) for i in range(len(languages))]).reshape(len(languages), -1)
    return Model(languages, code, w, b, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.concatenate([*features(batch.column(1)), np.zeros((0, BUCKETS), np.float32)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["lang", "x"])


def train(docs: DataFrame) -> Model | None:
    """A model from ``docs(doc_id, text, lang)``: rows that are not held out, a sample of bounded size.

    The sample takes each language's documents by a hash of the id, about ``SAMPLE_PER_LANGUAGE`` of
    each (fewer if there are many languages). None if no row has a language and a text.
    """
    arrow_rows(docs.sparkSession)
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang"))
    many = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not many:
        return None
    quota = min(SAMPLE_PER_LANGUAGE, SAMPLE / len(many))
    share = F.create_map(*[F.lit(v) for lang, n in many.items() for v in (lang, min(1.0, quota / n))])
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    rows = drawn.select("lang", "text").mapInArrow(_rows, "lang string, x binary").toArrow()
    if not len(rows):
        return None
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return fit(x, rows["lang"].to_pylist())


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` with the predicted language, its probability, and whether it is ambiguous.

    A null text, or one without a letter, is ``und`` with score 0 and not ambiguous, and so is every
    text if nothing was learned. Columns named like an output are replaced by it.
    """
    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())]

    def run(column: pa.Array) -> list[pa.Array]:
        letters = np.array([bool(t.is_valid and _LETTER.search(t.as_py())) for t in column], bool)
        if model is None or not len(column):
            best, score, unsure = np.zeros(len(column), int), np.zeros(len(column)), np.zeros(len(column), bool)
            letters[:] = False
        else:
            best, score, unsure = (np.concatenate(z) for z in zip(*[model.predict(x) for x in features(column)]))
        return [pa.array([model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters)], pa.string()),
                pa.array(np.where(letters, score, 0.0).astype(float)), pa.array(unsure & letters)]
    return with_arrow(docs, ["text"], fields, run)


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the documents whose language is unknown or ambiguous; all columns as they were."""
    names = ("_lid_lang", "_lid_score", "_lid_ambiguous")
    return identify(docs, model, names).filter((F.col(names[0]) != UNKNOWN) & ~F.col(names[2])).select(docs.columns)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned from rows that are not held out; ``und`` without a letter."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
