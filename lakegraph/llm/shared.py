"""Small helpers of this subpackage: written intermediates, Arrow text buffers, word and shingle hashes.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. UTF-8 never uses
those bytes inside another character, so all of it works on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.session import work_path

SHINGLE_WORDS = 5
SPACES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Texts are hashed in pieces of about this many bytes, so that memory does not follow the text.
PIECE = 1 << 19
_U = np.uint64
_MIX1, _MIX2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_powers: dict[str, np.ndarray] = {}


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows per Arrow batch than Spark's 10,000: whole texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, whatever executor is lost."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is held out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all 64 bits of each value."""
    x = x ^ (x >> _U(30))
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and the offsets of each; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _power(inverse: bool) -> np.ndarray:
    name = "inverse" if inverse else "plain"
    if name not in _powers:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        out = np.full(2 * PIECE + 2, base, np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name]


def _runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and raw hash of each word; ``starts`` are places where a word must break."""
    n = len(data)
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(False)[:n], out=total[1:])
    return begin, end, (total[end] - total[begin]) * _power(True)[begin]


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, piece by piece; a word over a border is carried on."""
    out, carry, size = [], _U(0), 0
    for at in range(0, len(data), PIECE):
        piece = data[at:at + PIECE]
        begin, end, raw = _runs(piece, np.zeros(0, np.int64))
        if size:
            if len(begin) and begin[0] == 0:
                with np.errstate(over="ignore"):
                    raw[0] = carry + raw[0] * _U(pow(_BASE, size, 1 << 64))
                joined = True
            else:
                out.append(np.array([carry], np.uint64))
                joined = False
        else:
            joined = False
        if len(end) and end[-1] == len(piece):
            size = (size if joined and len(end) == 1 else 0) + int(end[-1] - begin[-1])
            carry, raw = raw[-1], raw[:-1]
        else:
            carry, size = _U(0), 0
        out.append(raw)
    if size:
        out.append(np.array([carry], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(column: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Hashed words of whole texts: (rows, hashes, offsets of each row's words), a few rows at a time."""
    data, offsets = text_buffers(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        stop = min(stop, len(column))
        part, starts = data[offsets[row]:offsets[stop]], offsets[row:stop] - offsets[row]
        if len(part) > 2 * PIECE:  # one row only
            words = _long_words(part)
            yield range(row, stop), mix(words + _GOLD), np.array([0, len(words)])
        else:
            begin, _, raw = _runs(part, starts)
            yield range(row, stop), mix(raw + _GOLD), np.append(np.searchsorted(begin, starts), len(begin))
        row = stop


def shingle_sets(column: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct 64-bit shingle hashes of each text.

    A text with fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    for rows, words, offsets in word_hashes(column):
        n = max(0, len(words) - k + 1)
        joined = np.zeros(n, np.uint64)
        for j in range(k):
            joined += words[j:j + n] * _PLACE[j]
        joined = mix(joined)
        for row, a, b in zip(rows, offsets[:-1], offsets[1:]):
            if b - a >= k:
                yield row, np.unique(joined[a:b - k + 1])
            elif b > a:
                yield row, mix((words[a:b] * _PLACE[:b - a]).sum(keepdims=True) + _PLACE[k + b - a])
            else:
                yield row, joined[:0]


def with_arrow(df: DataFrame, inputs: list[str], outputs: list[T.StructField], function) -> DataFrame:
    """``df`` with columns made by ``function(*input arrays) -> list of arrays``, batch by batch.

    All other columns pass through; a column named like an output is replaced by it.
    """
    made = {f.name.lower() for f in outputs}
    passed = [c for c in df.columns if c.lower() not in made]
    schema = T.StructType([df.schema[c] for c in passed] + outputs)
    n, names = len(inputs), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], *function(*batch.columns[:n])], names)
    arrow_rows(df.sparkSession)
    return df.select(*[df[c] for c in inputs], *[df[c] for c in passed]).mapInArrow(run, schema)


def forest(a: list, b: list) -> list[tuple]:
    """Those of the links (a, b) that join two parts which the links before did not."""
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x] = root.get(root[x], root[x])
        return x
    kept = []
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def by_group(function, schema: pa.Schema):
    """For mapInArrow over rows sorted by their first column: ``function(rows without it) -> tuples``."""
    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, [], []
        for batch in batches:
            for head, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if head != key:
                    if len(group) > 1:
                        found += function(group)
                    key, group = head, []
                    if len(found) > 4096:
                        yield batch_of(found)
                        found = []
                group.append(row)
        if len(group) > 1:
            found += function(group)
        yield batch_of(found)
    return run
