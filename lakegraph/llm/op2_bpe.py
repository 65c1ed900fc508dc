"""Byte-level BPE encoding and decoding by a rank file, many pieces at a time.

Texts are cut into pieces by the tokenizer's pattern. Pieces that a task has not seen yet are sorted
by length into padded matrices of token ids. In each round every row merges its leftmost pair of
smallest rank; the merged ids come from a hash table of all pairs, the row closes up by one column,
and rows without a pair to merge leave the matrix. Pieces above ``LONGEST`` bytes take the same merges
from a heap, so that their time does not grow with the square of their length.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.llm.shared import table, with_arrow

LONGEST = 256
ROWS = 2048
# Distinct pieces a worker remembers in each of two generations, and characters (or pieces of one long
# text) it cuts at a time.
REMEMBERED, CHARS, PIECES = 1 << 17, 1 << 20, 1 << 16
NO_RANK = np.uint32(0xFFFFFFFF)


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of their merge."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        ranks = np.array(list(pairs.values()), np.uint32)
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, NO_RANK)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            keys, ranks, slot = keys[~put], ranks[~put], self._next(slot[~put])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NO_RANK where there is no such merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(keys.shape, NO_RANK)
        seen = self.keys[slot]
        hit = seen == keys
        out[hit] = self.ranks[slot[hit]]
        open_ = np.nonzero(~hit & (seen != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_[0]):
            slot[open_] = self._next(slot[open_])
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[tuple(x[hit] for x in open_)] = self.ranks[slot[open_][hit]]
            go = ~hit & (seen != np.uint64(0xFFFFFFFFFFFFFFFF))
            open_ = tuple(x[go] for x in open_)
        return out


class Vocabulary:
    """Ranks of a tokenizer file (token in base64 and rank on each line) and its splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.pad = len(self.tokens)
        self.ids = np.dtype("<u2") if self.pad < 1 << 16 else np.dtype("<u4")
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.uint32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pairs = PairTable(pairs)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _matrix(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of similar length, as bytes."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        ids = np.full((len(words), width + 1), self.pad, np.uint32)
        ids[np.arange(width + 1) < size[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out = [b""] * len(words)
        row = np.arange(len(words))
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            live = best != NO_RANK
            done = np.flatnonzero(~live)
            if len(done):
                flat = ids[done][np.arange(ids.shape[1]) < size[done, None]].astype(self.ids).tobytes()
                end = 0
                for r, n in zip(row[done].tolist(), (size[done] * self.ids.itemsize).tolist()):
                    out[r] = flat[end:end + n]
                    end += n
            row, ids, ranks, at, best, size = row[live], ids[live], ranks[live], at[live], best[live], size[live] - 1
            if not len(row):
                break
            every = np.arange(len(row))
            ids[every, at] = best
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            if ranks.shape[1] > 1:
                column = column[:ranks.shape[1] - 1]
                ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
                inner = at < ranks.shape[1]
                ranks[every[inner], at[inner]] = self.pairs.find(ids[every[inner], at[inner]], ids[every[inner], at[inner] + 1])
                inner = at > 0
                ranks[every[inner], at[inner] - 1] = self.pairs.find(ids[every[inner], at[inner] - 1], ids[every[inner], at[inner]])
            else:
                ranks = np.full((len(row), 1), NO_RANK)
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """The same merges, from a heap over a linked list."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        tokens, ranks = self.tokens, self.ranks

        def rank(i: int) -> int | None:
            return ranks.get(tokens[ids[i]] + tokens[ids[after[i]]]) if after[i] < n else None
        heap = [(int(r), i) for i, r in enumerate(self.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != best:
                continue
            gone = after[i]
            ids[i], ids[gone] = best, -1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (i, before[i]):
                if j >= 0 and (r := rank(j)) is not None:
                    heapq.heappush(heap, (r, j))
        return np.array([x for x in ids if x >= 0], self.ids)

    def learn(self, needed: set[str]) -> None:
        """Put the ids of new pieces among the known ones; what was not met for long is forgotten."""
        words = needed.difference(self.known)
        if len(self.known) + len(words) > REMEMBERED:
            self.older, self.known, words = self.known, {}, needed
        buckets: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        known, older, ranks = self.known, self.older, self.ranks
        for word in words:
            if word in older:
                known[word] = older[word]
                continue
            raw = word.encode()
            if raw in ranks:
                known[word] = np.array([ranks[raw]], self.ids).tobytes()
            elif len(raw) > LONGEST:
                known[word] = self._long(raw).tobytes()
            else:
                buckets[(len(raw) + 3) // 4].append((word, raw))
        for bucket in buckets.values():
            for low in range(0, len(bucket), ROWS):
                part = bucket[low:low + ROWS]
                known.update(zip((word for word, _ in part), self._matrix([raw for _, raw in part])))

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CHARS:
            yield self.pattern.findall(text)
        else:
            found = self.pattern.finditer(text)
            while part := [m.group() for m in islice(found, PIECES)]:
                yield part

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        out: list[bytes] = []
        few: list[list[str]] = []

        def finish():
            self.learn(set().union(*few))
            get = self.known.__getitem__
            try:
                out.extend(b"".join(map(get, words)) for words in few)
            finally:
                few.clear()
        held = 0
        for text in texts:
            if len(text) > CHARS:
                if few:
                    finish()
                parts = []
                for words in self.pieces(text):
                    few.append(words)
                    finish()
                    parts.append(out.pop())
                out.append(b"".join(parts))
                continue
            few.append(self.pattern.findall(text))
            held += len(text)
            if held >= CHARS:
                finish()
                held = 0
        if few:
            finish()
        return [np.frombuffer(x, self.ids) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path, pattern)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    values = np.concatenate([*arrays, np.zeros(0, np.uint16)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``, an array of token ids; a column of that name is replaced.

    Each match of the pattern is merged on its own. A null or empty text has no ids. Every worker reads
    the rank file at ``path``.
    """
    def ids(column: pa.Array) -> list[pa.Array]:
        return [_lists(vocabulary(path, pattern).encode([t or "" for t in column.to_pylist()]))]
    return with_arrow(df, [text], [T.StructField("ids", T.ArrayType(T.IntegerType()))], ids)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids; null ids give no bytes. A column of that name is replaced."""
    def raw(column: pa.Array) -> list[pa.Array]:
        own = vocabulary(path, pattern)
        values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()])
        return [pa.array([own.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())]
    return with_arrow(df, [ids], [T.StructField("decoded", T.BinaryType())], raw)


def tokenised(docs: DataFrame) -> DataFrame:
    """``doc_id, ids, decoded`` by the multilingual rank file of the installed public tokenizers."""
    import public_tokenizers
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return decode(encode(docs.select("doc_id", "text"), *file).select("doc_id", "ids"), *file)


def digests(tokens: DataFrame, *more: str) -> DataFrame:
    return tokens.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents and the bytes they decode to, as digests; a null text counts as empty."""
    return digests(tokenised(table(spark, sf_dir, "documents")))
