"""SentencePiece byte-pair encoding and decoding by a model file, all new words of a batch at a time.

A text is escaped as the model asks (one space in front, spaces as ``▁``) and cut into words that no
piece of the vocabulary can cross. Words that a task has not seen yet are laid end to end in flat
arrays: a symbol per code point, cut once more where no piece holds the two neighbours. In each round
every word finds its best pair (smallest rank, by a segmented minimum), merges all occurrences of it
that merging from left to right would take before a better pair can come up, and closes up. Words
without a pair leave the arrays. A code point that is no piece becomes the byte pieces of its UTF-8.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.llm.op2_bpe import NO_RANK, PairTable
from lakegraph.llm.shared import table, with_arrow

# Fixed values of the file format.
SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
BPE, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6

# Distinct words a worker remembers in each of two generations, characters it takes at a time, and
# words of one long text.
REMEMBERED, CHARS, WORDS = 1 << 17, 1 << 20, 1 << 16
_NEVER = np.iinfo(np.int64).max


def _one_bad_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("lakegraph-one-byte", _one_bad_byte)


class Model:
    """Pieces, scores and settings of a model file.

    Only what this operator encodes exactly is taken: byte-pair models with byte fallback, no rewriting of
    characters and no user-defined or unused pieces; another model raises ValueError.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        own = proto.ModelProto()
        with open(path, "rb") as file:
            own.ParseFromString(file.read())
        if own.trainer_spec.model_type != BPE or not own.trainer_spec.byte_fallback:
            raise ValueError("not a byte-pair model with byte fallback")
        if own.normalizer_spec.precompiled_charsmap or own.normalizer_spec.remove_extra_whitespaces \
                or not own.normalizer_spec.escape_whitespaces or own.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model rewrites characters or white space")
        if {p.type for p in own.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has user-defined or unused pieces")
        self.prefix = own.normalizer_spec.add_dummy_prefix
        self.begin, self.end = own.trainer_spec.bos_id, own.trainer_spec.eos_id
        self.size = len(own.pieces)
        self.ids = np.dtype("<u2") if self.size < 1 << 16 else np.dtype("<u4")
        pieces = {p.piece: i for i, p in enumerate(own.pieces) if p.type == NORMAL}
        self._read_pieces(own.pieces)

        order = {s: r for r, s in enumerate(sorted({own.pieces[i].score for i in pieces.values()}, reverse=True))}
        self.last = len(order) - 1
        self.rank = np.full(self.size + 1, _NEVER)
        for i in pieces.values():
            self.rank[i] = order[own.pieces[i].score]
        # A symbol is a piece, or a code point that is none, numbered after the pieces.
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        symbol_of = dict(pieces) | {c: int(self.symbol[ord(c)]) for p in pieces for c in p}
        self.pairs = PairTable({(symbol_of[p[:k]], symbol_of[p[k:]]): i for p, i in pieces.items()
                                for k in range(1, len(p)) if p[:k] in symbol_of and p[k:] in symbol_of})
        together = {(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:])}
        self.together = PairTable({pair: 0 for pair in together})
        # Where a piece has its spaces in front only, a space after another character starts a word.
        inner = "".join(sorted({chr(c) for pair in together for c in pair} - {SPACE}))
        inside = f"[{re.escape(inner)}]" if inner else "(?!)"
        if all(SPACE not in p.lstrip(SPACE) for p in pieces):
            self.word = re.compile(f"{SPACE}*{inside}+|{SPACE}+|[^{SPACE}{re.escape(inner)}]+")
        else:
            self.word = re.compile(f"[{SPACE}{re.escape(inner)}]+|[^{SPACE}{re.escape(inner)}]+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _read_pieces(self, pieces) -> None:
        """What each id decodes to, and the ids of the 256 bytes."""
        self.surface: list[bytes] = []
        self.byte = np.zeros(256, np.int64)
        self.is_byte = np.zeros(self.size, bool)
        self.is_control = np.zeros(self.size, bool)
        self.spaced = np.zeros(self.size, bool)
        for i, p in enumerate(pieces):
            self.is_control[i] = p.type == CONTROL
            self.is_byte[i] = p.type == BYTE
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte[value] = i
                self.surface.append(bytes([value]))
            elif p.type == CONTROL:
                self.surface.append(b"")
            elif p.type == UNKNOWN:
                self.surface.append(UNKNOWN_SURFACE.encode())
            else:
                self.spaced[i] = p.piece.startswith(SPACE)
                self.surface.append(p.piece.replace(SPACE, " ").encode())

    # ---- encoding

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes and its rank; no piece: rank _NEVER."""
        made = self.pairs.find(left, right)
        return made, self.rank[np.minimum(made, self.size)]

    def merge(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words laid end to end and the place of each symbol's first code point.

        ``codes`` are code points, ``starts`` the first place of each word.
        """
        n = len(codes)
        first = np.zeros(n, bool)
        first[starts] = True
        first[1:] |= self.together.find(codes[:-1], codes[1:]) == NO_RANK
        place, symbol, word = np.arange(n), self.symbol[codes], np.cumsum(first) - 1
        made, rank = np.zeros(n, np.int64), np.full(n, _NEVER)
        same = np.flatnonzero(~first[1:])
        made[same], rank[same] = self._look_up(symbol[same], symbol[same + 1])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(head, len(word)))
            best = np.minimum.reduceat(rank, head)
            for w in np.flatnonzero(best == self.last):
                self._finish(symbol, place, head[w], size[w], out)
            live = np.repeat(best < self.last, size)
            quiet = np.repeat(best == _NEVER, size)
            out.append((place[quiet], symbol[quiet]))
            place, symbol, word, made, rank = (x[live] for x in (place, symbol, word, made, rank))
            if not len(symbol):
                break
            alive = best < self.last
            best, size = best[alive], size[alive]
            at = self._chosen(symbol, word, made, rank, best, size)
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            # A merged symbol ends where the dropped one did, so it is followed by what followed that.
            moved = np.cumsum(keep) - 1
            place, symbol, word, made, rank = (x[keep] for x in (place, symbol, word, made, rank))
            at = moved[at]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            inner = (changed + 1 < len(word)) & (word[np.minimum(changed + 1, len(word) - 1)] == word[changed])
            rank[changed[~inner]] = _NEVER
            changed = changed[inner]
            made[changed], rank[changed] = self._look_up(symbol[changed], symbol[changed + 1])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, symbols = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(places)
        return places[order], symbols[order]

    def _chosen(self, symbol, word, made, rank, best, size) -> np.ndarray:
        """Places whose pair merges in this round.

        In each word those are the pairs of its smallest rank, from the left and without overlap, up to
        and with the first whose merge brings up a pair that comes before the rest of them.
        """
        n = len(symbol)
        limit = np.repeat(best, size)
        at = np.flatnonzero(rank == limit)
        run = np.append(True, at[1:] != at[:-1] + 1)
        at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
        new = made[at]
        before = symbol[np.maximum(at - 1, 0)]
        joined = np.append(False, at[1:] == at[:-1] + 2)
        before[joined] = new[:-1][joined[1:]]
        left = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
        after = np.minimum(at + 2, n - 1)
        right = (at + 2 < n) & (word[after] == word[at])
        early = np.zeros(len(at), bool)
        early[left] = self._look_up(before[left], new[left])[1] <= limit[at[left]]
        early[right] |= self._look_up(new[right], symbol[after[right]])[1] <= limit[at[right]]
        if early.any():
            stop = np.full(n, n)
            stop[at[early]] = at[early]
            head = np.append(0, np.cumsum(size)[:-1])
            at = at[at <= np.repeat(np.minimum.reduceat(stop, head), size)[at]]
        return at

    def _finish(self, symbol, place, head, size, out) -> None:
        """A word whose pairs are all of the worst rank: leftmost first is one pass with a stack."""
        stack: list[list[int]] = []
        for p, s in zip(place[head:head + size].tolist(), symbol[head:head + size].tolist()):
            stack.append([p, s])
            while len(stack) > 1 and (made := self._pair(stack[-2][1], stack[-1][1])) is not None:
                stack.pop()
                stack[-1][1] = made
        found = np.array(stack, np.int64)
        out.append((found[:, 0], found[:, 1]))

    @lru_cache(maxsize=1 << 12)  # noqa: B019 - a model lives as long as its worker
    def _pair(self, left: int, right: int) -> int | None:
        made = int(self.pairs.find(np.array([left]), np.array([right]))[0])
        return None if made == NO_RANK else made

    def words_to_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        place, symbol = self.merge(codes, np.append(0, ends[:-1]))
        # Code points that are no piece: their bytes.
        strange = symbol >= self.size
        raw = [chr(c).encode() for c in (symbol[strange] - self.size).tolist()]
        width = np.ones(len(symbol), np.int64)
        width[strange] = [len(r) for r in raw]
        ids = np.repeat(symbol, width)
        ids[np.repeat(strange, width)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        cut = np.append(0, np.cumsum(width))[np.searchsorted(place, ends)] * self.ids.itemsize
        flat = ids.astype(self.ids).tobytes()
        return [flat[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]

    def learn(self, needed: set[str]) -> None:
        """Put the ids of new words among the known ones; what was not met for long is forgotten."""
        words = needed.difference(self.known)
        if len(self.known) + len(words) > REMEMBERED:
            self.older, self.known, words = self.known, {}, needed
        for word in words & self.older.keys():
            self.known[word] = self.older[word]
        new = list(words - self.known.keys())
        if new:
            self.known.update(zip(new, self.words_to_ids(new)))

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> list[np.ndarray]:
        """Ids of each text, with begin and end ids if asked."""
        front = np.array([self.begin] * begin, self.ids).tobytes()
        back = np.array([self.end] * end, self.ids).tobytes()
        out: list[bytes] = []
        few: list[list[str]] = []
        held = 0

        def finish() -> None:
            nonlocal held
            self.learn(set().union(*few))
            get = self.known.__getitem__
            out.extend(b"".join(map(get, words)) for words in few)
            few.clear()
            held = 0
        for text in texts:
            text = (" " * self.prefix + text if text else "").replace(" ", SPACE)
            if len(text) > CHARS:
                finish()
                parts = []
                found = self.word.finditer(text)
                while words := [m.group() for m in islice(found, WORDS)]:
                    few.append(words)
                    finish()
                    parts.append(out.pop())
                out.append(b"".join(parts))
                continue
            few.append(self.word.findall(text))
            held += len(text)
            if held >= CHARS:
                finish()
        finish()
        return [np.frombuffer(front + x + back, self.ids) for x in out]

    # ---- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces as UTF-8 (a bad byte is U+FFFD), control ids nothing, no space in front.

        Bytes on both sides of a control id do not make a character together.
        """
        control = self.is_control[ids] if len(ids) else np.zeros(0, bool)
        real = ids[~control]
        if not len(real):
            return ""
        breaks = np.cumsum(control)[~control]
        parts = np.split(real, np.flatnonzero(np.diff(breaks)) + 1)
        raw = [b"".join(map(self.surface.__getitem__, p.tolist())) for p in parts]
        if self.prefix and self.spaced[real[0]]:
            raw[0] = raw[0][1:]
        return "".join(r.decode("utf-8", "lakegraph-one-byte") for r in raw)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model per worker process."""
    return Model(path)


def encode(df: DataFrame, path: str, text: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """``df`` with ``ids``, an array of piece ids; a column of that name is replaced.

    The ids are those of the sentencepiece library without sampling. A null or empty text has only the begin
    and end ids, if those are asked for. Every worker reads the model file at ``path``. Memory follows the
    longest text; an empty table gives an empty table.
    """
    def ids(column: pa.Array) -> list[pa.Array]:
        return [_lists(model(path).encode([t or "" for t in column.to_pylist()], begin, end))]
    return with_arrow(df, [text], [T.StructField("ids", T.ArrayType(T.IntegerType()))], ids)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    values = np.concatenate([*arrays, np.zeros(0, np.uint16)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _rows(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()])
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def decode(df: DataFrame, path: str, ids: str = "ids", digest: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of the ids as the library's ``decode(ids)``; null ids give an empty text.

    ``digest`` names one more column: lowercase hex SHA-256 of the ids as little-endian unsigned 32-bit
    integers. Columns of those names are replaced. An id that the model does not have fails the task.
    """
    outputs = [T.StructField(name, T.StringType()) for name in ("decoded", digest) if name]

    def texts(column: pa.Array) -> list[pa.Array]:
        rows = _rows(column)
        made = [pa.array([model(path).decode(r) for r in rows], pa.string())]
        if digest:
            made.append(pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()))
        return made
    return with_arrow(df, [ids], outputs, texts)


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents by the installed model, with begin and end ids, then decoded.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``; a null text counts as empty.
    """
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return decode(ids, path, digest="ids_sha256").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
