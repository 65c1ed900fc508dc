"""Fill-in-middle: a text is cut at two places and its parts are put in the order a model learns to fill.

The bytes of a text are dealt into fixed blocks. A Fenwick tree per text holds, for each block, how many
units and how many code points begin there. A cut after k units is found by binary-lifting descent to
its block, for all texts of a batch together, and then by looking into that block alone. Code-point
counts come from the same descent. Rebuilding needs only the written text and its form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.llm.shared import SPACES, table, text_buffers, with_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 512
SEED, FIM_PERCENT, SPM_PERCENT = 1, 90, 20
UNITS = ("chars", "words", "lines")


def _begins(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether a unit begins at each byte, and whether a code point does."""
    point = (data & 0xC0) != 0x80
    if unit == "chars":
        return point, point
    ends = np.isin(data, np.frombuffer(SPACES, np.uint8)) if unit == "words" else data == 10
    begins = np.append(False, ends[:-1]) if len(data) else ends
    if unit == "words":
        begins &= ~ends
    # What stands before the first word is part of the first unit.
    first = offsets[:-1][np.diff(offsets) > 0]
    if unit == "words" and len(data):
        seen = np.append(0, np.cumsum(~ends))
        leading = seen[offsets[:-1]]
        blank_start = first[ends[first]]
        row = np.searchsorted(offsets, blank_start, "right") - 1
        start_of_word = np.searchsorted(seen, leading[row] + 1) - 1
        inside = start_of_word < offsets[row + 1]
        begins[start_of_word[inside]] = False
    begins[first] = True
    return begins, point


class Trees:
    """Fenwick trees over the blocks of each text of a batch, laid end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, block: int = BLOCK):
        self.unit, self.point = _begins(data, offsets, unit)
        self.offsets, self.block = offsets, block
        size = np.diff(offsets)
        self.blocks = -(-size // block)
        self.base = np.append(0, np.cumsum(self.blocks))
        number = np.arange(self.base[-1])
        row = np.repeat(np.arange(len(size)), self.blocks)
        self.start = offsets[:-1][row] + (number - self.base[row]) * block
        self.tree = [self._build(x, number, row) for x in (self.unit, self.point)]
        self.units, self.points = (self._total(x) for x in (self.unit, self.point))

    def _counts(self, begins: np.ndarray) -> np.ndarray:
        return np.add.reduceat(begins, self.start, dtype=np.int64) if len(self.start) else np.zeros(0, np.int64)

    def _build(self, begins: np.ndarray, number: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Node i of a tree (from 1) holds the sum of the last ``i & -i`` blocks up to i."""
        sums = np.append(0, np.cumsum(self._counts(begins)))
        i = number - self.base[row] + 1
        return sums[number + 1] - sums[number + 1 - (i & -i)]

    def _total(self, begins: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(self._counts(begins)))
        return sums[self.base[1:]] - sums[self.base[:-1]]

    def cut(self, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code points before the cut that follows ``after[i]`` units of text i."""
        rows = np.arange(len(after))
        at = np.zeros(len(after), np.int64)
        left, points = after.astype(np.int64).copy(), np.zeros(len(after), np.int64)
        step = 1 << int(self.blocks.max(initial=0)).bit_length()
        while step := step >> 1:
            nxt = at + step
            node = np.where(nxt <= self.blocks, self.base[rows] + nxt - 1, 0)
            # Blocks that leave at least one unit before the cut to a later one are passed.
            go = (nxt <= self.blocks) & (self.tree[0][node] <= left) if len(self.start) else np.zeros(len(after), bool)
            left[go] -= self.tree[0][node[go]]
            points[go] += self.tree[1][node[go]]
            at[go] = nxt[go]
        byte = self.offsets[1:].copy()
        for i in np.flatnonzero(at < self.blocks).tolist():
            low = int(self.start[self.base[i] + at[i]])
            part = slice(low, min(low + self.block, int(self.offsets[i + 1])))
            inner = int(np.flatnonzero(self.unit[part])[left[i]])
            byte[i] = low + inner
            points[i] += int(np.count_nonzero(self.point[part][:inner]))
        return byte, points


def _hash_group(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "chars", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, block: int = BLOCK) -> DataFrame:
    """``df`` with ``fim``, the transformed text, and ``form, n_units, prefix_chars, middle_chars``.

    Both cuts and the form come from SHA-256 of ``seed:key``, so a row gives the same result in every
    run. ``unit``: ``chars`` (code points), ``words`` (a word with the white space after it; white space in
    front belongs to the first) or ``lines`` (a line with its end). ``form``: ``plain`` (the text itself:
    it is empty, holds one of the three marks, or is not chosen), ``psm`` or ``spm``. A null text counts as
    empty, a null key as an empty one, equal keys are cut by the same numbers. Columns of those names are
    replaced; an empty table gives an empty table. Memory follows the longest text.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    chosen = F.array(*[_hash_group(digest, i) for i in range(4)])
    outputs = [T.StructField("fim", T.StringType()), T.StructField("form", T.StringType()),
               *[T.StructField(c, T.LongType()) for c in ("n_units", "prefix_chars", "middle_chars")]]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(hashes: pa.Array, column: pa.Array) -> list[pa.Array]:
        data, offsets = text_buffers(column)
        h = hashes.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        trees = Trees(data, offsets, unit, block)
        one, two = (h[:, i] % (trees.units + 1) for i in (0, 1))
        (a, a_points), (b, b_points) = (trees.cut(c) for c in (np.minimum(one, two), np.maximum(one, two)))
        whole = data.tobytes()
        made, forms = [], []
        for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            own = whole[low:high]
            if not own or h[i, 2] % 100 >= fim_percent or any(m in own for m in marks):
                made.append(own)
                forms.append("plain")
                continue
            x, y = int(a[i]) - low, int(b[i]) - low
            spm = h[i, 3] % 100 < spm_percent
            prefix, middle, suffix = own[:x], own[x:y], own[y:]
            made.append(b"".join([marks[1], suffix, marks[0], prefix, marks[2], middle] if spm
                                 else [marks[0], prefix, marks[1], suffix, marks[2], middle]))
            forms.append("spm" if spm else "psm")
        plain = np.array([f == "plain" for f in forms], bool)
        return [pa.array(made, pa.binary()).cast(pa.string()), pa.array(forms, pa.string()), pa.array(trees.units, pa.int64()),
                pa.array(a_points, pa.int64(), mask=plain), pa.array(b_points - a_points, pa.int64(), mask=plain)]

    hashed = df.withColumn("_hashes", chosen)
    return with_arrow(hashed, ["_hashes", text], outputs, run).drop("_hashes")


def restored(fim: str = "fim", form: str = "form") -> Column:
    """The text that was transformed, from the written text and its form alone, in built-in functions.

    Exact, because a text with a mark in it stays plain, and no mark can begin inside another one.
    """
    out = F.col(fim)
    first, second = (F.when(F.col(form) == "spm", x).otherwise(y) for x, y in ((SUFFIX, PREFIX), (PREFIX, SUFFIX)))
    body = F.substr(out, F.char_length(first) + 1)
    one = F.split_part(body, second, F.lit(1))
    rest = F.substr(body, F.char_length(one) + F.char_length(second) + 1)
    two = F.split_part(rest, F.lit(MIDDLE), F.lit(1))
    middle = F.substr(rest, F.char_length(two) + len(MIDDLE) + 1)
    return F.when(F.col(form) == "spm", F.concat(two, middle, one)).when(F.col(form) == "psm", F.concat(one, middle, two)).otherwise(out)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, cut after code points, with digests of what is written and of what it gives back.

    ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``; a null text counts as empty.
    """
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                       F.sha2("fim", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
g AS (SELECT doc_id, text, length(text) AS n,
             [('0x' || substr(d, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM h),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                       OR h[3] % 100 >= {FIM_PERCENT} THEN 'plain'
                  WHEN h[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid
                        ELSE '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
