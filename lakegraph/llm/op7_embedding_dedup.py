"""Near-duplicate embeddings: randomised-rotation binary codes decide which pairs are computed exactly.

Equal vectors of a label are one class first. Each class keeps the signs of its rotated unit vector and
a correction factor, the inner product f of the vector with its own code. The inner product of that
code with another rotated unit vector, divided by f, is an unbiased estimate of their cosine over the
random rotation. If the cosine is at least t, the estimate is at least t - sqrt(1 - f^2) / f * sqrt(1 - t^2),
a bound that holds always, not only with high probability; pairs at or above it are recomputed in
double precision from the original components, all others are left out, and no link is lost.

A label's classes are dealt into tiles of bounded size, and every two tiles meet in one task, which
returns counts and a spanning forest, never the pairs. The work is quadratic in the size of a label, in
blocks; the rows moved are its size times its number of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.components import components
from lakegraph.llm.shared import arrow_rows, by_group, forest, stored, table

THRESHOLD = 0.98
TILE = 1024
PAIRS = 1 << 15
# Room for rounding in the single-precision estimate.
SLACK = 1e-3
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, factors, raw = [], [], []
        for v in batch.column("embedding"):
            x = np.array(v.as_py(), np.float64)
            turned = unit(x[None])[0] @ rotation(len(x))
            codes.append(np.packbits(turned > 0).tobytes())
            factors.append(float(np.abs(turned).sum() / np.sqrt(len(x))))
            raw.append(x.tobytes())
        keep = [c for n, c in zip(batch.schema.names, batch.columns) if n != "embedding"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(raw, pa.binary()), pa.array(codes, pa.binary()), pa.array(factors, pa.float64())],
                                         ["node", "copies", "tile", "tiles", "grp", "vector", "code", "factor"])


def _compare(threshold: float):
    def one(group: list[tuple]) -> list[tuple]:
        nodes, copies, second, raw, codes, factor = zip(*group)
        x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
        dim = x.shape[1]
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        length = np.sqrt((scaled * scaled).sum(axis=1))
        turned = ((scaled / length[:, None]) @ rotation(dim)).astype(np.float32)
        signs = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, count=dim)
        signs = (signs.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
        f = np.minimum(np.array(factor), 1.0)
        least = f * threshold - np.sqrt(1 - f * f) * np.sqrt(max(0.0, 1 - threshold * threshold)) - SLACK
        side, copies = np.array(second), np.array(copies)
        left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() and not side.all() else (np.arange(len(x)),) * 2
        count = np.zeros(len(x), np.int64)
        a, b = [], []
        for low in range(0, len(left), 128):
            rows = left[low:low + 128]
            i, j = np.nonzero(signs[rows] @ turned[right].T >= least[rows, None])
            i, j = rows[i], right[j]
            if left is right:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), PAIRS):
                p, q = i[at:at + PAIRS], j[at:at + PAIRS]
                linked = (scaled[p] * scaled[q]).sum(axis=1) / (length[p] * length[q]) >= threshold
                p, q = p[linked], q[linked]
                np.add.at(count, p, copies[q])
                np.add.at(count, q, copies[p])
                fresh = forest(p.tolist(), q.tolist())
                a += [x for x, _ in fresh]
                b += [y for _, y in fresh]
        return [(nodes[i], nodes[j], 0) for i, j in forest(a, b)] + [(nodes[i], None, int(count[i])) for i in np.flatnonzero(count)]
    return by_group(one, _LINKS)


def usable(vector: Column) -> Column:
    """True for a vector of finite components that are not all zero."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal, their vectors have the same length and cosine >= threshold.
    Rows with a null label or vec_id, or a vector that is null, empty, zero or has a null or non-finite
    component, link with nothing: they are their own component and kept. Equal vectors link, repeated
    rows too. Other columns are ignored. An empty table gives an empty table.
    """
    arrow_rows(vectors.sparkSession, 2048)
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
    classes = stored(rows.filter(ok).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vectors")
    # One node per class: rows that share a vec_id but not a vector stay apart.
    grouped = classes.withColumn("dim", F.size("embedding"))
    sizes = stored(grouped.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "label-sizes")
    dealt = grouped.join(sizes, ["label", "dim"]).select(
        "node", "copies", F.pmod(F.xxhash64("embedding"), "tiles").cast("int").alias("tile"), "tiles",
        F.xxhash64("label", "dim").alias("grp"), "embedding")
    codes = stored(dealt.mapInArrow(_codes, "node long, copies long, tile int, tiles int, grp long, vector binary, code binary, factor double"), "codes")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    met = codes.select("*", other).select(
        F.xxhash64("grp", F.least("tile", "other"), F.greatest("tile", "other")).alias("pair"),
        "node", "copies", (F.col("tile") > F.col("other")).alias("second"), "vector", "code", "factor")
    found = stored(met.repartition("pair").sortWithinPartitions("pair").mapInArrow(_compare(threshold), "a long, b long, n long"), "vector-links")
    groups = components(found.filter("b is not null"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    known = classes.join(counts, "node", "left").join(groups, "node", "left").filter("copies > 1 or others > 0")
    known = stored(known.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
                                (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"),
                                F.coalesce("component", "node").alias("component")), "known-vectors")
    out = rows.withColumn("ok", ok).join(known, F.col("ok") & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of embeddings; a vector that cannot be compared is its own component."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, x -> x <> 0)) > 0),
u AS (SELECT vec_id, label, r, e, sqrt(list_dot_product(e, e)) AS s FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= {THRESHOLD}),
reach AS (
  WITH RECURSIVE w(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM w JOIN links l ON w.b = l.a)
  SELECT a, min(b) AS b FROM w GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(coalesce(b, e.vec_id), e.vec_id) AS component_id,
       coalesce(e.vec_id <= b, true) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON e.vec_id = c.a LEFT JOIN reach ON e.vec_id = reach.a
"""
