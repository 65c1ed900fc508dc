"""A metric cell index over entity vectors: how many of them are nearer to a point than a given distance.

Every vector belongs to the cell of its nearest pivot, and a cell knows its size and radius. A projection
never makes distances longer, so one index serves all hyperplanes: if the projected pivot is at distance
c from a point, all projected vectors of a cell of radius R are between c - R and c + R. Cells wholly
nearer or farther are counted as they stand; only cells on the border are opened and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import stored

# Pivots go to every task: their bytes are bounded, and cells grow beyond that instead of their number.
PIVOT_BYTES = 32 << 20
# Bounds are widened by this much, far above rounding and above the resolution of compared distances.
SLACK = 1e-6
_MATRIX = 1 << 22
# Groups grow with the table, so that vectors and points have no more than these copies, up to this size.
MOST_TILES, MOST_CHUNKS, GROUP_BYTES = 32, 16, 64 << 20
_OPEN = T.ArrayType(T.StructType([T.StructField("tile", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))]))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _group_size(least: int, rows: int, most_groups: int, row_bytes: int) -> int:
    """Rows of a group: ``least``, or as many as leave ``most_groups`` of them, within ``GROUP_BYTES``."""
    return max(least, min(-(-rows // most_groups), GROUP_BYTES // row_bytes))


def _by_tile(rows: np.ndarray, cells: np.ndarray, first: np.ndarray, tiles: np.ndarray, n: int) -> pa.ListArray:
    """The cells that rows look into, as a list of (tile, cells) for each of ``n`` rows."""
    times = tiles[cells]
    starts = np.cumsum(times) - times
    tile = np.repeat(first[cells], times) + np.arange(times.sum()) - np.repeat(starts, times)
    rows, cells = np.repeat(rows, times), np.repeat(cells, times)
    order = np.lexsort((tile, rows))
    rows, cells, tile = rows[order], cells[order], tile[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (tile[1:] != tile[:-1])]) if len(rows) else np.zeros(0, np.int64)
    inner = pa.ListArray.from_arrays(pa.array(np.r_[new, len(cells)], pa.int32()), pa.array(cells, pa.int64()))
    pairs = pa.StructArray.from_arrays([pa.array(tile[new], pa.int64()), inner], ["tile", "cells"])
    ends = np.r_[0, np.cumsum(np.bincount(rows[new], minlength=n))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def _nearer(point, shift, normal, dist, vectors, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point, how many vectors are nearer than ``dist`` and how many as far, in whole ``1 / scale``.

    Squared distances of all pairs come from two matrix products. Their rounding is far below ``err``, so
    only pairs closer to the border than that and a unit of the scale are measured one by one.
    """
    base = point - (point * normal).sum(1, keepdims=True) * normal + shift
    along = normal @ vectors.T
    square = base @ vectors.T
    square *= -2
    square += ((base * normal).sum(1, keepdims=True) * 2 + ((normal ** 2).sum(1, keepdims=True) - 2) * along) * along
    long, size = np.sqrt((base ** 2).sum(1)), (vectors ** 2).sum(1)
    square += (long ** 2)[:, None] + size
    width = 1 + np.abs((normal ** 2).sum(1))
    err = 1e-11 * (np.sqrt((point ** 2).sum(1)) * width + np.sqrt((shift ** 2).sum(1)) + np.sqrt(size.max()) * width) ** 2
    below, above = np.maximum(dist - 1, 0) / scale, (dist + 1) / scale
    nearer = square < (below ** 2 - err)[:, None]
    ahead, equal = nearer.sum(1), np.zeros(len(dist), np.int64)
    near, at = np.nonzero(~(nearer | (square > (above ** 2 + err)[:, None])))
    step = max(1, _MATRIX // (8 * vectors.shape[1]))
    for low in range(0, len(near), step):
        i, j = near[low:low + step], at[low:low + step]
        diff = point[i] - vectors[j]
        off = np.sqrt(((diff - (diff * normal[i]).sum(1, keepdims=True) * normal[i] + shift[i]) ** 2).sum(1))
        found = np.rint(off * scale).astype(np.int64)
        ahead += np.bincount(i[found < dist[i]], minlength=len(dist))
        equal += np.bincount(i[found == dist[i]], minlength=len(dist))
    return ahead, equal


class CellIndex:
    """``members`` (cell, tile, id, vec), a written table; pivots, sizes, radii and tiles by cell."""

    def __init__(self, entities: DataFrame, block: int = 4096, cells: int | None = None):
        """``entities`` (id, vec): ids are unique, vectors of one length. ``cells`` is the square root of their number by default."""
        n = entities.count()
        first = entities.select(F.size("vec")).first()
        dim = first[0] if first else 1
        most = max(1, PIVOT_BYTES // (8 * dim))
        wanted = min(max(1, math.isqrt(n) if cells is None else cells), most)
        found = entities.select("vec").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # PIVOT_BYTES at most
        self.n, self.block = n, block
        self.pivots = np.array([r["vec"] for r in found], float).reshape(len(found), dim)
        share = entities.sparkSession.sparkContext.broadcast(self.pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = share.value
            squares = (pivots ** 2).sum(1)
            for b in batches:
                vec = matrix(b["vec"])
                cell, away = np.zeros(len(vec), np.int64), np.zeros(len(vec))
                step = max(1, _MATRIX // max(1, len(pivots)))
                for at in range(0, len(vec), step):
                    part = vec[at:at + step]
                    own = (squares - 2 * part @ pivots.T).argmin(axis=1)
                    cell[at:at + step] = own
                    away[at:at + step] = np.sqrt(((part - pivots[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(away), b["id"], b["vec"]], ["cell", "away", "id", "vec"])

        dealt = stored(entities.select("id", "vec").mapInArrow(assign, "cell bigint, away double, id bigint, vec array<double>"), "cells")
        rows = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # one per pivot at most
        self.sizes, self.radii = np.zeros(len(found), np.int64), np.zeros(len(found))
        for r in rows:
            self.sizes[r["cell"]], self.radii[r["cell"]] = r["n"], r["radius"]
        # Cells side by side make a tile of about ``block`` vectors, a cell that many share is dealt over tiles of its own.
        self.dim, self.tile = dim, _group_size(block, n, MOST_TILES, 8 * dim)
        self.tiles = np.maximum(1, -(-self.sizes // self.tile))
        self.first, at, held = np.zeros(len(found), np.int64), 0, 0
        for cell, size in enumerate(self.sizes.tolist()):
            if held and held + size > self.tile:
                at, held = at + 1, 0
            self.first[cell] = at
            held += size
            if held >= self.tile:
                at, held = at + int(self.tiles[cell]), 0
        table = entities.sparkSession.createDataFrame(list(zip(range(len(found)), self.first.tolist(), self.tiles.tolist())),
                                                      "cell bigint, first bigint, tiles bigint")
        tile = F.col("first") + F.pmod(F.xxhash64("id"), F.col("tiles"))
        self.members = dealt.join(F.broadcast(table), "cell").select("cell", tile.alias("tile"), "id", "vec")

    def _border(self, points: DataFrame, scale: float) -> DataFrame:
        """``points`` with ``sure``, the vectors of cells that are nearer as a whole, and ``open``, the cells to look into by tile."""
        share = points.sparkSession.sparkContext.broadcast((self.pivots, self.sizes, self.radii, self.first, self.tiles))

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, sizes, radii, first, tiles = share.value
            squares = (pivots ** 2).sum(1)
            for b in batches:
                w, dist = matrix(b["normal"]), b["dist"].to_numpy() / scale
                q = matrix(b["point"])
                q = q - (q * w).sum(1, keepdims=True) * w + matrix(b["shift"])
                sure, asked, cells = np.zeros(len(dist), np.int64), [], []
                step = max(1, _MATRIX // max(1, len(pivots)))
                for at in range(0, len(dist) if len(pivots) else 0, step):
                    some, normal = q[at:at + step], w[at:at + step]
                    along = normal @ pivots.T
                    square = (some ** 2).sum(1)[:, None] - 2 * (some @ pivots.T - along * (some * normal).sum(1)[:, None])
                    # The normal has length one, up to rounding.
                    length = (normal ** 2).sum(1)[:, None]
                    square = square + squares - (2 - length) * along ** 2
                    away = np.sqrt(np.maximum(square, 0))
                    limit = dist[at:at + step, None]
                    nearer = away + radii + SLACK < limit
                    on_border = ~nearer & (away - radii - SLACK <= limit) & (sizes > 0)
                    sure[at:at + step] = nearer @ sizes
                    rows, found = np.nonzero(on_border)
                    asked.append(rows + at)
                    cells.append(found)
                opened = _by_tile(np.concatenate([*asked, np.zeros(0, np.int64)]), np.concatenate([*cells, np.zeros(0, np.int64)]), first, tiles, len(dist))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sure), opened], [*b.schema.names, "sure", "open"])

        schema = T.StructType([*points.schema.fields, T.StructField("sure", T.LongType()), T.StructField("open", _OPEN)])
        return points.mapInArrow(bound, schema)

    def count_nearer(self, points: DataFrame, key: str, scale: float, chunk: int = 1024) -> DataFrame:
        """(key, ahead, equal, compared) for ``points`` (key, point, shift, normal, dist).

        The distance of a vector is the length of its difference from ``point``, projected along the unit ``normal``
        and moved by ``shift``. Distances are compared as whole numbers of ``1 / scale``, which ``dist`` is given in.
        ``compared`` vectors were in cells that had to be opened. Groups hold about ``block`` vectors and ``chunk``
        points, more of a large table: then a vector is copied to ``MOST_CHUNKS`` groups and a point to ``MOST_TILES``
        at most, until a group's ``GROUP_BYTES`` are full.
        """
        points = stored(self._border(points.select(key, "point", "shift", "normal", "dist"), scale), "border")
        chunk = _group_size(chunk, points.count(), MOST_CHUNKS, 24 * self.dim)
        asked = points.select(key, "point", "shift", "normal", "dist", F.inline("open"))
        # Pieces of the points that look into a tile; one row per tile at most.
        pieces = asked.groupBy("tile").count().select("tile", F.ceil(F.col("count") / chunk).cast("bigint").alias("chunks"))
        pieces = F.broadcast(stored(pieces, "pieces"))
        left = asked.join(pieces, "tile").withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")))
        right = self.members.join(pieces, "tile").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))

        def compare(q: pa.Table, e: pa.Table) -> pa.Table:
            ahead, equal, compared = (np.zeros(q.num_rows, np.int64) for _ in range(3))
            if q.num_rows and e.num_rows:
                own, vectors = e["cell"].to_numpy(), matrix(e["vec"])
                point, shift, normal = (matrix(q[c]) for c in ("point", "shift", "normal"))
                dist, lists = q["dist"].to_numpy(), q["cells"].combine_chunks()
                cells = lists.flatten().to_numpy()
                rows = np.repeat(np.arange(q.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                order = np.argsort(cells, kind="stable")
                cells, rows = cells[order], rows[order]
                for cell in np.unique(own):
                    inside = vectors[own == cell]
                    low, high = np.searchsorted(cells, (cell, cell + 1))
                    step = max(1, _MATRIX // len(inside))
                    for at in range(low, high, step):
                        some = rows[at:min(high, at + step)]
                        less, same = _nearer(point[some], shift[some], normal[some], dist[some], inside, scale)
                        ahead[some] += less
                        equal[some] += same
                        compared[some] += len(inside)
            return pa.table([q[key], pa.array(ahead), pa.array(equal), pa.array(compared)], names=[key, "ahead", "equal", "compared"])

        kind = points.schema[key].dataType.simpleString()
        left = left.select("tile", "chunk", key, "point", "shift", "normal", "dist", "cells")
        right = right.select("tile", "chunk", "cell", "vec")
        parts = left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInArrow(
            compare, f"`{key}` {kind}, ahead bigint, equal bigint, compared bigint")
        whole = points.select(key, F.col("sure").alias("ahead"), F.lit(0).cast("bigint").alias("equal"), F.lit(0).cast("bigint").alias("compared"))
        return parts.unionByName(whole).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("ahead", "equal", "compared")])
