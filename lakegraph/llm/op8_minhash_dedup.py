"""Near-duplicate documents: many universal hash minima, banding, verification, components.

1. One pass over the texts gives each document its shingle count, a 128-bit digest of its shingle set
   and 200 minima. Documents with the same set are one class from here on.
2. 40 bands of 5 minima: two sets of similarity 0.75 share no band with probability 2e-5.
3. Classes in a bucket are laid out in tiles of bounded size, by the largest bucket each is in. Only
   tiles that share a bucket meet. A task that compares two tiles first estimates similarity from the
   minima, then counts common shingles of the full sets, and returns a spanning forest of the links it
   found, not the pairs. So a group of near copies costs rows in proportion to its size times its
   tiles, and no bucket is capped.
4. Components by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.components import components
from lakegraph.llm.shared import SHINGLE_WORDS, arrow_rows, by_group, forest, mix, shingle_sets, stored

BANDS, BAND_ROWS = 40, 5
MINIMA = BANDS * BAND_ROWS
TILE_ROWS, TILE_SHINGLES = 128, 1 << 16
# A similarity estimated from 200 minima is off by more than 0.15 once in about a million.
MARGIN = 0.15
# Nodes whose texts are fetched by a broadcast of their ids; more are fetched by a shuffle join.
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(8)
_FACTOR = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each non-empty set: the smallest a*x + b over its shingles, high 32 bits."""
    x = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, h = np.empty((len(sets), MINIMA), np.uint32), np.empty_like(x)
    for p in range(MINIMA):
        np.multiply(x, _FACTOR[p], out=h)
        h += _SHIFT[p]
        out[:, p] = np.minimum.reduceat(h, starts) >> np.uint64(32)
    return out


def _batched(column: pa.Array, k: int, size: int = 1 << 15) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows with their sets, about ``size`` shingles at a time."""
    rows, sets, total = [], [], 0
    for row, one in shingle_sets(column, k):
        rows.append(row)
        sets.append(one)
        total += len(one)
        if total >= size:
            yield rows, sets
            rows, sets, total = [], [], 0
    if rows:
        yield rows, sets


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)] for s in sets],
                    np.uint64).view(np.int64)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _batched(batch.column(1), k):
                marks = np.zeros((len(sets), MINIMA), np.uint32)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    marks[full] = minima([sets[i] for i in full])
                digest = _digests(sets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, marks.size + 1, MINIMA, dtype=np.int32)),
                                             pa.array(marks.reshape(-1).view(np.int32)))],
                    ["doc_id", "n_shingles", "d1", "d2", "marks"])
    return run


def sketches(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, marks`` of every row of ``docs(doc_id, text)``."""
    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _sketches(k), "doc_id long, n_shingles long, d1 long, d2 long, marks array<int>")


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for rows, sets in _batched(batch.column(1), k):
                digest = _digests(sets)
                own = [i for i, r in enumerate(rows) if len(sets[i]) and digest[i, 0] == d1[r] and digest[i, 1] == d2[r]]
                if own:
                    sets = [sets[i] for i in own]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array([rows[i] for i in own])),
                        pa.array([m.tobytes() for m in minima(sets)], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "marks", "shingles"])
    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 columns in blocks."""
    n = len(sets)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(where, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    keep = often[where]
    where, owner = place[where[keep]], owner[keep]
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    out = np.zeros((n, n), np.float64)
    for low in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(where, (low, low + 4096))
        block = np.zeros((n, 4096), np.float32)
        block[owner[a:b], where[a:b] - low] = 1
        out += block @ block.T
    return out


def links_of(nodes: list[int], side: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """A spanning forest of the links between rows of different sides, or of all rows if there is one side."""
    n = len(nodes)
    size = np.array([len(s) for s in sets])
    i, j = np.triu_indices(n, 1)
    if side.any() and not side.all():
        cross = side[i] != side[j]
        i, j = i[cross], j[cross]
    near = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    i, j = i[near], j[near]
    for low in range(0, len(i), 4096):
        part = slice(low, low + 4096)
        same = (marks[i[part]] == marks[j[part]]).mean(axis=1) >= percent / 100 - MARGIN
        i[part] = np.where(same, i[part], -1)
    j, i = j[i >= 0], i[i >= 0]
    if not len(i):
        return []
    rows = np.unique(np.concatenate([i, j]))
    shared = common([sets[r] for r in rows])[np.searchsorted(rows, i), np.searchsorted(rows, j)]
    linked = 100 * shared >= percent * (size[i] + size[j] - shared)
    return forest([nodes[r] for r in i[linked]], [nodes[r] for r in j[linked]])


def _compare(percent: int):
    def one(group: list[tuple]) -> list[tuple]:
        nodes, second, marks, sets = zip(*group)
        return links_of(list(nodes), np.array(second), np.array([np.frombuffer(m, np.uint32) for m in marks]),
                        [np.frombuffer(s, np.uint64) for s in sets], percent)
    return by_group(one, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def candidate_tiles(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``node, n_shingles, marks``: ``node, tile`` of nodes that share a bucket, ``t1, t2`` of tiles that do."""
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
        i, F.slice("marks", i * BAND_ROWS + 1, BAND_ROWS)))).alias("key")
    rows = stored(marks.select("node", "n_shingles", band), "bands")
    buckets = stored(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    shared = stored(rows.join(buckets, "key"), "shared")
    first = stored(shared.groupBy("node").agg(F.max(F.struct("size", "key")).alias("h"), F.first("n_shingles").alias("n_shingles"))
                   .select("node", "n_shingles", F.col("h.key").alias("home")), "first-homes")
    # A node moves to the most crowded home that any bucket of it leads to, else stragglers of a large
    # group would each bring a tile of their own to every tile of the group.
    crowd = stored(first.groupBy("home").agg(F.count("*").alias("crowd")), "crowds")
    at = stored(first.join(crowd, "home").select("node", "n_shingles", F.struct("crowd", "home").alias("h")), "at")
    led = stored(shared.select("key", "node").join(at, "node"), "led")
    best = stored(led.groupBy("key").agg(F.max("h").alias("best")), "best")
    home = stored(led.join(best, "key").groupBy("node").agg(F.max("best").alias("h"), F.first("n_shingles").alias("n_shingles"))
                  .select("node", "n_shingles", F.col("h.home").alias("home")), "homes")
    pieces = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n_shingles") / TILE_SHINGLES))
    cut = stored(home.groupBy("home").agg(pieces.alias("pieces")), "pieces")
    tiles = stored(home.join(cut, "home").select(
        "node", F.xxhash64("home", F.pmod(F.xxhash64("node"), "pieces")).alias("tile")), "tiles")
    met = stored(shared.select("key", "node").join(tiles, "node").select("key", "tile").distinct(), "met")
    pairs = met.withColumnRenamed("tile", "t1").join(met.withColumnRenamed("tile", "t2"), "key").filter("t1 <= t2")
    return tiles, stored(pairs.select("t1", "t2").distinct(), "pairs")


def near_links(docs: DataFrame, nodes: DataFrame, percent: int, k: int) -> DataFrame:
    """Verified links ``a, b`` between ``nodes(node, n_shingles, d1, d2, marks)``, enough for the components."""
    tiles, pairs = candidate_tiles(nodes.select("node", "n_shingles", "marks"))
    wanted = stored(tiles.join(nodes.select("node", "d1", "d2"), "node"), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = stored(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node")
                  .select("node", "text", "d1", "d2")
                  .mapInArrow(_full_sets(k), "node long, marks binary, shingles binary"), "sets")
    pair = F.xxhash64("t1", "t2").alias("pair")
    member = pairs.select(pair, F.explode(F.expr("if(t1 = t2, array(struct(t1 as tile, false as second)), "
                                                 "array(struct(t1 as tile, false as second), struct(t2 as tile, true as second)))")).alias("x"))
    rows = member.select("pair", "x.tile", "x.second").join(tiles, "tile").select("pair", "second", "node").join(sets, "node")
    rows = rows.select("pair", "node", "second", "marks", "shingles").repartition("pair").sortWithinPartitions("pair")
    return rows.mapInArrow(_compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    A null or empty text, or one of white space, has no shingle and links with nothing. A null doc_id
    gets a component if its set is found under another id, and is not kept then; else its component is
    null and it is kept. Rows that share a doc_id are compared one by one and each gets its component.
    Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    marks = stored(sketches(docs, k), "sketches")
    sets = stored(marks.filter("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    nodes = stored(marks.filter("n_shingles > 0").withColumnRenamed("doc_id", "node").join(
        sets.select("node", "d1", "d2"), ["node", "d1", "d2"], "left_semi").dropDuplicates(["node", "d1", "d2"]), "nodes")
    groups = stored(components(near_links(docs, nodes, percent, k)), "components")
    known = stored(sets.join(groups, "node", "left").filter("copies > 1 or component is not null")
                   .select("d1", "d2", F.coalesce("component", "node").alias("component")), "known")
    out = marks.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("d1"), "d2").join(
        known, ["d1", "d2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in the one column of ``ids``; rows with a null doc_id stay."""
    ids = stored(ids.toDF("_gone").filter("_gone is not null").distinct(), "gone")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["_gone"], "left_anti")


def drop_near_duplicates(docs: DataFrame, percent: int = 75, k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs``, all columns, with the smallest doc_id of each component; rows with a null doc_id stay."""
    decided = near_duplicates(docs.select("doc_id", "text"), percent, k)
    return without_ids(docs, decided.filter("not kept").select("doc_id"))


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents; a text without words is its own component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
