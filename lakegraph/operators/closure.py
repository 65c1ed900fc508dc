"""Reachability over links in logarithmically many rounds: transitive closure and connected components."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import stored

log = logging.getLogger(__name__)


def transitive_closure(links: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """All (*by, s, o, steps) that lead from s to o over links of one ``by``, and the number of rounds.

    ``steps`` is the length of the shortest way. Semi-naive: round k joins only the pairs that are exactly
    2^(k-1) steps apart, found in the round before, to all pairs known so far, which finds every pair at
    most 2^k steps apart. So the rounds grow with the logarithm of the longest shortest way, and a pair
    is made once per node in the middle of its shortest ways. Null ends lead nowhere; a cycle leads back to
    its start. Both sides of the join are written tables, so that adaptive execution can split a hub.
    """
    links = links.filter(F.col("s").isNotNull() & F.col("o").isNotNull())
    known = stored(links.select(*by, "s", "o").distinct().withColumn("steps", F.lit(1).cast("long")), "reach", compression="zstd")
    newest, rounds = known, 0
    while True:
        far = newest.filter(F.col("steps") == 2 ** rounds)
        if not far.head(1):  # a longer way would begin with one of these
            return known, rounds
        onward = known.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("s").alias("_s"), F.col("o").alias("_o"),
                              F.col("steps").alias("_steps"))
        same = F.col("o") == F.col("_s")
        for c in by:
            same &= F.col(c) == F.col(f"_{c}")
        found = far.join(onward, same).select(*by, "s", F.col("_o").alias("o"), (F.col("steps") + F.col("_steps")).alias("steps"))
        found = found.groupBy(*by, "s", "o").agg(F.min("steps").alias("steps"))
        newest = stored(found.join(known, [*by, "s", "o"], "left_anti"), "reach", compression="zstd")
        rounds += 1
        added = newest.count()
        log.info("transitive closure, round %d: %d new pairs", rounds, added)
        if not added:
            return known, rounds
        known = known.unionByName(newest)


def representatives(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, representative) for every node with a link, and the number of rounds.

    The representative is the smallest node that is connected. In each round a node takes the smallest
    label among its own, its neighbours' and that of the node it is labelled with, so that labels travel
    ever longer ways. Minima combine before the shuffle; no neighbourhood is gathered.
    """
    both = links.select(F.col("s").alias("node"), F.col("o").alias("next")).filter("node IS NOT NULL AND next IS NOT NULL")
    both = stored(both.union(both.select("next", "node")).distinct(), "neighbours")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("next")).alias("label")), "labels")
    rounds = 0
    while True:
        around = both.join(labels.select(F.col("node").alias("next"), "label"), "next").groupBy("node").agg(F.min("label").alias("near"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = labels.join(around, "node").join(further, "label").select(
            "node", F.least("label", "near", "further").alias("least"), F.col("label").alias("was"))
        now = stored(moved.withColumnRenamed("least", "label"), "labels")
        rounds += 1
        changed = now.filter("label <> was").count()
        log.info("representatives, round %d: %d labels changed", rounds, changed)
        labels = now.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "representative"), rounds
