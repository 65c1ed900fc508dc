"""States of loads, merged in any grouping, against a profile of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakegraph.operators import states
from lakegraph.operators.profile import descriptive_profile


def _rows():
    rng = random.Random(6)
    return [(i % 5, None if rng.random() < 0.2 else 1e9 + rng.random(), rng.randrange(300), rng.choice(["a", "b", None]), [i % 7])
            for i in range(3000)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(_rows(), "load int, x double, `odd.name` int, s string, xs array<int>")


def _report(merged):
    return {(r["column"], r["metric"]): r["value"] for r in states.states_report(merged).collect()}


def test_states_add_up(spark, rows, tmp_path):
    by_load = states.profile_states(rows, ("load",))
    by_load.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    whole = _report(states.merge_states(states.profile_states(rows.drop("load"))))
    merged = _report(states.merge_states(stored.drop("load")))
    pairs = states.merge_states(states.merge_states(stored.withColumn("half", F.col("load") % 2), ("half",)).drop("half"))
    for got in (merged, _report(pairs)):
        assert got.keys() == whole.keys()
        assert all(got[k] == pytest.approx(whole[k], rel=1e-9) for k in got if k[1] not in ("distinct", "q25", "q50", "q75", "stddev"))
    plain = {(r["column"], r["metric"]): r["value"] for r in descriptive_profile(rows.drop("load")).collect()}
    for column in ("x", "odd.name"):
        for metric in ("count", "mean", "min", "max"):
            assert merged[column, metric] == pytest.approx(plain[column, metric], rel=1e-12)
        # All of x is near 1e9: sums of squares would have lost its deviations.
        assert merged[column, "stddev"] == pytest.approx(plain[column, "stddev"], rel=1e-6)
        assert abs(merged[column, "distinct"] - plain[column, "distinct"]) <= states.DISTINCT_ERROR * plain[column, "distinct"] + 0.5
        values = sorted(r[0] for r in rows.select(F.col(f"`{column}`")).collect() if r[0] is not None)
        for p in (0.25, 0.5, 0.75):
            lo, hi = (values[min(len(values) - 1, max(0, math.floor((p + e) * len(values))))] for e in (-states.RANK_ERROR, states.RANK_ERROR))
            assert lo <= merged[column, f"q{round(100 * p)}"] <= hi
    assert merged["s", "distinct"] == 3 and merged["xs", "distinct"] == 7
    assert merged["x", "missing_ratio"] == pytest.approx(rows.filter("x IS NULL").count() / 3000)
    assert ("s", "mean") not in merged


def test_states_of_nothing(spark, rows):
    none = states.profile_states(rows.filter("load < 0").drop("load"))
    got = _report(states.merge_states(none))
    assert got["x", "row_count"] == 0 and got["x", "mean"] is None and got["x", "q50"] is None and got["x", "missing_ratio"] is None
    both = _report(states.merge_states(none.unionByName(states.profile_states(rows.drop("load")))))
    alone = _report(states.profile_states(rows.drop("load")))
    # Merging sketches draws lots; everything else is as it was.
    sketch = ("q25", "q50", "q75")
    assert both.keys() == alone.keys()
    assert {k: v for k, v in both.items() if k[1] not in sketch} == pytest.approx({k: v for k, v in alone.items() if k[1] not in sketch})
    gaps = spark.createDataFrame([(None,), (None,)], "x double")
    assert _report(states.merge_states(states.profile_states(gaps)))["x", "distinct"] == 1


def test_standing_tells_what_percentiles_tell(spark):
    """Whether a value is between two percentiles follows from partial sums, without a task that holds all values."""
    import random

    from pyspark.sql import functions as F

    from lakegraph.catalog.quality import _between_percentiles, _standing
    random.seed(2)
    for n in (0, 1, 2, 3, 10, 40):
        values = [float(random.randint(0, 12)) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
        v = F.col("v")
        for low, high in ((0.22, 0.28), (0.0, 0.5), (0.72, 0.78), (0.47, 0.53)):
            asked = spark.createDataFrame([(x / 2,) for x in range(-1, 26)] + [(None,)], "v double")
            got = df.crossJoin(asked).groupBy("v").agg(_standing(F.col("x"), v).alias("s"), F.percentile("x", low).alias("l"), F.percentile("x", high).alias("h"))
            bad = got.filter(~_between_percentiles(v, F.col("s"), low, high).eqNullSafe(v.between(F.col("l"), F.col("h"))) & F.col("l").isNotNull())
            assert bad.count() == 0
