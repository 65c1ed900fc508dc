"""A sender that fails half-way, and graphs that grow between runs."""

import os

from pyspark.sql import functions as F

from lakegraph.operators.triples import to_ntriples
from lakegraph.sources import outbox


def _triples(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("s"), "id").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.lit("iri").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"))


def _sender(folder, refuse):
    """Keeps what it takes in a file per batch; ``refuse`` looks at the text."""
    def send(text):
        if refuse(text):
            return False
        with open(os.path.join(folder, str(abs(hash(text)))), "a") as f:
            f.write(text + "\n")
        return True
    return send


def _taken(folder):
    return sorted(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().splitlines())


def test_a_second_run_sends_only_the_rest(spark, tmp_path):
    boxes, ledger, taken = (str(tmp_path / x) for x in ("boxes", "ledger", "taken"))
    os.mkdir(taken)
    assert outbox.send_outbox(spark, boxes, ledger, lambda text: True).count() == 0
    triples = _triples(spark, 950)
    path = outbox.fill_outbox(triples.union(triples), boxes, 100)
    assert outbox.fill_outbox(triples, boxes, 100) != path and len(os.listdir(boxes)) == 1  # all its lines are there already
    odd = lambda text: sum(map(ord, text)) % 2 == 1
    first = outbox.send_outbox(spark, boxes, ledger, _sender(taken, odd), retries=2, delay=0)
    kept = {r["batch"]: r["triples"] for r in first.collect() if r["delivered"]}
    assert first.count() == 10 and 0 < len(kept) < 10
    assert {r["error"] for r in first.collect()} == {None, "refused"}
    assert len(_taken(taken)) == sum(kept.values())

    def broken(text):
        raise OSError("down")
    assert {r["error"] for r in outbox.send_outbox(spark, boxes, ledger, broken, retries=1).collect()} == {"OSError: down"}
    last = outbox.send_outbox(spark, boxes, ledger, _sender(taken, lambda text: False))
    assert {r["batch"] for r in last.collect()} == {r["batch"] for r in first.collect()} - kept.keys()
    assert _taken(taken) == sorted(r["line"] for r in to_ntriples(triples).collect())  # each once
    assert outbox.send_outbox(spark, boxes, ledger, broken).count() == 0

    outbox.fill_outbox(_triples(spark, 1000), boxes, 100)
    more = outbox.send_outbox(spark, boxes, ledger, _sender(taken, lambda text: False))
    assert sum(r["triples"] for r in more.collect()) == 50
    assert _taken(taken) == sorted(r["line"] for r in to_ntriples(_triples(spark, 1000)).collect())
    assert outbox.read_ledger(spark, ledger).filter("delivered").agg(F.sum("triples")).first()[0] == 1000
