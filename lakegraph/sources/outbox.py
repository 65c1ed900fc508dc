"""Sending a graph to an endpoint so that a run that breaks off is carried on by the next one.

The triples to send are written once, in batches numbered by content, and a ledger keeps the numbers of
batches that were taken. A refused batch does not stop the others and is not lost: its number is missing in
the ledger, and only such batches are sent again.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import to_ntriples

LEDGER_SCHEMA = "batch string, triples bigint, delivered boolean, error string"
# Batches in a task: each task sends its own one after the other.
BATCHES_PER_TASK = 200


def fill_outbox(triples: DataFrame, folder: str, batch: int = 500) -> str:
    """Write the lines that are in no earlier outbox of ``folder`` as a new one, and give its path.

    An outbox is named by its content, so filling it again with the same triples changes nothing, also if the
    first attempt broke off. Lines get a number by their hash, batches about ``batch`` lines.
    """
    spark = triples.sparkSession
    lines = to_ntriples(triples).distinct()
    sent = _outboxes(spark, folder)
    if sent is not None:
        lines = lines.join(sent.select("line"), "line", "left_anti")
    n, low, high = lines.agg(F.count("*"), F.sum(F.xxhash64("line").cast("decimal(20,0)")), F.sum(F.hash("line").cast("bigint"))).first()
    name = hashlib.sha256(f"{n} {low} {high} {batch}".encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/outbox={name}"
    if n:
        batches = max(1, math.ceil(n / batch))
        number = F.pmod(F.xxhash64("line"), F.lit(batches))
        parts = max(1, math.ceil(batches / BATCHES_PER_TASK))
        dealt = lines.withColumn("number", number).repartition(parts, "number").sortWithinPartitions("number", "line")
        dealt.select("number", "line").write.mode("overwrite").parquet(path)
    return path


def send_outbox(spark: SparkSession, folder: str, ledger: str, send: Callable[[str], bool], retries: int = 3, delay: float = 5.0) -> DataFrame:
    """Send every batch below ``folder`` that ``ledger`` does not have as delivered; the ledger's new rows.

    ``send`` gets N-Triples text and returns whether it was taken. Each batch is tried ``retries`` times, after
    ``delay * attempt`` seconds; what it was refused with is noted. Rows of a task are noted when the task ends,
    so only a task that is lost on the way sends batches twice, which a set of triples does not mind.
    """
    boxes = _outboxes(spark, folder)
    if boxes is None:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    done = read_ledger(spark, ledger).filter("delivered").select("batch").distinct()
    batches = boxes.select(F.concat_ws("/", "outbox", F.col("number").cast("string")).alias("batch"), "line")
    waiting = batches.join(done, "batch", "left_anti")
    ready = waiting.groupBy("batch").agg(F.count("*").alias("triples"), F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))

    def deliver(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for name, n, text in zip(*(b[c].to_pylist() for c in ("batch", "triples", "text"))):
                error = None
                for attempt in range(1, retries + 1):
                    try:
                        error = None if send(text) else "refused"
                    except Exception as e:  # the endpoint's client may raise anything
                        error = f"{type(e).__name__}: {e}"
                    if error is None:
                        break
                    if attempt < retries:
                        time.sleep(delay * attempt)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([error is None]), pa.array([error], pa.string())],
                                                 ["batch", "triples", "delivered", "error"])

    path = f"{ledger.rstrip('/')}/run={_last_run(spark, ledger) + 1}"
    ready.mapInArrow(deliver, LEDGER_SCHEMA).write.parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(batch, triples, delivered, error, run) of all runs; none before the first."""
    if not _exists(spark, ledger):
        return spark.createDataFrame([], f"{LEDGER_SCHEMA}, run int")
    return spark.read.schema(f"{LEDGER_SCHEMA}, run int").parquet(ledger)


def _outboxes(spark: SparkSession, folder: str) -> DataFrame | None:
    return spark.read.schema("number bigint, line string, outbox string").parquet(folder) if _exists(spark, folder) else None


def _last_run(spark: SparkSession, ledger: str) -> int:
    """The number of the last run, one that broke off or had nothing to send included."""
    if not _exists(spark, ledger):
        return 0
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return max((int(n.removeprefix("run=")) for n in names if n.startswith("run=")), default=0)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
