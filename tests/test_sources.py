import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.operators.triples import SCHEMA
from lakegraph.sources import incremental, json_map, readers, sinks


def _triples(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("s"), "id").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.lit("iri").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"))


def test_changed_files(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name * 10)
    status = lambda df: {os.path.basename(r["path"]): r["status"] for r in df.collect()}
    first = incremental.detect_changed_files(spark, str(tmp_path))
    assert status(first) == {"a": "new", "b": "new", "c": "new"}
    kept = first.filter(~F.col("path").endswith("c")).select("name", "length", "modified", "digest").collect()
    manifest = spark.createDataFrame(kept, incremental.MANIFEST_SCHEMA)
    (tmp_path / "b").write_text("b" * 10 + "!")
    os.utime(tmp_path / "a", (1, 1))  # touched, not changed
    second = incremental.detect_changed_files(spark, str(tmp_path), manifest)
    assert status(second) == {"a": "unchanged", "b": "changed", "c": "new"}
    updated = incremental.update_manifest(manifest, second.filter("status <> 'unchanged' OR name LIKE '%a'"))
    assert updated.count() == 3
    third = incremental.detect_changed_files(spark, str(tmp_path), updated)
    assert set(status(third).values()) == {"unchanged"}


def test_digests_do_not_depend_on_splits(spark, tmp_path):
    rng = random.Random(1)
    lines = [bytes(rng.randrange(256) for _ in range(rng.randrange(40))).replace(b"\n", b"") for _ in range(400)]
    variants = {"same": lines, "again": lines, "moved": lines[1:] + lines[:1], "swapped": lines[:10] + [lines[11], lines[10]] + lines[12:],
                "fewer": lines[:-1], "more": lines + [b""], "changed of 1%20": lines[:200] + [b"x"] + lines[201:], "none": []}
    for name, rows in variants.items():
        (tmp_path / name).write_bytes(b"".join(r + b"\n" for r in rows))
    digests = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "700b", "3000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            digests.append({os.path.basename(r["path"]): r["digest"] for r in incremental.file_digests(spark, str(tmp_path)).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert digests[0] == digests[1] == digests[2] and digests[0].keys() == variants.keys() - {"none"}
    assert digests[0]["same"] == digests[0]["again"] and len(set(digests[0].values())) == len(variants) - 2


@pytest.mark.parametrize("size", ["128m", "90b", "333b"])
def test_json_map_is_read_by_many_tasks(spark, tmp_path, size):
    rng = random.Random(4)
    ugly = ['"', "}", "{", "\\", "\\\"", " ", "é", "a", "\n", ",", "},{"]
    word = lambda: "".join(rng.choice(ugly) for _ in range(rng.randrange(7)))
    want = []
    for d in range(3):
        document = {f"{i} {word()}": None if rng.random() < 0.2 else
                    {"x": word(), "y": [{"z": rng.randrange(9)} for _ in range(rng.randrange(3))]} for i in range((0, 60, 25)[d])}
        text = json.dumps(document, indent=(None, 2, None)[d], ensure_ascii=bool(d))
        (tmp_path / f"{d}.json").write_text(text + ("", "\n", " \n ")[d])
        want += [(k, v and (v["x"], [r["z"] for r in v["y"]])) for k, v in document.items()]
    (tmp_path / "4.json").write_text('{"cut": {"x": "off"}, "b": {"x": "')
    (tmp_path / "5.json").write_text('{"cut": {"x": "off"}, "b": {"x": 1')
    (tmp_path / "6.json").write_text('{"bad": {"x": "1", ]}, "good": {"x": "2", "y": []}}')
    (tmp_path / "7.json").write_text("")
    want.append(("good", ("2", [])))
    schema = T._parse_datatype_string("x string, y array<struct<z int>>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = json_map.read_json_map_whole(spark, str(tmp_path), schema).collect()
        counts = json_map.unparsed_records(spark, str(tmp_path), schema).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    got = [(r["key"], r["value"] and (r["value"]["x"], [y["z"] for y in r["value"]["y"]])) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (counts["documents"], counts["broken"], counts["unparsed"]) == (6, 2, 1)


def test_missing_inputs(spark, tmp_path):
    (tmp_path / "a.dat").write_text("x")
    assert incremental.missing_inputs(spark, spark.createDataFrame([("a.dat",), ("b.dat",)], "name string"), str(tmp_path)).collect() == [("b.dat",)]


def test_merge_keeps_what_is_there(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    new = spark.createDataFrame([("2", "b"), ("3", "c")], "v string, k string")
    merged = incremental.incremental_merge(old, new, "k")
    assert sorted(merged.collect(), key=str) == [("a", "1"), ("b", None), ("c", "3")]
    assert sorted(incremental.incremental_merge(merged, new, "k").collect(), key=str) == sorted(merged.collect(), key=str)


def test_merge_adds_one_row_per_new_key(spark):
    old = spark.createDataFrame([("a", "1", 0)], "k string, v string, n int")
    new = spark.createDataFrame([("b", "2", 5), ("b", None, 7), ("b", "1", 1), ("c", "9", 1)], "k string, v string, n int")
    assert sorted(incremental.incremental_merge(old, new, "k").collect(), key=str) == [("a", "1", 0), ("b", None, 7), ("c", "9", 1)]


def test_unparsed_documents_are_counted(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": {"x": 1}}\n{"a": \n\n{"b": null}\nnot json\n')
    schema = spark.createDataFrame([], "x int").schema
    assert readers.unparsed_documents(spark, str(tmp_path), schema, lines=True).first() == (4, 2)


def test_whole_json_document(spark, tmp_path):
    (tmp_path / "d.json").write_text('{\n "a": {"x": 1},\n "b": null}')
    schema = spark.createDataFrame([], "x int").schema
    assert sorted(readers.read_json_map(spark, str(tmp_path / "d.json"), schema).collect()) == [("a", (1,)), ("b", None)]


def test_send_in_batches(spark, tmp_path):
    folder = str(tmp_path)

    def send(text):
        import uuid
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        return True

    sinks.send_triples(_triples(spark, 25).coalesce(1), send, batch=10)
    sizes = sorted(len((tmp_path / f).read_text().split("\n")) for f in os.listdir(folder))
    assert sizes == [5, 10, 10]


def test_a_refused_batch_is_tried_again(spark, tmp_path):
    log = str(tmp_path / "tries")

    def send(text):
        with open(log, "a") as f:
            f.write("x")
        return os.path.getsize(log) >= 3

    sinks.send_triples(_triples(spark, 5).coalesce(1), send, retries=3, delay=0)
    assert os.path.getsize(log) == 3


def test_a_batch_nobody_takes_fails_the_job(spark):
    with pytest.raises(Exception, match="refused 2 times"):
        sinks.send_triples(_triples(spark, 5).coalesce(1), lambda text: False, retries=2, delay=0)


def test_written_forms(spark, tmp_path):
    triples = _triples(spark, 3).union(spark.createDataFrame([("s", "p", "x", "literal", "t")], SCHEMA))
    sinks.write_ntriples(triples, str(tmp_path / "nt"))
    assert spark.read.text(str(tmp_path / "nt")).count() == 4
    sinks.write_triples_tsv(triples, str(tmp_path / "tsv"))
    assert readers.read_triples_tsv(spark, str(tmp_path / "tsv")).count() == 3
    row = sinks.storage_footprint(spark, str(tmp_path / "nt"), str(tmp_path / "tsv")).first()
    assert row["saved_pct"] == pytest.approx((1 - row["after_bytes"] / row["before_bytes"]) * 100)


def test_one_document_of_many_sorted_ranges(spark, monkeypatch):
    """The task that writes the document sorts nothing, and ranges come in the order of their keys."""
    import glob

    from lakegraph import catalog
    from lakegraph.catalog import storage
    from lakegraph.session import checkpoint_dir
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(storage, "ROWS_OF_RANGE", 200)
    names = lambda: set(glob.glob(f"{checkpoint_dir(spark)}/document-*"))
    before = names()
    rows = catalog.all_queries()["read_json_map_whole"](spark, folder).count()
    made = names() - before
    (document,) = [x for x in made if "rows" not in x]
    (ranges,) = [x for x in made if "rows" in x]
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert rows == orders.count() + orders.filter("o_orderstatus = 'P'").count()
    assert len(glob.glob(f"{ranges}/range=*")) > 5
    (file,) = glob.glob(f"{document}/part-*")
    text = open(file).read()
    keys = [int(x.split('"')[0]) for x in text.split('"order ')[1:]]
    assert text.startswith("{ ") and text.endswith("}\n") and keys == sorted(keys) and len(keys) == orders.count()


def test_many_gzip_files_are_not_dealt_again(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for name, files in (("many", cores), ("one", 1)):
        spark.range(0, 1000, 1, files).write.option("compression", "gzip").csv(str(tmp_path / name))
    read = lambda name: readers.read_delimited(spark, str(tmp_path / name), "id bigint", ",", partitions=3 * cores)
    assert read("many").rdd.getNumPartitions() == cores and read("one").rdd.getNumPartitions() == 3 * cores
    assert sorted(r[0] for r in read("many").collect()) == sorted(r[0] for r in read("one").collect()) == list(range(1000))


def test_a_json_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": {"x": 1}, "b": null}\n{}\nnot json\n')
    rows = readers.read_json_map(spark, str(tmp_path / "d.json"), spark.createDataFrame([], "x int").schema, lines=True)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(rows.collect()) == [("a", (1,)), ("b", None)]


def test_a_graph_is_written_without_a_shuffle(spark, tmp_path):
    from lakegraph.sources import sinks
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before, sc = spark.conf.get(key), spark.sparkContext
    # More predicates than files a task has open, in turn.
    rows = [(f"s{i}", f"p{i % (2 * sinks._OPEN_FILES)}", str(i), "iri", None) for i in range(1000)]
    graph = sc.parallelize(rows, 3).toDF("s string, p string, o string, o_kind string, o_datatype string")
    sc.setJobGroup("graph", "graph")
    try:
        sinks.write_triples(graph, str(tmp_path / "g"))
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("graph")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [len(j.stageIds) for j in jobs if j] == [1] and spark.conf.get(key) == before
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "g")).select(*graph.columns).collect()) == sorted(rows)
