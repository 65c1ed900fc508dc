"""Embeddings, archives and URL rules against brute force, on odd rows."""

import base64
import hashlib
import math
import random
import struct

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lakegraph.llm import op7_embedding_dedup as op7
from lakegraph.llm import op9_warc as op9
from lakegraph.llm import op10_url_filter as op10
from lakegraph.llm.components import components
from lakegraph.session import work_path


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [
        (i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 3), (3, None)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if a is not None and b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b and None not in (a, b) for x in (a, b)}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, node string, copies string, n string, dim string"


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(op7, "TILE", 16)
    rng = np.random.default_rng(0)
    rows = []
    for label in (0, 1):
        for c in rng.standard_normal((4, 8)):
            for _ in range(20):
                rows.append((len(rows), (c + rng.standard_normal(8) * 0.11).tolist(), label))
    one = rows[0][1]
    rows += [(500 + i, list(one), 0) for i in range(30)] + [(600, [2 * x for x in one], 0), (601, one, None), (602, None, 0), (603, [0.0] * 8, 0),
             (604, [math.nan] + one[1:], 0), (605, [math.inf] + one[1:], 0), (606, [None] + one[1:], 0), (607, [], 0), (608, one[:4], 0),
             (609, [1e-38 * x for x in one], 0), (610, [3e37 * x for x in one], 0), (None, one, 0), (0, one, 0)]
    df = spark.createDataFrame([(*r, "x", "y", "z", "d") for r in rows], VECTORS)
    ok = [i is not None and k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, k in rows]
    single = [np.array(v, np.float32).astype(float) if o else None for (_, v, _), o in zip(rows, ok)]
    want_links, root = [0] * len(rows), {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(single[a]) == len(single[b]):
                if single[a] @ single[b] / (np.sqrt(single[a] @ single[a]) * np.sqrt(single[b] @ single[b])) >= 0.98:
                    want_links[a] += 1
                    want_links[b] += 1
                    root[max(find(rows[a][0]), find(rows[b][0]))] = min(find(rows[a][0]), find(rows[b][0]))
    want = [(i, n, find(i) if o else i, i is None or i == (find(i) if o else i)) for (i, _, _), n, o in zip(rows, want_links, ok)]
    got = [tuple(r) for r in op7.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(want_links) > 20
    assert op7.near_vectors(df.limit(0)).count() == 0


def odd_pages():
    long = "<p>" + "payload é " * 200
    rows = [(i, f"http://h{i}.com/a?x={i}", long) for i in range(6)] + [
        (10, None, "x" * 999), (11, "no scheme", "x" * 999), (12, "http://é.com/ü ä\r\nX: y", None), (13, "u", ""), (14, "u", "y" * 1000), (15, "u", "y" * 1000),
        (None, "http://n.com/", long), (5, "again", long), (16, "http://big.com/", "z" * 3_000_000), (17, "http://big.com/", "z" * 3_000_000), (5, "other", "w" * 2000)]
    return [(*r, "a", "b", "c") for r in rows]


PAGES = "page_id long, url string, html string, name string, digest string, payload string"


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(op9, "ARCHIVE_BYTES", 300)
    monkeypatch.setattr(op9, "TRAINED_ON", 3)
    pages = spark.createDataFrame(odd_pages(), PAGES).repartition(2)
    path = work_path(spark, "archives")
    op9.archive_pages(pages, path)
    got = op9.read_archives(spark, path).collect()
    assert not [r for r in got if r["error"]]
    rows = odd_pages()
    last = {}
    for i, _, html, *_ in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            last[html] = max(last.get(html, i), i)
    want = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        keeper = last.get(html) if i is not None else None
        again = keeper is not None and keeper != i
        want.append((f"urn:page:{'none' if i is None else i}", "revisit" if again else "response", len(raw), hashlib.sha1(raw).hexdigest(),
                     f"urn:page:{keeper}" if again else None, None if again else raw))
    have = [(r["record_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    empty = work_path(spark, "archives")
    op9.archive_pages(pages.limit(0), empty)
    assert op9.read_archives(spark, empty).count() == 0


def test_archives_are_plain_zstandard_with_a_dictionary_first(spark):
    path = work_path(spark, "archives")
    op9.archive_pages(spark.createDataFrame(odd_pages(), PAGES).coalesce(1), path)
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    magics = [m for m, _ in op9.frames_of(data)]
    assert magics[0] == op9.DICTIONARY_MAGIC and magics.count(op9.FRAME_MAGIC) == len(odd_pages())
    assert magics[1::2] == [op9.SKIPPABLE] * (len(magics) // 2)


def test_bad_archives():
    good = b"".join(op9.archive_frames(iter([op9.record(f"urn:page:{i}", "http://a.b/", b"text %d" % i, None) for i in range(20)])))
    assert [r["error"] for r in op9.read_archive(good)] == [None] * 20
    assert len(list(op9.read_archive(good[:-3]))) == 20 and list(op9.read_archive(good[:-3]))[-1]["error"]
    assert list(op9.read_archive(good + b"junk and more"))[-1]["error"]
    size = struct.unpack_from("<I", good, 4)[0]
    lost = list(op9.read_archive(good[8 + size:]))  # its dictionary is gone
    assert len(lost) == 20 and all(r["error"] and r["record_id"] is None for r in lost)
    squeezed = zstandard.ZstdCompressor().compress(good[8:8 + size])
    packed = struct.pack("<II", op9.DICTIONARY_MAGIC, len(squeezed)) + squeezed + good[8 + size:]
    assert [r["error"] for r in op9.read_archive(packed)] == [None] * 20
    raw = op9.record("urn:page:1", "http://a.b/", b"payload", None)
    for bad in (raw.replace(b"payload", b"pAyload"), raw[:-1], raw.replace(b"WARC-Date", b"WARC-Dato"), raw.replace(b"WARC/1.1", b"WARD/1.1"),
                raw.replace(b"Content-Length: 7", b"Content-Length: 8"), b""):
        with pytest.raises(ValueError):
            op9.parse(bad)


def foreign(kind, block, *more, sep="\r\n"):
    head = ["WARC/1.0", f"warc-type:{kind}", "WARC-RECORD-ID: <urn:x:1>", "WARC-Date:  2020-01-01T00:00:00Z", *more, f"content-length:{len(block)}"]
    return sep.join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives():
    http = b"HTTP/1.1 200 OK\r\nSERVER:x\r\n\tfolded: on\r\ncontent-length:4\r\n\r\nbody"
    sha1, sha256 = hashlib.sha1(b"body"), hashlib.sha256(b"body")
    app = "Content-Type:application/http; msgtype=response"
    records = [
        (foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), ("warcinfo", 13, b"software: x\r\n")),
        (foreign("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;msgtype=request"), ("request", 18, b"GET / HTTP/1.1\r\n\r\n")),
        (foreign("metadata", b"", "Content-Type: text/plain"), ("metadata", 0, b"")),
        (foreign("response", http, app, "WARC-Target-URI:", " http://a.b/"), ("response", 4, b"body")),
        (foreign("response", http, app, "WARC-Payload-Digest: SHA-256:" + sha256.hexdigest()), ("response", 4, b"body")),
        (foreign("response", http, app, "warc-payload-digest:sha1:" + base64.b32encode(sha1.digest()).decode().lower()), ("response", 4, b"body")),
        (foreign("response", http, app, "WARC-Payload-Digest: crc:1", "WARC-Block-Digest: md5:" + hashlib.md5(http).hexdigest()), ("response", 4, b"body")),
        (foreign("response", http[:-1], app, "WARC-Truncated: length"), ("response", 3, b"bod")),
        (foreign("response", http.replace(b"content-length:4", b"Transfer-Encoding: chunked\r\ncontent-length:9"), app), ("response", 4, b"body")),
        (foreign("response", b"a dns answer", "Content-Type: text/dns"), ("response", 12, b"a dns answer")),
        (foreign("revisit", b"", app, "WARC-Refers-To-Target-URI: http://a.b/"), ("revisit", None, None)),
        (foreign("revisit", http[:-4], app, "WARC-Refers-To: <urn:x:0>"), ("revisit", 4, None)),
    ]
    streamed = zstandard.ZstdCompressor().compressobj

    def frame(raw):  # a streaming compressor does not know the size
        own = streamed()
        return own.compress(raw) + own.flush()
    data = struct.pack("<II", op9.SKIPPABLE, 3) + b"abc" + b"".join(frame(raw) for raw, _ in records)
    got = list(op9.read_archive(data))
    assert [r["error"] for r in got] == [None] * len(records)
    assert [(r["record_type"], r["payload_bytes"], r["payload"]) for r in got] == [want for _, want in records]
    assert got[3]["target_uri"] == "http://a.b/" and got[3]["payload_digest"] == sha1.hexdigest() and got[11]["refers_to"] == "urn:x:0"
    assert {r["record_id"] for r in got} == {"urn:x:1"}
    for bad in (foreign("response", http, app, "WARC-Payload-Digest: sha1:" + "0" * 40), foreign("response", b"no head", app),
                foreign("response", http, app, "WARC-Block-Digest: md5:" + "0" * 32), foreign("revisit", b"", app), foreign("response", http + b"y", app),
                foreign("response", http, app, "WARC-Payload-Digest: sha1:?"), foreign("response", http, app, "content-length: x")[:-3]):
        with pytest.raises(ValueError):
            op9.parse(bad)


def test_records_that_unpack_to_too_much(monkeypatch):
    monkeypatch.setattr(op9, "MOST_BYTES", 1000)
    bomb = zstandard.ZstdCompressor().compress(foreign("resource", b"0" * 100_000))
    small = zstandard.ZstdCompressor().compress(foreign("resource", b"0" * 10))
    assert [bool(r["error"]) for r in op9.read_archive(bomb + small)] == [True, False]


URLS = ["http://example.com/en/1", "https://www.example.com/en/1", "HTTP://A.B.EXAMPLE.COM/en", "http://example.com", "http://example.com?x/en/", "x://net/es/a#b",
        "http://sub.net/fr/", "http://notnet/fr/", "http://snet/es/", "no scheme com/", None, "", "://", "http://com/a://b", "http://org/x?utm_source=a&b=1#z", "http://www.org/x?b=1",
        "http://org/x/?b=1&utm_medium=q", "http://org/y", "http://ORG/y#top", "http://org/é\nü?q", "http://user@com:80/", "http://example.comm/en/"]


def test_url_filter(spark, monkeypatch):
    pages = [(i, u, None, "x", "y") for i, u in enumerate(URLS + URLS[:3] + [None])] + [(None, "http://org/y", None, "x", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, key string, block string")
    listed = ["http://org/x?b=1", "http://www.org/y/", None, "junk", "http://org/y"]

    def want():
        con = duckdb.connect()
        con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?)", [p[:2] for p in pages])
        con.sql("CREATE TABLE given (key VARCHAR)")
        con.executemany("INSERT INTO given VALUES (?)", [("org/x?b=1",), ("org/y",)])
        sql = op10.SQL.replace("listed AS (SELECT key FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1)", "listed AS (SELECT key FROM given)")
        return con.sql(f"SELECT page_id, host, path, rule, verdict, listed FROM ({sql})").fetchall()
    for urls, broadcast in ((op10.URLS_PER_BLOCK, op10.BROADCAST_BLOCKS), (1, op10.BROADCAST_BLOCKS), (1, 0)):
        monkeypatch.setattr(op10, "URLS_PER_BLOCK", urls)
        monkeypatch.setattr(op10, "BROADCAST_BLOCKS", broadcast)
        got = [tuple(r) for r in op10.judge(df, spark.createDataFrame([(u,) for u in listed], "url string")).collect()]
        assert sorted(got, key=str) == sorted(want(), key=str)
    verdicts = {r[0]: r[3:5] for r in got}
    assert verdicts[0] == ("example.com/en/", "block") and verdicts[1] == ("www.example.com/en/", "allow") and verdicts[3] == (None, "allow")
    assert op10.judge(df.limit(0), df.select("url")).count() == 0
    assert {r["listed"] for r in op10.judge(df, df.select("url").limit(0)).collect()} == {False}


def test_bloom_filter_follows_the_list_and_loses_nothing(spark):
    urls = spark.range(500).selectExpr("concat('h.org/', id) AS listed_url")
    assert op10.bloom_filter(urls, 8).count() == 8
    for n in (500, 4000):
        blocks = -(-n // op10.URLS_PER_BLOCK)
        listed = spark.range(n).selectExpr("concat('h.org/', id) AS listed_url")
        made = {r["block"]: r for r in op10.bloom_filter(listed, blocks).collect()}
        others = spark.range(20_000).selectExpr("concat('other.org/', id) AS key")
        bits = others.select(op10._block(F.col("key"), blocks).alias("b"), *[op10._bit(F.col("key"), i).alias(f"w{i}") for i in range(op10.WORDS)]).collect()
        passed = sum(r["b"] in made and all(made[r["b"]][f"w{i}"] & r[f"w{i}"] for i in range(op10.WORDS)) for r in bits)
        assert passed < 0.03 * len(bits)
    pages = spark.range(1000).selectExpr("id AS page_id", "concat('http://h.org/', id) AS url")
    got = op10.judge(pages, urls.selectExpr("concat('http://', listed_url)"))
    assert got.filter("listed").count() == 500 and got.filter("listed AND page_id >= 500").count() == 0
