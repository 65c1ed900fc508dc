"""WARC archives in Zstandard: written by Spark's text sink, read back frame by frame.

An archive is a skippable frame that holds the dictionary, then one compressed frame per record. Tasks
cut their rows into archives of about ``ARCHIVE_BYTES``; each is one output file. The text sink ends
every row with a separator, for which an empty skippable frame stands, so the files are plain
Zstandard. The commit protocol of the sink makes the files whole, whatever task is repeated.

Equal payloads are found by digest with partial aggregation; only the short list of revisits is joined
to the pages, by page and digest, so a payload that a third of the pages share is not gathered.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegraph.llm.shared import arrow_rows, stored, table
from lakegraph.session import work_path

MIN_REVISIT = 1000
# Compressed bytes after which an archive ends, records its dictionary is trained on, dictionary size.
ARCHIVE_BYTES, TRAINED_ON, DICTIONARY = 4 << 20, 64, 16 << 10
BROADCAST_ROWS = 2_000_000
# A record that unpacks to more than this is an error.
MOST_BYTES = 1 << 30
# Fixed values of the formats.
SKIPPABLE, DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A50, 0x184D2A5D, 0xFD2FB528
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = ("record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, "
          "refers_to string, payload binary, error string")


class BadRecord(ValueError):
    pass


def record(name: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` that keeps the HTTP head and leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~') if url else name}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or the first record as raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, [r[:1 << 16] for r in records], k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return records[0][:DICTIONARY]


def archive_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive after another; a dictionary frame begins each."""
    records = iter(records)
    while first := [r for _, r in zip(range(TRAINED_ON), records)]:
        own = dictionary(first)
        compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own), write_checksum=True).compress
        yield struct.pack("<II", DICTIONARY_MAGIC, len(own)) + own
        total = 0
        for r in first:
            frame = compress(r)
            total += len(frame)
            yield frame
        while total < ARCHIVE_BYTES and (r := next(records, None)) is not None:
            frame = compress(r)
            total += len(frame)
            yield frame


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: name, url, payload, name of what a revisit refers to."""
    def records():
        for batch in batches:
            for name, url, payload, refers_to in zip(*batch.columns):
                yield record(name.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py())
    part, archive = TaskContext.get().partitionId(), -1
    for seq, frame in enumerate(archive_frames(records())):
        archive += frame[:4] == struct.pack("<I", DICTIONARY_MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{archive:04d}"]), pa.array([seq], pa.int64()), pa.array([frame], pa.binary())],
                                         ["archive", "seq", "frame"])


def write_archives(records: DataFrame, path: str) -> None:
    """``records(name, url, payload, refers_to)`` to archives below ``path``, one folder each."""
    frames = records.select("name", "url", F.col("payload").cast("binary"), "refers_to").mapInArrow(
        _write, "archive string, seq long, frame binary")
    frames = frames.sortWithinPartitions("archive", "seq").select("archive", F.col("frame").cast("string").alias("value"))
    frames.write.partitionBy("archive").option("lineSep", SEPARATOR).text(path)


def frames_of(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """Magic number and bytes of each frame, found from block headers without decompressing."""
    view, at = memoryview(data), 0
    while at < len(data):
        if at + 8 > len(data):
            raise BadRecord(f"archive ends inside a frame header at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + size
        elif magic == FRAME_MAGIC:
            head = bytes(view[at:at + 18])
            end = at + zstandard.frame_header_size(head)
            last = False
            while not last:
                if end + 3 > len(data):
                    raise BadRecord(f"archive ends inside the frame at {at}")
                block = int.from_bytes(view[end:end + 3], "little")
                last = bool(block & 1)
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += 4 * zstandard.get_frame_parameters(head).has_checksum
        else:
            raise BadRecord(f"no frame at {at}")
        if end > len(data):
            raise BadRecord(f"archive ends inside the frame at {at}")
        yield magic, view[at:end]
        at = end


def headers(lines: list[str]) -> dict[str, str]:
    """Values by lower-cased name; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            found[name] = f"{found[name]} {line.strip()}".strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _digest(labelled: str | None) -> tuple[str, bytes] | None:
    """Algorithm and value of ``name:value`` in base32 or hex; None for what cannot be checked."""
    name, _, value = (labelled or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    value = value.strip()
    return name, bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))


def _check(what: str, digest: tuple[str, bytes] | None, data: bytes) -> None:
    if digest and hashlib.new(digest[0], data).digest() != digest[1]:
        raise BadRecord(f"{what} differs from its length or digest")


def parse(raw: bytes) -> dict:
    """The fields of one record of any type; raises BadRecord where headers, lengths or digests are wrong.

    Names are read in any case. Only a response or revisit of HTTP has an HTTP head; its payload is what
    follows, that of another record the whole block. Lengths and digests are checked where they are
    given, but for a payload that is truncated or transfer-encoded. ``payload_digest`` is the SHA-1 of the
    payload, of a revisit the one that it states; a revisit has no payload here.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        raise BadRecord("no WARC header")
    fields = headers(lines[1:])
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name.lower() not in fields:
            raise BadRecord(f"no {name}")
    size, kind = int(fields["content-length"]), fields["warc-type"].lower()
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadRecord("record length differs from Content-Length")
    block = rest[:size]
    _check("block", _digest(fields.get("warc-block-digest")), block)
    payload, stated = block, None
    if kind in ("response", "revisit") and fields.get("content-type", "").lower().startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap and (kind == "response" or block):
            raise BadRecord("no HTTP head")
        http = headers(http.decode("latin-1").split("\r\n")[1:])
        stated = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        whole = "warc-truncated" not in fields and "transfer-encoding" not in http
        if kind == "response" and whole and stated not in (None, len(payload)):
            raise BadRecord("payload differs from its length or digest")
    digest = _digest(fields.get("warc-payload-digest"))
    if kind == "revisit":
        if not {"warc-refers-to", "warc-refers-to-target-uri"} & fields.keys():
            raise BadRecord("no WARC-Refers-To")
        own, length, payload = digest[1].hex() if digest and digest[0] == "sha1" else None, stated, None
    else:
        if "warc-truncated" not in fields:
            _check("payload", digest, payload)
        own, length = hashlib.sha1(payload).hexdigest(), len(payload)
    return {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
            "payload_bytes": length, "payload_digest": own, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
            "payload": payload, "error": None}


def _unpacked(frame: memoryview, dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    """What a frame holds; frames of streaming compressors do not say how much that is."""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(bytes(frame)) if dictionary else \
        zstandard.ZstdDecompressor().stream_reader(bytes(frame))
    data = reader.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise BadRecord(f"a record of more than {MOST_BYTES} bytes")
    return data


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive, with or without a dictionary frame at its start.

    A bad record, or the bad rest of an archive, is a row with only ``error``.
    """
    nothing = dict.fromkeys(c.split()[0] for c in RECORD.split(", "))
    own, begun = None, False
    try:
        for magic, frame in frames_of(data):
            if magic == DICTIONARY_MAGIC and not begun:
                content = bytes(frame[8:])
                if content[:4] == struct.pack("<I", FRAME_MAGIC):
                    content = _unpacked(memoryview(content), None)
                own = zstandard.ZstdCompressionDict(content)
            elif magic == FRAME_MAGIC:
                begun = True
                try:
                    yield parse(_unpacked(frame, own))
                except (ValueError, zstandard.ZstdError) as e:
                    yield nothing | {"error": str(e)}
    except (BadRecord, zstandard.ZstdError) as e:
        yield nothing | {"error": str(e)}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for r in read_archive(content.as_py()):
                rows.append(r)
                if len(rows) == 64:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below ``path``; at most two archives per Arrow batch."""
    arrow_rows(spark, 2)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, RECORD)


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id, digest, refers_to`` of pages whose payload a page with a larger id has too."""
    seen = stored(pages.filter("page_id is not null").select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
                  .filter(F.col("size") >= min_bytes).select("page_id", "digest"), "payload-digests")
    last = stored(seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "payload-groups")
    return seen.join(last, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def archive_pages(pages: DataFrame, path: str) -> None:
    """Archives of ``pages(page_id, url, html)`` below ``path``, a record for every row.

    A null html is an empty payload, a null url is replaced by the record's name. Rows with a null
    page_id, and rows that share the largest page_id of equal payloads, are all responses. Other
    columns are ignored. An empty table gives no archive.
    """
    arrow_rows(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    again = stored(revisits(pages), "revisits").toDF("_id", "_digest", "_to")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    joined = pages.join(again, (F.col("page_id") == F.col("_id")) & (F.sha1("payload") == F.col("_digest")), "left")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    write_archives(joined.select(name.alias("name"), "url", "payload", F.concat(F.lit("urn:page:"), F.col("_to")).alias("refers_to")), path)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of pages written as a record and read back; a null html is an empty payload."""
    path = work_path(spark, "archives")
    archive_pages(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    out = stored(records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                number("refers_to").alias("refers_to"), "error"), "records")
    arrow_rows(spark)
    return out


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to, NULL::VARCHAR AS error
FROM p LEFT JOIN g USING (payload_digest)
"""
