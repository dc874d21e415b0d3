"""WARC archives: write them, normalise monolithic gzip files, and read them back by their offset index.

The writer puts each partition's records into one or more archives, each a single gzip stream over the whole file as
careless crawlers leave it. The normaliser inflates such a stream once, from front to back, writes every record as a
gzip member of its own into a new archive, and a sidecar index beside it: one line of JSON for each record with offset,
length, type and id. The reader seeks to each indexed member and inflates that alone. Memory holds one record at a
time. Files are written under an attempt's own name and then moved, so lost and repeated tasks leave whole files.

Payloads of at least MIN_REVISIT bytes that occur again are stored once: the smallest page_id is the response, the
others are revisits that refer to it.

Which record is the response is decided on ids and digests alone; payloads stay where they were read and meet the
decision there, so a frequent page's payload is never moved to one task.

Defined cases: null html is an empty payload; a null url has no target header; rows that share both page_id and
payload are responses each if theirs is the smallest id; null page_ids count as larger than any; an empty table gives
an empty result. Other columns, whatever their names, don't enter the archives and don't matter.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import by_task, numbered, open_fs, put_file, remove_path, shared_path, spread_join, table, written

MIN_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to (null for responses)."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    rows, part, unit = numbered(rows, "warc-pages")
    narrow = rows.select(F.col(unit).alias("unit"), "page_id", "payload_digest", (F.col("payload_bytes") >= MIN_REVISIT).alias("long"))
    again = narrow.where("long").groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("long") & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    decided = spread_join(narrow, again, ["payload_digest"], "unit", "left").select("unit", refers.alias("d"))
    return by_task(rows, part, unit, decided, "refers_to").select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")


def encode_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: its headers, then an HTTP head and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, raw record) of each record of an inflated stream, holding one record at a time."""
    buffer = bytearray()
    chunks = iter(chunks)

    def fill(size: int) -> bool:
        while len(buffer) < size:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while True:
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("the archive ends within a record's headers")
                return
            end = buffer.find(b"\r\n\r\n", 0)
        headers = parse_head(bytes(buffer[:end]))
        size = end + 4 + int(headers["content-length"]) + 4
        if not fill(size):
            raise ValueError("the archive ends within a record")
        raw = bytes(buffer[:size])
        del buffer[:size]
        yield headers, raw


def inflate(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The inflated chunks of a gzip stream of one or several members, each chunk of bounded size."""
    decoder = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            yield decoder.decompress(data, 4 * size)
            data = decoder.unconsumed_tail
            if decoder.eof:
                data = decoder.unused_data
                decoder = zlib.decompressobj(31)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic archives into a shared folder; a row for each: archive, records."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), []
        rows = (r for pdf in frames for r in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["payload_digest"], pdf["refers_to"]))
        missing = lambda x: None if pd.isna(x) else int(x)
        row = next(rows, None)
        while row is not None:
            name, n = f"{folder}/part-{part:06d}-{len(made):04d}.warc.gz", 0

            def write(out):
                nonlocal row, n
                size = 0
                with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as stream:
                    while row is not None and size < archive_bytes:
                        record = encode_record(missing(row[0]), row[1], bytes(row[2]), row[3], missing(row[4]))
                        stream.write(record)
                        size, n, row = size + len(record), n + 1, next(rows, None)

            put_file(name, write)
            made.append((name, n))
        yield pd.DataFrame(made, columns=["archive", "records"])

    whole = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "payload_digest", F.col("refers_to").cast("string").alias("refers_to"))
    return written(whole.mapInPandas(run, "archive string, records long"), "warc-list")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a member for each record, and a sidecar index; a row for each: archive, index, records."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for source in pdf["archive"]:
                target = f"{folder}/{source.rsplit('/', 1)[1]}"
                lines: list[str] = []

                def write(out):
                    system, path = open_fs(source)
                    at = 0
                    with system.open_input_stream(path, compression=None) as stream:
                        for headers, raw in read_records(inflate(stream)):
                            member = gzip.compress(raw, mtime=0)
                            out.write(member)
                            lines.append(json.dumps({"offset": at, "length": len(member), "type": headers["warc-type"], "id": headers["warc-record-id"]}))
                            at += len(member)

                put_file(target, write)
                put_file(f"{target}.idx", lambda out: out.write(("\n".join(lines) + "\n").encode()))
                made.append((target, f"{target}.idx", len(lines)))
            yield pd.DataFrame(made, columns=["archive", "index", "records"])

    n = archives.count()
    dealt = archives.repartition(max(1, n), "archive")
    return written(dealt.mapInPandas(run, "archive string, index string, records long"), "warc-normal")


def read_archives(normal: DataFrame) -> DataFrame:
    """A row for each record, read through the sidecar index: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""

    def number(urn: str | None):
        value = urn[len("<urn:page:") : -1] if urn else "None"
        return None if value == "None" else int(value)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for archive, index in zip(pdf["archive"], pdf["index"]):
                system, path = open_fs(index)
                with system.open_input_stream(path) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines() if x]
                system, path = open_fs(archive)
                rows, held = [], 0
                with system.open_input_file(path) as f:
                    for e in entries:
                        raw = gzip.decompress(f.read_at(e["length"], e["offset"]))
                        end = raw.index(b"\r\n\r\n")
                        headers = parse_head(raw[:end])
                        block = raw[end + 4 : end + 4 + int(headers["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = headers["warc-payload-digest"].split(":")[1], headers["warc-type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{archive}: the payload at {e['offset']} doesn't have its digest")
                        size = int(parse_head(http)["content-length"])
                        rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), payload if kind == "response" else None, size, digest, kind, number(headers.get("warc-refers-to"))))
                        held += len(payload)
                        if held > 16 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    return normal.repartition(max(1, normal.count()), "archive").mapInPandas(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as monolithic archives, normalise them (the originals go) and read the records back."""
    spark: SparkSession = pages.sparkSession
    rough, fine = shared_path(spark, "warc-monolithic"), shared_path(spark, "warc")
    archives = write_archives(plan_records(pages), rough)
    normal = normalise(archives, fine)
    remove_path(spark, rough)
    return read_archives(normal)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""
