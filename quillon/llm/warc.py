"""WARC archives: write, normalise whole-file gzip to one member a record with an offset index, read back.

Crawlers and shell tools often leave an archive as one gzip stream, which can only be read from its start.  The
normaliser inflates such a stream once, in bounded pieces, writes every record as a gzip member of its own, and puts
an index beside the archive: one JSON line a record with its offset and length.  Readers then inflate any record
alone, and Spark divides an archive by its index.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, join_spread, materialize, scratch, table
from quillon.llm.shared_files import opened, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CHUNK = 1 << 20
#: Fast enough to stay cheap beside parsing; the digest covers the payload, not its compression.
LEVEL = 3


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{page_id}')}>"


def record_bytes(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None) -> bytes:
    """One WARC/1.1 record.  A revisit keeps the HTTP head, whose Content-Length is the full payload's, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {page_id}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(f: BinaryIO) -> Iterator[bytes]:
    """The pieces of a gzip file of one or more members, each piece at most CHUNK long."""
    engine = zlib.decompressobj(wbits=31)
    while data := f.read(CHUNK):
        while data:
            yield engine.decompress(data, CHUNK)
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(wbits=31)


def parse_head(head: bytes) -> dict[str, str]:
    """Named fields, names in lower case, the first line under an empty name."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record's fields and its bytes; no more than one record and one piece are held."""
    held = bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        while held[:2] == b"\r\n" or len(held) < 2:  # stray blank lines between records
            if held[:2] == b"\r\n":
                del held[:2]
            elif not more():
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                raise ValueError("the archive ends within a record head")
        fields = parse_head(bytes(held[:end]))
        if not fields[""].startswith("WARC/"):
            raise ValueError("not a WARC record")
        size = end + 4 + int(fields["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(held[:size])
        del held[:size]


def with_first_of_payload(rows: DataFrame, least_bytes: int) -> DataFrame:
    """rows (page, url, html) with response: for each page but the first of its payload, the id of that first page.

    Payloads are counted by digest before the shuffle, so one that a third of all pages share is one row a task.  Pages
    stay where they are while few payloads repeat; beyond that they are shuffled by id and digest, which no payload heats.
    """
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.to_binary(F.lit(""), F.lit("utf-8")))
    marked = rows.withColumns({"digest": F.sha1(payload), "bytes": F.length(payload)})
    counted = marked.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page").alias("response"), F.count("*").alias("n"))
    firsts = materialize(counted.where("n > 1"), "warc-repeated")
    revisit = F.when(F.col("page") > F.col("response"), F.col("response")).alias("response")
    if firsts.count() <= BROADCAST_ROWS:
        return marked.join(F.broadcast(firsts.drop("n")), ["digest", "bytes"], "left").select("page", "url", "html", revisit)
    total = firsts.agg(F.sum("n")).first()[0]
    again = join_spread(marked.select("page", "digest", "bytes"), firsts, ["digest", "bytes"], total).where("page > response").distinct()
    return marked.join(again, ["page", "digest", "bytes"], "left").select("page", "url", "html", "response")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write one record a page, one archive a task, each archive a single gzip stream; return a row per archive.

    Of pages with equal payloads of at least least_bytes bytes the one with the smallest id is a response, the others
    revisit it.  Page ids are integers.  Rows with one id are told apart by their payloads; of rows equal in both, all are
    responses if one is.  A null html is an empty payload; a null id is written as None and never a duplicate; a null
    url is left out.  Other columns are ignored.  An empty table gives no archive.
    """
    rows = with_first_of_payload(pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uri, n, engine = f"{folder}/raw-{TaskContext.get().partitionId():06d}.warc.gz", 0, zlib.compressobj(LEVEL, wbits=31)
        with written(uri) as f:
            for b in batches:
                for page, url, html, refers in zip(*(b[c].to_pylist() for c in ("page", "url", "html", "response"))):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    f.write(engine.compress(record_bytes(page, url, payload, payload_digest(payload), refers)))
                    n += 1
            f.write(engine.flush())
        yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [n]})

    return materialize(rows.mapInArrow(run, "uri string, records long"), "warc-written").where("records > 0")


def normalize_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member a record and an index beside it; return a row per archive.

    archives has a column uri.  The index, ``<archive>.idx``, has a JSON object a line: offset, length, type, id, uri.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b["uri"].to_pylist():
                target = f"{folder}/{source.rsplit('/', 1)[-1].replace('raw-', 'warc-')}"
                offset = n = 0
                with opened(source) as old, written(target) as new, written(f"{target}.idx") as index:
                    for fields, raw in records(inflated(old)):
                        engine = zlib.compressobj(LEVEL, wbits=31)
                        member = engine.compress(raw) + engine.flush()
                        new.write(member)
                        line = {"offset": offset, "length": len(member), "type": fields["warc-type"], "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri")}
                        index.write((json.dumps(line) + "\n").encode())
                        offset += len(member)
                        n += 1
                yield pa.RecordBatch.from_pydict({"uri": [target], "records": [n], "bytes": [offset]})

    spread = archives.select("uri").repartitionByRange(max(1, archives.count()), "uri")
    return materialize(spread.mapInArrow(run, "uri string, records long, bytes long"), "warc-normalized")


def read_archives(archives: DataFrame, batch: int = 2000) -> DataFrame:
    """Read normalised archives by their indexes: the index's lines are dealt out, and each task inflates its own records.

    Returned: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for a revisit).  A digest
    that does not fit its payload raises.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b["uri"].to_pylist():
                with opened(f"{uri}.idx") as f:
                    lines = [json.loads(x) for x in f.read().splitlines()]
                parts = [lines[i : i + batch] for i in range(0, len(lines), batch)]
                lengths = pa.array([[x["length"] for x in p] for p in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"uri": [uri] * len(parts), "offset": [p[0]["offset"] for p in parts], "lengths": lengths})

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "html": pa.string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, offset, lengths in zip(*(b[c].to_pylist() for c in ("uri", "offset", "lengths"))):
                rows = []
                with opened(uri) as f:
                    f.seek(offset)
                    for n in lengths:
                        rows.append(row_of(zlib.decompress(f.read(n), wbits=31)))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})

    n = max(1, archives.count())
    dealt = archives.select("uri").repartitionByRange(n, "uri").mapInArrow(ranges, "uri string, offset long, lengths array<long>")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    return dealt.repartitionByRange(n, "uri", "offset").mapInArrow(read, schema)


def row_of(raw: bytes) -> tuple:
    """A table row of one record's bytes."""
    end = raw.index(b"\r\n\r\n")
    fields = parse_head(raw[:end])
    block = raw[end + 4 : end + 4 + int(fields["content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    http, payload = parse_head(block[: cut - 4]), block[cut:]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    response = fields["warc-type"] == "response"
    if response and (payload_digest(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"{fields.get('warc-record-id')}: the payload is not the one written")
    number = lambda name: None if fields.get(name, "None") == "None" else int(fields[name])
    html = payload.decode("utf-8", "surrogatepass") if response else None
    return number("x-page-id"), fields.get("warc-target-uri"), int(http["content-length"]), digest, fields["warc-type"], number("x-refers-to-page-id"), html


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: pages written to archives, normalised, and read back."""
    folder = scratch(spark, "warc")
    written_ = write_archives(table(spark, sf_dir, "pages"), f"{folder}/raw")
    return read_archives(normalize_archives(written_, f"{folder}/normal")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha1(b), octet_length(b)) AS first FROM p),
x AS (SELECT *, list_transform(range(0, 40), lambda i: instr('0123456789abcdef', substr(h, CAST(i AS INTEGER) + 1, 1)) - 1) AS q FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(0, 5), lambda k:
      ((q[CAST((c * 5 + k) // 4 + 1 AS INTEGER)] >> CAST(3 - (c * 5 + k) % 4 AS INTEGER)) & 1) << CAST(4 - k AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM x
"""
