"""Web archives: a writer of one gzip member for each record, and a splittable reader (operator 10)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, new_path

MAGIC = b"\x1f\x8b\x08"
#: Payloads of at least so many bytes become revisits of an equal one.
REVISIT_BYTES = 1000
_RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def _member(body: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(body) + z.flush()


def _closing_zero(member: bytes) -> bytes:
    """The member, and an empty one after it if its last byte (the size's highest) is not zero."""
    return member if member[-1] == 0 else member + _member(b"")


def encode_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """A record in WARC 1.1; a revisit has the headers of the payload and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part, out = batch.slice(lo, 256), []
            for page, url, html, to in zip(*(c.to_pylist() for c in part.columns)):
                payload = html or b""
                member = _closing_zero(_member(encode_record(page, url, payload, to, hashlib.sha1(payload).hexdigest())))
                out.append(member[:-1])  # the writer's line end is the zero byte that is left out here
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write a record for each row (page_id, url, html) of pages, as gzip members one after another.

    Of rows with equal payloads of revisit_bytes or more that with the largest page_id is written in full and
    the others as revisits of it; rows that repeat that page_id as well are all written in full. A null html is
    an empty payload, a null url an empty one; a row without a page_id counts as the smallest. Only ids and
    digests are grouped; the payloads move once, by page_id. Spark's text writer puts the members' bytes out as
    they are: the byte that ends its lines is the last of each member, which is zero.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("html"))
    ids = rows.where(F.octet_length("html") >= revisit_bytes).select("page_id", F.sha1("html").alias("digest"))
    most = ids.groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).where("n > 1 and to is not null")
    to = ids.join(most, "digest").where("not page_id <=> to").select("page_id", "digest", "to").distinct()
    to = to.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "to")
    keyed = rows.withColumn("digest", F.sha1("html"))
    both = keyed.join(to, F.expr("page_id <=> p and digest = d"), "left").select("page_id", "url", "html", "to")
    members = both.mapInArrow(_encode, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


# ---------------------------------------------------------------- reading


def _decode(data: bytes) -> tuple[str, list[bytes]]:
    """('whole' | 'part' | 'bad', what each of its members decodes to)."""
    out: list[bytes] = []
    while data:
        z = zlib.decompressobj(31)
        try:
            got = z.decompress(data)
        except zlib.error:
            return "bad", out
        if got[:7] != b"WARC/1."[: len(got)]:
            return "bad", out
        if not z.eof:
            return "part", out
        out.append(got)
        data = z.unused_data
    return "whole", out


def parse_record(data: bytes) -> tuple | None:
    """One record's fields, as in the reader's columns; None for no bytes."""
    if not data:
        return None
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest.removesuffix(b"\r\n\r\n")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, size = fields.get("warc-type", ""), len(payload)
    if kind == "revisit":  # the payload is elsewhere; only its header tells the length
        told = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
        size = int(told) if told.isdigit() else size
    return (
        fields.get("warc-record-id", "").strip("<>"),
        kind,
        fields.get("warc-target-uri"),
        fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        size,
        None if kind == "revisit" else payload,
    )


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    cols = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _RECORD.split(", ")])


def _scan(fragments: bool):
    """Members of the byte ranges that a task has; or else the pieces of members that ranges cut apart.

    A range owns what starts in it, between one gzip magic and the next. Such a candidate is a member if its
    header decodes to a record. One that ends too early goes on behind a magic that stood in compressed data by
    chance; where the range ends first, the two pieces are put together afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, turn, rows, out, size = None, b"", 0, [], [], 0

        def close() -> None:
            nonlocal held
            if held:
                out.append((*here, turn, True, held))
                held = b""

        for batch in batches:
            for v, path, start in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v = v.as_py()
                if (path, start) != here:
                    close()
                    here, turn = (path, start), 0
                    if start == 0:  # before the first magic
                        if v:
                            raise ValueError(f"{path} doesn't begin with a gzip member")
                        continue
                turn += 1
                data = held + MAGIC + v
                kind, got = _decode(data)
                if kind == "whole":
                    held = b""
                    if not fragments:
                        rows += filter(None, map(parse_record, got))
                        size += sum(map(len, got))
                elif kind == "part":
                    held = data
                elif held:
                    raise ValueError(f"{path}: a member after byte {start} can't be decoded")
                else:
                    out.append((path, start, turn, False, data))
                if size > 4 << 20:
                    yield _columns(rows)
                    rows, size = [], 0
        close()
        if fragments and out:
            cols = list(zip(*out))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["path", "start", "turn", "head", "data"])
        elif rows and not fragments:
            yield _columns(rows)

    return run


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Put the pieces of one archive's cut members together, in the order of the file."""
    rows, held = [], b""
    for _, r in pdf.sort_values(["start", "turn"]).iterrows():
        held = bytes(r["data"]) if r["head"] and not held else held + bytes(r["data"])
        kind, got = _decode(held)
        if kind == "whole":
            held = b""
            rows += filter(None, map(parse_record, got))
        elif kind == "bad":
            raise ValueError(f"{r['path']}: a member near byte {r['start']} can't be decoded")
    if held:
        raise ValueError(f"{pdf['path'].iloc[0]}: the last member is cut short")
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _RECORD.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under path: record_id, record_type, target_uri, refers_to, payload_digest, payload_length, payload.

    Any file is cut into byte ranges (spark.sql.files.maxPartitionBytes), read through Spark's own file systems:
    the text scan, told that lines end with the gzip magic, hands each task the candidates that start in its
    range. Archives must not be named .gz, for then the scan would decode them whole. No archives give no rows;
    a member that can't be decoded raises.
    """
    bound_batches(spark)
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    raw = raw.select(F.col("value").cast("binary").alias("v"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    whole = raw.mapInArrow(_scan(False), _RECORD)
    cut = raw.mapInArrow(_scan(True), "path string, start long, turn long, head boolean, data binary")
    return whole.union(cut.groupBy("path").applyInPandas(_stitch, _RECORD))


def warc_query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    number = lambda c: F.expr(f"try_cast(nullif(substring({c}, 10), '') AS bigint)")  # noqa: E731  after urn:page:
    got = read_warc(spark, path)
    full = F.col("payload").isNotNull()
    return got.select(
        number("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d LEFT JOIN m USING (digest)
"""
