"""WARC archives with revisit resolution.

Headers (payload digest and page_id) are shuffled by digest, with a partial maximum
before the shuffle; digests seen once need nothing more.  A bitmap of the others' digests
tells which records they may be, so that all other payloads stay where they are; the
rest is joined to the winners: the record of the largest page_id is the response, the
others become revisit records that refer to it.  Archives are written by Spark's text
writer, whose line separator is the blank line that ends a WARC record, so they can go to
any file system that Spark writes to; each is a sequence of records with fresh headers
(date of writing, record ids of their own), gzip around the whole file.

Reading goes by Content-Length, so payloads may hold anything, even WARC records.  An
archive that ends inside a record is an error, and :func:`write` says how many records it wrote.

NULL html is the empty payload.  Records of equal payload and equal page_id that
share the largest page_id (ties, repeated rows) are all responses, as are records without
page_id of a payload that no record with page_id has.  A NULL url is the empty one.  Empty tables
give empty archives.  Very long payloads are one record each.  Extra columns, whatever they are named, don't
go into the archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, small_batches, stage

END = "\r\n\r\n"
NEXT = END + "WARC/1.0\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 4 digits for each 5 hex digits."""
    hexa = F.sha1(payload)
    four = [F.lpad(F.conv(F.substring(hexa, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, id_col: str = "page_id", payload: str = "html", min_bytes: int = 0, url: str = "url") -> DataFrame:
    """The id, the url, _payload, _bytes, _digest, _refers_to (NULL: a response) and _alone (no
    other response has its digest and page_id)."""
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    full = pages.select(*dict.fromkeys((id_col, url)), F.col(payload)).withColumn("_payload", text).withColumn("_bytes", F.octet_length("_payload").cast("long")).withColumn("_digest", base32_sha1(F.col("_payload").cast("binary")))
    full = full.select(id_col, url, "_payload", "_bytes", "_digest", F.xxhash64("_digest").alias("_key"))
    heads = full.where(F.col("_bytes") >= min_bytes).groupBy("_digest", F.col(id_col).alias("_id")).agg(F.count("*").alias("_k"))
    best = F.max(F.when(F.col("_id").isNotNull(), F.struct("_id", "_k")))
    winners = heads.groupBy("_digest").agg(best.alias("_w"), F.sum("_k").alias("_n")).where("_n > 1 AND _w IS NOT NULL")
    winners = stage(winners.select("_digest", F.col("_w._id").alias("_best"), F.col("_w._k").alias("_times")), "winners")
    clear, doubt = apart(full, "_key", winners.select(F.xxhash64("_digest").alias("_key")))
    other = (F.col("_bytes") >= min_bytes) & F.col("_best").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_best"))
    alone = F.col(id_col).isNotNull() & (F.col("_bytes") >= min_bytes)
    met = doubt.join(winners, "_digest", "left").withColumn("_refers_to", F.when(other, F.col("_best"))).withColumn("_alone", alone & (F.coalesce("_times", F.lit(1)) == 1))
    clear = clear.withColumn("_refers_to", F.lit(None).cast(pages.schema[id_col].dataType)).withColumn("_alone", alone)
    names = [id_col, url, "_payload", "_bytes", "_digest", "_refers_to", "_alone"]
    return clear.select(*names).unionByName(met.select(*names))


def _clean(c: Column) -> Column:
    """A header value: one line."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")


def write(resolved: DataFrame, path: str, id_col: str = "page_id", url: str = "url", date: str | None = None) -> int:
    """Write the archives, one pass over the records, and return how many: a response has its
    payload, a revisit an empty block and WARC-Refers-To.  ``date``: of all records, for archives
    that are to be made again alike; else the moment of writing.

    A response's record id comes from its digest and page_id, so that revisits know it; repeated
    responses and revisits have random ones."""
    uuid = lambda h: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    known = lambda c: uuid(F.md5(F.concat_ws(" ", F.col("_digest"), c.cast("string")).cast("binary")))
    page = lambda c: F.coalesce(_clean(c), F.lit(""))
    revisit = F.col("_refers_to").isNotNull()
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.when(~revisit & F.col("_alone"), known(F.col(id_col))).otherwise(uuid(F.translate(F.expr("uuid()"), "-", "")))),
        F.concat(F.lit("WARC-Date: "), when),
        F.when(F.col(id_col).isNotNull(), F.concat(F.lit("X-Page-Id: "), page(F.col(id_col)))),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col(url))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("_bytes").cast("string")),
        F.when(revisit, F.concat_ws("\r\n", F.concat(F.lit("WARC-Refers-To: "), known(F.col("_refers_to"))), F.concat(F.lit("X-Refers-To-Page: "), page(F.col("_refers_to"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("_bytes").cast("string"))),
    )
    block = F.when(revisit, "").otherwise(F.col("_payload"))
    seen = Observation()
    rows = resolved.select(F.concat(head, F.lit(END), block).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.option("lineSep", END).option("compression", "gzip").text(path)  # gzip isn't split in reading
    return seen.get["n"]


RECORD = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("sound", T.BooleanType()),
])


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives at ``path``: ``RECORD`` and, if asked for, the payload
    (binary).  ``sound``: a response's payload has the digest and length of its headers.

    Archives are read as streams (gzip isn't split), a record at a time: what lies
    between two record starts is joined until Content-Length is reached.  It is an error if an
    archive ends before."""
    schema = T.StructType([*RECORD.fields, T.StructField("payload", T.BinaryType())]) if payload else RECORD

    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa

        def records(pieces):
            """(headers, block) of each record of one task's files, in order."""
            at, held, need = None, [], None

            def whole():
                if need is not None:
                    raise ValueError(f"{at} ends inside a record: {need} bytes are missing")

            for file, piece in pieces:
                if file != at:
                    whole()
                    need = None
                if need is not None:  # the payload itself has a record's start
                    held += [NEXT.encode(), piece]
                    need -= len(NEXT) + len(piece)
                    if need > 0:
                        continue
                    piece = b"".join(held)
                at, held = file, [piece]
                piece = piece.removeprefix(b"WARC/1.0\r\n")
                head, found, block = piece.partition(END.encode())
                if not found or b"Content-Length: " not in head:
                    raise ValueError(f"{at} has a record without whole headers")
                fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n") if b": " in x)
                size = int(fields[b"Content-Length"])
                need = size - len(block) if len(block) < size else None
                if need is None:
                    yield fields, block[:size]
            whole()

        def pieces():
            for b in batches:
                yield from zip(b.column(1).to_pylist(), b.column(0).cast(pa.binary()).to_pylist(), strict=True)

        def flush(rows):
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        arrow = pa.schema([("record_type", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("sound", pa.bool_())] + [("payload", pa.binary())] * payload)
        rows, held = [], 0
        ident = lambda v: None if v is None else v.decode()
        for f, block in records(pieces()):
            response = f[b"WARC-Type"] != b"revisit"
            digest = f[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
            n = int(f[b"X-Payload-Length"])
            rows.append({
                "record_type": "response" if response else "revisit", "page_id": ident(f.get(b"X-Page-Id")), "url": f[b"WARC-Target-URI"].decode(), "payload_bytes": n,
                "payload_digest": digest, "refers_to": ident(f.get(b"X-Refers-To-Page")),
                "sound": len(block) == n and base64.b32encode(hashlib.sha1(block).digest()).decode() == digest if response else not block,
            } | ({"payload": block if response else None} if payload else {}))
            held += len(block) if payload else 100
            if held > 4_000_000:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)

    small_batches(spark)
    lines = spark.read.option("lineSep", NEXT).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file")).mapInArrow(run, schema)
