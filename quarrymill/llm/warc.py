"""WARC archives: writing, reading, and resolving repeated payloads to revisit records.

``write_archives`` writes one response record a page. ``read_headers`` streams the records of a folder of archives and
keeps headers only. ``dedup_archives`` shuffles these headers by payload digest (pre-aggregated, so a digest that a third
of all records share is one row for each task), picks each digest's response, and writes new archives in which the other
records are revisit records with fresh headers. ``resolve`` joins revisit records back to their responses. In both joins the
digests and responses that many records share are broadcast, a bounded number of rows, and only the others go by shuffle.

Archives are gzip files written by Spark's text writer, so they may lie in any store that Spark writes, and a lost
executor's files are written again by the commit protocol.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, new_path, small_batches, written

#: Payloads below this many bytes are never replaced by a revisit record; records in one archive file at most.
LEAST_BYTES, FILE_RECORDS = 1000, 2000
#: Fixed values of the WARC 1.1 format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADERS = "record_id string, page_id long, type string, uri string, date string, digest string, payload_bytes long, refers_to string"


def _lines(*pairs) -> F.Column:
    """Header lines, without those whose value is null, ended by an empty line."""
    return F.concat(F.array_join(F.array_compact(F.array(F.lit(VERSION), *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])), "\r\n"), F.lit(END))


def _http(payload_bytes) -> F.Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), payload_bytes.cast("string"), F.lit(END))


def _save(records: DataFrame, path: str) -> str:
    records.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def _record(df: DataFrame) -> DataFrame:
    """Record text of rows of HEADERS and payload (null in revisit records)."""
    http = _http(F.col("payload_bytes"))
    block = F.concat(http, F.coalesce(F.col("payload"), F.lit("")))
    is_revisit = F.col("type") == "revisit"
    head = _lines(
        ("WARC-Type", F.col("type")), ("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))), ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.col("uri")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")),
    )
    return df.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None, date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes a response record for each row of ``pages`` (page_id, url, html); the folder's path is returned.

    A null html is an empty payload, a null url an empty URI, a null page_id one that is absent from the record id. Line
    breaks in a URL are dropped. Rows with one page_id are separate records; other columns are left out.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.concat_ws(":", F.lit("urn:x-page"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.monotonically_increasing_id().cast("string")).alias("record_id"),
        F.lit("response").alias("type"), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "").alias("uri"), F.lit(date).alias("date"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("refers_to"), html.alias("payload"),
    )
    return _save(_record(rows), path or new_path(pages.sparkSession, "warc-raw"))


def _field(head: dict, name: str) -> str | None:
    x = head.get(name)
    return x.strip("<>") if x is not None else None


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict, bytes, bytes]]:
    """(headers, HTTP headers, payload) of each record of archives, given as what stands between the ENDs of their unpacked bytes.
    No more than one record and one piece is held."""
    end = END.encode()
    buf = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        buf.extend(piece)
        buf.extend(end)
        return True

    while True:
        del buf[: len(buf) - len(buf.lstrip(b"\r\n"))]
        cut = buf.find(end)
        if cut < 0:
            if not more():
                return
            continue
        head = dict(x.split(": ", 1) for x in buf[:cut].decode().split("\r\n")[1:])
        at, size = cut + len(end), int(head["Content-Length"])
        while len(buf) < at + size and more():
            pass
        block = bytes(buf[at : at + size])
        del buf[: at + size]
        cut = block.find(end) + len(end)
        yield head, block[:cut], block[cut:]


def _parse(with_payload: bool):
    names = [x.split()[0] for x in HEADERS.split(", ")]

    def parse(batches):
        out, held = [], 0
        pieces = (x.as_buffer().to_pybytes() for batch in batches for x in batch.column("value").cast(pa.binary()))
        for head, http, payload in parse_records(pieces):
            rid = _field(head, "WARC-Record-ID")
            page = rid.split(":")[2]
            size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
            out.append((rid, int(page) if page else None, head["WARC-Type"], head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Payload-Digest"].partition(":")[2], size, _field(head, "WARC-Refers-To"), *([payload] if with_payload else [])))
            held += len(payload) if with_payload else 200
            if held > 4 << 20:
                yield _batch(out, names, with_payload)
                out, held = [], 0
        if out:
            yield _batch(out, names, with_payload)

    return parse


def _batch(rows, names, with_payload):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names + ["payload"] * with_payload)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record of the archives in ``path``: the columns of HEADERS, and the payload (binary) if asked for.

    Archives are unpacked by Spark's text reader, cut at each END, and put together again record by record, so a file may have any
    size and any number of gzip members; bytes stay as they are.
    """
    small_batches(spark)
    pieces = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", END).text(path)
    return pieces.mapInArrow(_parse(payload), HEADERS + ", payload binary" * payload)


def revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(record_id, to_id) of the records that become revisits: of equal payloads of ``least_bytes`` or more, all but
    that with the largest page_id (then the largest record id). ``headers`` is read twice: hand over a written table."""
    key = F.concat_ws("-", "digest", F.col("payload_bytes").cast("string")).alias("same")
    large = headers.filter(F.col("payload_bytes") >= least_bytes).select(key, "page_id", "record_id")
    first = large.groupBy("same").agg(F.max(F.struct("page_id", "record_id"))["record_id"].alias("to_id"), F.count("*").alias("n")).filter("n > 1")
    both = hot_join(large.select("same", "record_id"), written(first, "warc-firsts"), "same", "n")
    return both.filter(F.col("record_id") != F.col("to_id")).select("record_id", "to_id")


def dedup_archives(spark: SparkSession, path: str, to: str | None = None, least_bytes: int = LEAST_BYTES) -> str:
    """Writes the archives of ``path`` anew, repeated payloads as revisit records; the new folder's path is returned."""
    links = revisits(written(read_archives(spark, path), "warc-headers"), least_bytes)
    both = read_archives(spark, path, payload=True).drop("refers_to").join(links, "record_id", "left")
    both = both.withColumn("type", F.when(F.col("to_id").isNotNull(), "revisit").otherwise(F.col("type")))
    both = both.withColumn("payload", F.when(F.col("to_id").isNull(), F.decode("payload", "UTF-8")))
    return _save(_record(both.withColumnRenamed("to_id", "refers_to")), to or new_path(spark, "warc-dedup"))


def resolve(records: DataFrame) -> DataFrame:
    """HEADERS and refers_to_page: the page of the response to which a revisit record's own refers_to leads (else null). ``records`` has
    headers only; it is written once."""
    records = written(records, "warc-records")
    plain = records.filter("type = 'response'").withColumn("refers_to_page", F.lit(None).cast("long"))
    again = records.filter("type = 'revisit'")
    asked = again.groupBy("refers_to").agg(F.count("*").alias("n"))
    responses = records.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_to_page"))
    found = written(asked.join(responses, "refers_to"), "warc-responses")
    return hot_join(again, found, "refers_to", "n", "left").select(*plain.columns).unionByName(plain)
