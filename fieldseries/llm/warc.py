"""WARC archives: written by Spark's text writer, read by a Python data source.

The source plans groups of files, takes predicates on record type and headers, parses
each record's headers first, and steps over payloads that no predicate or option asks for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from fieldseries.operators.materialize import materialize

#: Pages whose payloads are at least this long refer to an equal one instead of repeating it.
MIN_REVISIT_BYTES = 100
#: Revisits of at most this number are broadcast.
MAX_BROADCAST = 200_000
#: Bytes of files that one task reads; a larger file is one task.
GROUP_BYTES = 32_000_000
_BATCH_BYTES = 4_000_000
_FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
    "payload_length": "x-payload-length",
}
SCHEMA = ", ".join(f"{c} string" for c in _FIELDS) + ", content_length long, payload binary"


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record for each row: a response with the payload, or a revisit of an equal payload.

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes the one with the
    least id is the response. A null payload is empty. White space and control characters
    of a URL are escaped; a null URL is empty. Rows that repeat an id and payload are
    all responses if one is; a null id is written as an empty one and is always a response.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digests = rows.select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).where(f"id is not null and n >= {MIN_REVISIT_BYTES}")
    first = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    revisits = digests.join(first, "digest").where("id <> first").select("id", F.xxhash64("digest").alias("key"), "first").distinct()
    # three numbers a revisit: few enough go to where the payloads are, more are joined by key
    revisits = materialize(revisits)
    if revisits.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        revisits = F.broadcast(revisits)
    keyed = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.xxhash64("digest"))
    joined = keyed.join(revisits, ["id", "key"], "left")
    again = F.col("first").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7f]", "%20")

    def urn(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))

    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.octet_length("payload")).cast("string")),
    )
    record = F.concat(head, F.lit("\r\n\r\n"), F.when(again, F.lit("")).otherwise(F.col("payload")))
    # a record ends with two line ends, which is this writer's line separator
    joined.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payload`` = false skips all payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options, schema.fieldNames())


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"]
        self.columns = columns
        self.payload = options.get("payload", "true").lower() != "false" and "payload" in columns
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality, membership, prefix and presence tests on header columns; leave the others to Spark."""
        kinds = {EqualTo: "equal", In: "in", StringStartsWith: "prefix", IsNotNull: "present"}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if type(f) in kinds and column in _FIELDS:
                self.tests.append((_FIELDS[column], kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        files, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        found = files.get_file_info(pafs.FileSelector(root)) if files.get_file_info(root).type == pafs.FileType.Directory else [files.get_file_info(root)]
        groups, size = [[]], 0
        for info in sorted(found, key=lambda x: x.path):
            if info.type != pafs.FileType.File or info.base_name.startswith(("_", ".")) or not info.size:
                continue
            if groups[-1] and size + info.size > GROUP_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(info.path)
            size += info.size
        return [_Files(g) for g in groups]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            have = headers.get(name)
            if have is None or kind == "equal" and have != value or kind == "in" and have not in value or kind == "prefix" and not have.startswith(value):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        files = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pafs.LocalFileSystem()
        rows, size = [], 0
        for path in partition.paths if partition else []:
            with files.open_input_file(path) as raw:
                for headers, length, body in records(raw, self.wanted, self.payload):
                    rows.append((headers, length, body))
                    size += len(body or b"") + 1000
                    if size > _BATCH_BYTES:
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list) -> pa.RecordBatch:
        made = {c: pa.array([h.get(k) for h, _, _ in rows], pa.string()) for c, k in _FIELDS.items()}
        made["content_length"] = pa.array([n for _, n, _ in rows], pa.int64())
        made["payload"] = pa.array([b for _, _, b in rows], pa.binary())
        return pa.RecordBatch.from_arrays([made[c] for c in self.columns], names=self.columns)


_END = re.compile(rb"\r?\n\r?\n")


def records(raw, wanted, payload: bool) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """Headers, content length and, if asked for, payload of the wanted records of an open file.

    The file is read in blocks; the payload of an unwanted record is neither copied nor
    decoded, and a long one is stepped over in the file.
    """
    held, at, done = b"", 0, False

    def more(least: int) -> None:
        nonlocal held, at, done
        parts, have = [held[at:]], len(held) - at
        while have < least and not done:
            block = raw.read(max(1 << 20, least - have))
            done = not block
            parts.append(block)
            have += len(block)
        held, at = b"".join(parts), 0

    while True:
        while not done and len(held) - at < 8:
            more(8)
        while at < len(held) and held[at] in b"\r\n":
            at += 1
            if at == len(held) and not done:
                more(1)
        if at >= len(held) and done:
            return
        need = 1 << 16
        while not (end := _END.search(held, at)):
            if done:
                raise ValueError("a WARC record without the end of its headers")
            more(need)
            need *= 2
        lines = held[at : end.start()].decode("utf-8").splitlines()
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length, at = int(headers.get("content-length", 0)), end.end()
        take = wanted(headers)
        if len(held) - at < length:
            if take and payload:
                more(length)
            else:
                raw.seek(raw.tell() + length - (len(held) - at))
                held, at = b"", 0
                if take:
                    yield headers, length, None
                continue
        if take:
            yield headers, length, held[at : at + length] if payload else None
        at += length


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives in a folder: header columns, ``content_length`` and ``payload``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
