"""WARC archives: records written and read by Spark, and transactions put together again.

Writing goes through Spark's text writer, a record per line with CRLF CRLF as the line end, so each
task writes one `.gz` archive to any store that Spark knows. Reading splits archives at the start of
a record ("CRLF CRLF WARC/1.1 CRLF"), streams them record by record, and uses Content-Length to put
back a payload that itself holds such a line. A capture is a response (or a revisit, whose payload
is that of an earlier response) with the request and metadata records that name it, or name a record
that names it, in WARC-Concurrent-To.

Defined cases: a null payload is empty and a null url gives no target; control characters and spaces
in a url are percent-encoded; records with equal payloads of at least `revisit_from` bytes: the row
with the smallest page id is the response, all others revisit it (repeated rows of that id too, null
ids last); a capture lists one request and one metadata record, those with the smallest ids, and any
further one stands alone in a row with `surplus` true; records that name no response stand alone;
an empty table gives an archive without records; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_split_join, written

VERSION = "WARC/1.1"
_GAP = "\r\n\r\n"
_SPLIT = f"{_GAP}{VERSION}\r\n"


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\r\n", *parts)


def _field(name: str, value: Column) -> Column:
    """Null (left out by concat_ws) where the value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    s = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *s), F.lit(">"))


def _safe_url(url: Column) -> Column:
    u = url.cast("string")
    for c in ("\r", "\n", "\t", " "):
        u = F.replace(u, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return u


def choose_responses(pages: DataFrame, payload: Column, id_col: str, revisit_from: int) -> DataFrame:
    """(id, digest, first): rows whose payload has more than one holder, with the smallest id.

    Thin rows only. Digest groups are counted map-side; a payload that a large share of all pages has
    meets its rows by broadcast.
    """
    thin = pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= revisit_from)
    groups = written(thin.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "payload-groups")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    shared = groups.filter("rows > 1").withColumn("shared", F.lit(True))
    return hot_split_join(thin, shared, "digest", "rows", total).filter("shared").select("id", "digest", "first").distinct()


def page_records(pages: DataFrame, url: str = "url", payload: str = "html", id_col: str = "page_id", revisit_from: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The text of each record, three rows a page: response or revisit, request, metadata."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), _safe_url(F.col(url)).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    known = choose_responses(pages, body, id_col, revisit_from)
    # one shuffle moves the payloads: by id and digest, so null ids meet only with one body
    k = F.concat_ws(":", F.when(F.col("id").isNull(), "none").otherwise("id"), F.col("id").cast("string"), F.col("digest"))
    met = rows.withColumn("k", k).join(known.withColumn("k", k).select("k", "first", F.lit(True).alias("shared")), "k", "left")
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy("k")))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    own = _urn(F.lit("capture"), key, F.col("digest"), F.col("nth").cast("string"))
    first = _urn(F.lit("capture"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.col("digest"), F.lit("1"))
    is_first = ~F.col("shared") | (F.col("id").eqNullSafe(F.col("first")) & (F.col("nth") == 1))
    met = met.withColumns({"own": own, "revisits": F.when(~F.coalesce(is_first, F.lit(True)), first)})
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    plain = F.col("revisits").isNull()
    block = F.when(plain, F.concat(http, F.col("body").cast("string"))).otherwise(http)
    head = F.lit(VERSION)

    def record(kind: Column, rid: Column, extra: list[Column], media: str, content: Column) -> Column:
        fields = [head, _field("WARC-Type", kind), _field("WARC-Record-ID", rid), F.lit(f"WARC-Date: {date}"), _field("WARC-Target-URI", F.col("url")), *extra, F.lit(f"Content-Type: {media}"), _field("Content-Length", F.octet_length(content).cast("string"))]
        return F.concat(_lines(*fields), F.lit(_GAP), content)

    digest = _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    profile = F.when(~plain, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    response = record(F.when(plain, F.lit("response")).otherwise(F.lit("revisit")), F.col("own"), [digest, _field("WARC-Refers-To", F.col("revisits")), profile], "application/http; msgtype=response", block)
    to_response = _field("WARC-Concurrent-To", F.col("own"))
    asked = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract(F.col("url"), r"://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract(F.col("url"), r"://([^/?#]*)", 1), F.lit("")), F.lit("\r\n\r\n"))
    request = record(F.lit("request"), _urn(F.lit("request"), F.col("own")), [to_response], "application/http; msgtype=request", asked)
    noted = F.concat(F.coalesce(_field("source-key", F.col("id").cast("string")), F.lit("source-key:")), F.lit("\r\n"))
    metadata = record(F.lit("metadata"), _urn(F.lit("metadata"), F.col("own")), [to_response], "application/warc-fields", noted)
    return met.select(F.explode(F.array(response, request, metadata)).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    records.write.option("lineSep", _GAP).option("compression", "gzip").text(path)


def _parsed(raw: bytes) -> tuple[dict[str, list[str]], bytes]:
    head, _, content = raw.partition(b"\r\n\r\n")
    fields: dict[str, list[str]] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.decode("utf-8", "replace").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
    return fields, content


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: type, ids, links, digest, content type, and its block and payload."""
    raw = spark.read.option("lineSep", _SPLIT).text(path).select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A part that is shorter than its Content-Length goes on in the next part of its file."""
        held, held_file = None, None

        def record(raw: bytes) -> tuple | None:
            fields, content = _parsed(raw)
            size = int(fields.get("content-length", ["0"])[0])
            if len(content) < size:
                return None
            block = content[:size]
            one = lambda k: fields.get(k, [None])[0]
            payload = block.partition(b"\r\n\r\n")[2] if (one("content-type") or "").startswith("application/http") else block
            return one("warc-type"), one("warc-record-id"), one("warc-target-uri"), fields.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-payload-digest"), one("content-type"), payload

        names = ["type", "record_id", "target_uri", "concurrent_to", "refers_to", "payload_digest", "content_type", "payload"]
        for batch in batches:
            out = []
            for part, file in zip(batch["raw"], batch["file"], strict=True):
                if held is not None:
                    if file != held_file:
                        raise ValueError(f"{held_file}: a record ends before its Content-Length")
                    part = held + _SPLIT.encode() + part
                if not part.strip():
                    held = None
                    continue
                done = record(part)
                held, held_file = (part, file) if done is None else (None, None)
                if done is not None:
                    out.append(done)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held is not None:
            raise ValueError(f"{held_file}: a record ends before its Content-Length")

    return raw.mapInPandas(whole, "type string, record_id string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, content_type string, payload binary")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata, surplus).

    Links are followed in either direction and over one record between (metadata that names the
    request that names the response). Only ids are joined to find a record's capture; where several
    fit, the smallest id. One payload-carrying join per kind follows, and columns that the caller
    does not select are pruned before it.
    """
    fields = records.columns
    main = records.filter(F.col("type").isin("response", "revisit")).select(F.struct(*fields).alias("response"), F.col("record_id").alias("capture_id"))
    other = records.filter(F.col("type").isin("request", "metadata"))
    named = records.select("record_id", "type", F.explode("concurrent_to").alias("to"))
    both = named.select("record_id", "to").unionByName(named.select(F.col("to").alias("record_id"), F.col("record_id").alias("to"))).distinct()
    anchors = main.select(F.col("capture_id").alias("to"), F.col("capture_id").alias("anchor"))
    direct = both.join(anchors, "to").groupBy("record_id").agg(F.min("anchor").alias("anchor"))
    between = both.join(direct.withColumnRenamed("record_id", "to"), "to").groupBy("record_id").agg(F.min("anchor").alias("anchor"))
    found = direct.withColumn("hop", F.lit(1)).unionByName(between.withColumn("hop", F.lit(2))).groupBy("record_id").agg(F.min(F.struct("hop", "anchor")).alias("_a")).select("record_id", F.col("_a.anchor").alias("anchor"))
    placed = other.join(found, "record_id", "left").withColumn("nth", F.row_number().over(Window.partitionBy(F.coalesce("anchor", "record_id"), "type").orderBy("record_id")))

    def first(kind: str) -> DataFrame:
        return placed.filter((F.col("type") == kind) & F.col("anchor").isNotNull() & (F.col("nth") == 1)).select(F.col("anchor").alias("capture_id"), F.struct(*fields).alias(kind))

    whole = main.join(first("request"), "capture_id", "left").join(first("metadata"), "capture_id", "left").withColumn("surplus", F.lit(False))
    alone = placed.filter(F.col("anchor").isNull() | (F.col("nth") > 1))
    kind = whole.schema["response"].dataType
    none = F.lit(None).cast(kind)
    rest = alone.select(
        F.coalesce("anchor", "record_id").alias("capture_id"),
        none.alias("response"),
        F.when(F.col("type") == "request", F.struct(*fields)).otherwise(none).alias("request"),
        F.when(F.col("type") == "metadata", F.struct(*fields)).otherwise(none).alias("metadata"),
        F.col("anchor").isNotNull().alias("surplus"),
    )
    return whole.select("capture_id", "response", "request", "metadata", "surplus").unionByName(rest)


def digest_payloads(records: DataFrame) -> DataFrame:
    """records with `payload_bytes` and `payload_sha256` of what was read; only metadata keep their
    payload. What is left is thin enough to be joined again and again."""
    p = F.col("payload")
    return records.withColumns({"payload_bytes": F.octet_length(p).cast("long"), "payload_sha256": F.sha2(p, 256), "payload": F.when(F.col("type") == "metadata", p)})


def source_key(metadata_payload: Column) -> Column:
    return F.nullif(F.regexp_extract(metadata_payload.cast("string"), r"source-key: ?([^\r\n]*)", 1), F.lit(""))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """captures with the `origin` of each revisit: the response's bytes, digest and source key.

    Only responses that some revisit names are joined, thin; those that many revisits name meet them
    by broadcast.
    """
    rows = captures.withColumn("_to", F.col("response.refers_to"))
    named = written(rows.filter("_to is not null").groupBy("_to").agg(F.count("*").alias("_revisits")), "named")
    total = captures.count()
    origin = captures.filter("response.type = 'response'").select(
        F.col("capture_id").alias("_to"),
        F.struct(F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha256").alias("payload_sha256"), source_key(F.col("metadata.payload")).alias("key")).alias("origin"),
    )
    met = hot_split_join(rows.filter("_to is not null"), named.join(origin, "_to", "left"), "_to", "_revisits", total)
    plain = rows.filter("_to is null").withColumn("origin", F.lit(None).cast(met.schema["origin"].dataType))
    return met.unionByName(plain).drop("_to")
