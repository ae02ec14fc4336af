"""WARC records, and the resolution of not-modified revisits.

A revisit record of a 304 answer has headers and no body.  It stands for the
latest earlier full response to the same canonical URL, if that has the
validators which the revisit names; the response's headers are then updated by
those that a 304 may carry.

The as-of join is two windows.  Time is cut into buckets: within a URL's bucket
the last response before each record, and over the buckets, one row each, what
the earlier ones end with.  A URL that a third of all captures are of is thus
spread over its buckets.  Only ids and validators take part; headers and bodies
follow by an equi-join on the record id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.scratch import Scratch

#: Headers by which a 304 answer updates the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
BUCKET_SECONDS = 86400
#: Bytes that are inflated at a time, of the longest header, and of blocks after which rows are handed on.
CHUNK, HEADER, HELD = 1 << 18, 1 << 16, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(data) -> Iterator[bytes]:
    """The content of a file, inflated member by member if gzipped, in chunks; ends at the first damage."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), CHUNK):
            yield bytes(view[at : at + CHUNK])
        return
    at = 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            some = bytes(view[at : at + CHUNK])
            if not some:
                return
            at += len(some)
            try:
                while some and not member.eof:
                    yield member.decompress(some, CHUNK)
                    some = member.unconsumed_tail
            except zlib.error:
                return
        at -= len(member.unused_data)


class _Reader:
    """What is read ahead of a stream of chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def more(self) -> bool:
        some = next(self.chunks, None)
        if some is not None:
            self.held += some
        return some is not None

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What stands before the mark, which is skipped; null if it does not come within ``most`` bytes."""
        seen = 0
        while True:
            at = self.held.find(mark, max(0, seen - len(mark)))
            if at >= 0:
                out = bytes(self.held[:at])
                del self.held[: at + len(mark)]
                return out
            seen = len(self.held)
            if seen > most or not self.more():
                return None

    def skip_to(self, mark: bytes) -> bool:
        """Forward to the mark, at the beginning of a line."""
        before = b"\n"
        while True:
            at = 0
            while (at := self.held.find(mark, at)) >= 0:
                if (self.held[at - 1 : at] if at else before) == b"\n":
                    del self.held[:at]
                    return True
                at += 1
            drop = max(0, len(self.held) - len(mark))
            if drop:
                before = bytes(self.held[drop - 1 : drop])
                del self.held[:drop]
            if not self.more():
                return False

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            if not self.more():
                return None
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_records(data) -> Iterator[dict]:
    """The records of a WARC file, gzipped or not: ``headers`` (names in lower case) and ``block``.

    One record is held at a time.  A header without an end or without a length
    in digits is passed over; a record that the end of the file, or damage to
    its compression, cuts short is not returned, nor what follows.
    """
    reader = _Reader(_plain(data))
    while reader.skip_to(b"WARC/"):
        head = reader.until(b"\r\n\r\n", HEADER)
        if head is None:
            reader.take(1)
            continue
        headers = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit() and len(size) < 16):
            continue
        block = reader.take(int(size))
        if block is None:
            return
        yield {"headers": headers, "block": block}


def format_record(headers: dict[str, str], block: bytes) -> bytes:
    """One record; the length is added."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``binaryFile`` rows -> ``(record_id, type, url, ts, status, headers, body)``.

    ``headers`` are the HTTP header lines, ``body`` what follows them; ``ts`` is
    in seconds, null if the date has another form.  A status that is not three
    digits is null.  Null and empty contents, and what is no WARC file, give no
    records; of a damaged file come the records before the damage.  Equal files
    are read as often as they come; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                if not value.is_valid:
                    continue
                rows, held = [], 0
                for r in parse_records(value.as_buffer()):
                    h, (head, _, body) = r["headers"], r["block"].partition(b"\r\n\r\n")
                    status, _, lines = head.decode("latin-1").partition("\r\n")
                    code = status.split(" ")[1] if status.startswith("HTTP/") and " " in status else ""
                    rows.append(
                        (
                            h.get("warc-record-id"),
                            h.get("warc-type"),
                            h.get("warc-target-uri"),
                            h.get("warc-date"),
                            int(code) if code.isascii() and code.isdigit() and len(code) == 3 else None,
                            lines if code else None,
                            body if code else r["block"],
                        )
                    )
                    held += len(r["block"])
                    if held > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.binary()]
    names = ["record_id", "type", "url", "date", "status", "headers", "body"]
    out = files.select(F.col(content_col).cast("binary")).mapInArrow(
        run, "record_id string, type string, url string, date string, status int, headers string, body binary"
    )
    ts = F.unix_timestamp(F.try_to_timestamp("date", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return out.withColumn("ts", ts).drop("date")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no tracking parameters, no last slash."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_replace(F.substring(url, F.length(head) + 1, F.length(url)), r"#.*$", "")
    host = F.regexp_replace(F.translate(head, UPPER, LOWER), r"^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
    rest = F.regexp_replace(rest, r"([?&])utm_[a-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&+", "?")
    rest = F.regexp_replace(rest, r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/$", ""))


def header_map(lines: Column) -> Column:
    """Header lines -> a map with names in lower case; of repeated names the last."""
    each = F.filter(F.split(F.coalesce(lines, F.lit("")), "\r?\n"), lambda x: F.locate(":", x) > 1)
    name = lambda x: F.translate(F.trim(F.substring_index(x, ":", 1)), UPPER, LOWER)
    value = lambda x: F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x)))
    pairs = F.transform(each, lambda x: F.struct(name(x).alias("name"), value(x).alias("value")))
    return F.aggregate(
        pairs,
        F.expr("cast(map() as map<string,string>)"),
        lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, v: k != p["name"]), F.create_map(p["name"], p["value"])
        ),
    )


def _opaque(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, r"^W/", "")


def last_before(events: DataFrame, key: list[str], ts: str, value: str, scratch: Scratch, seconds: int) -> DataFrame:
    """``events`` with ``last``: the greatest ``value`` struct of a strictly earlier time under the same key.

    ``value`` is null in rows that are not candidates.  Its first field is the
    time, so the greatest is the latest; ties in time go to its next fields.
    """
    rows = scratch.store(events.withColumn("bucket", F.floor(F.col(ts) / seconds)))
    ends = rows.groupBy(*key, "bucket").agg(F.max(value).alias("end"))
    over = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, "bucket", F.max("end").over(over).alias("before"))
    inside = Window.partitionBy(*key, "bucket").orderBy(ts).rangeBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("near", F.max(value).over(inside))
        .join(ends, [*key, "bucket"])
        .withColumn("last", F.coalesce("near", "before"))
        .drop("near", "before", "bucket")
    )


def resolve_revisits(records: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``(record_id long, url, ts long, status, headers, payload)`` -> one row for each 304 record.

    Returns ``(record_id, canonical, outcome, target_id, headers, payload)``.
    ``outcome`` is ``resolved``, ``validator-mismatch`` (the latest earlier
    response has another entity tag, or, where the revisit or the response has
    none, another Last-Modified date, or neither can be compared) or
    ``no-earlier-response``.  ``headers`` are the response's, updated by the
    revisit's permitted ones, sorted; both are null unless resolved, ``payload``
    (any digest or body of the response) too.

    Earlier means a smaller ``ts``; of responses of one time the one with the
    greatest id is taken, of those of one id the one with the greatest
    validators.  Rows with a null URL, time or id match nothing.  Full responses
    are those with status 200, revisits those with 304; others, a null status
    included, take no part.  Rows are told apart though they share an id, and
    repeated rows are returned as often as they come.  Empty table: no rows.
    Other columns of ``records`` are not read, whatever their names.
    """
    scratch = Scratch(records.sparkSession, "warc")
    rows = scratch.store(
        records.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("record_id").cast("long").alias("record_id"),
            canonical_url(F.col("url")).alias("canonical"),
            F.col("ts").cast("long").alias("ts"),
            "status",
            header_map(F.col("headers")).alias("h"),
            "payload",
        ).where("status in (200, 304)")
    )
    etag, modified = F.col("h")["etag"], F.col("h")["last-modified"]
    usable = F.expr("canonical is not null and ts is not null and record_id is not null")
    response = F.struct("ts", F.col("record_id").alias("id"), etag.alias("etag"), modified.alias("modified"), "row")
    light = rows.where(usable).select(
        "row",
        "canonical",
        "ts",
        etag.alias("etag"),
        modified.alias("modified"),
        F.when(F.col("status") == 200, response).alias("full"),
    )
    found = last_before(light, ["canonical"], "ts", "full", scratch, seconds).where("full is null")
    last = F.col("last")
    same = F.when(F.col("etag").isNotNull() & last["etag"].isNotNull(), _opaque(F.col("etag")) == _opaque(last["etag"])).otherwise(
        F.coalesce(F.col("modified") == last["modified"], F.lit(False))
    )
    judged = found.select(
        "row",
        F.when(last.isNull(), "no-earlier-response").when(same, "resolved").otherwise("validator-mismatch").alias("outcome"),
        F.when(last.isNotNull() & same, last["id"]).alias("target_id"),
        F.when(last.isNotNull() & same, last["row"]).alias("target"),
    )
    revisits = scratch.store(rows.where("status = 304").select("row", "record_id", "canonical", "h").join(judged, "row", "left"))
    full = rows.where("status = 200").select(F.col("row").alias("target"), F.col("h").alias("stored"), F.col("payload").alias("body"))
    new = F.map_filter("h", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(new, k)), new)
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    resolved = revisits.where("target is not null").join(full, "target")
    resolved = resolved.select("record_id", "canonical", "outcome", "target_id", lines.alias("headers"), F.col("body").alias("payload"))
    # What is not resolved has nothing to look up, and does not meet under a null.
    rest = revisits.where("target is null").select(
        "record_id",
        "canonical",
        F.coalesce("outcome", F.lit("no-earlier-response")).alias("outcome"),
        F.lit(None).cast("long").alias("target_id"),
        F.lit(None).cast("string").alias("headers"),
        F.lit(None).cast(rows.schema["payload"].dataType).alias("payload"),
    )
    return resolved.unionByName(rest)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records from a table of pages, by fixed rules, for ``resolve_revisits``.

    Every page was fetched at minute ``page_id`` and is response ``2 * page_id``
    with its MD5 as entity tag; 1,000 minutes later it was asked for again, with
    a fragment in the URL, and answered 304 by record ``2 * page_id + 1``.
    Pages whose id is divisible by 5 name an old tag then; with remainder 1 they
    name the date only, and with remainder 2 a weak tag.
    """
    page, digest = F.col("page_id"), F.md5(F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    first = F.concat_ws(
        "\r\n",
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Date: "), page * 60),
        F.concat(F.lit("ETag: "), tag),
        F.concat(F.lit("Last-Modified: "), page),
        F.lit("Cache-Control: max-age=60"),
    )
    rest = F.pmod(page, F.lit(5))
    again = F.concat_ws(
        "\r\n",
        F.concat(F.lit("date: "), (page + 1000) * 60),
        F.when(rest == 0, 'etag: "old"')
        .when(rest == 1, F.concat(F.lit("last-modified: "), page))
        .when(rest == 2, F.concat(F.lit("etag: W/"), tag))
        .otherwise(F.concat(F.lit("etag: "), tag)),
        F.lit("cache-control: max-age=120"),
        F.lit("content-type: text/plain"),
        F.lit("set-cookie: a=1"),
    )
    response = pages.select(
        (page * 2).alias("record_id"), "url", (page * 60).alias("ts"), F.lit(200).alias("status"), first.alias("headers"), digest.alias("payload")
    )
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"),
        F.concat("url", F.lit("#again")).alias("url"),
        ((page + 1000) * 60).alias("ts"),
        F.lit(304).alias("status"),
        again.alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)
