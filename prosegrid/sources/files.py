"""Files as documents: plain text, Markdown and Word files, with a reason for each that is not taken.

A file is a row; nothing it holds ends the job.  PDF files have no reader
here: their text items come as a table (``sources.pages``).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.functions import texts as X
from prosegrid.session import ship

# What is accepted, and how much of it.
KINDS = ("txt", "md", "docx", "pdf")
MOST_BYTES, MOST_CHARACTERS, MOST_PAGES = 10 * 1024 * 1024, 2_000_000, 500
#: The text part of a Word file, unpacked, may have this many bytes.
MOST_XML = 1 << 27
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TRIM = "\t\n\x0b\x0c\r       　﻿" + "".join(map(chr, range(0x2000, 0x200B)))


def kind_of(name: Column) -> Column:
    """The kind that a file's extension names, in any case; null for others and none."""
    extension = F.regexp_extract(F.lower(name), r"\.([^.]+)\z", 1)
    return F.when(extension.isin(*KINDS), extension)


def docx_text(data: bytes) -> str:
    """The text of a Word file: a blank line after each paragraph, tabs kept, breaks left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        info = parts.getinfo("word/document.xml")
        if info.file_size > MOST_XML:
            raise ValueError("too large a text part")
        body = parts.read(info)
    if b"<!DOCTYPE" in body[:1024]:
        raise ValueError("a text part with a document type")
    out: list[str] = []

    def walk(node) -> None:
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab" and node.attrib.get(f"{_W}val") is None and node.attrib.get(f"{_W}pos") is None:
            out.append("\t")
        elif node.tag not in (f"{_W}del", f"{_W}instrText"):
            for child in node:
                walk(child)
            if node.tag == f"{_W}p":
                out.append("\n\n")

    for node in ElementTree.fromstring(body):
        walk(node)
    return "".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(path, kind, content)`` -> ``(path, text, reason)``, a file at a time."""
    for batch in batches:
        for path, kind, content in zip(*(batch.column(i) for i in range(3))):
            text, reason = None, None
            try:
                data = content.as_buffer().to_pybytes()
                if kind.as_py() == "docx":
                    text = docx_text(data)
                else:
                    text = data.decode("utf-8-sig", "replace")
                text = text.strip(_TRIM)
                if len(text) > MOST_CHARACTERS:
                    text, reason = None, "too-much-text"
                elif not text:
                    text, reason = None, "no-readable-text"
            except Exception:  # noqa: BLE001  whatever a damaged file does, it is one row
                reason = "unreadable"
            rows = [pa.array([path.as_py()], pa.string()), pa.array([text], pa.string()), pa.array([reason], pa.string())]
            yield pa.RecordBatch.from_arrays(rows, ["path", "text", "reason"])


def import_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, name, kind, bytes, modified, method, text, characters, reason)``: one row for each file under ``path``.

    ``reason`` is null for a file that is taken, else ``too-large`` (10 MiB),
    ``unsupported-type``, ``needs-page-items`` (PDF), ``unreadable`` (damaged or
    under a password), ``too-much-text`` or ``no-readable-text``.  Contents are
    read only of files that size and kind let pass.
    """
    reader = ship(spark).read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    seen = files.select("path", name.alias("name"), kind_of(name).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    early = F.when(F.col("bytes") > MOST_BYTES, "too-large").when(F.col("kind").isNull(), "unsupported-type").when(F.col("kind") == "pdf", "needs-page-items")
    seen = seen.withColumn("early", early)
    open_ = files.where(F.col("length") <= MOST_BYTES).withColumn("kind", kind_of(name)).where(F.col("kind").isin("txt", "md", "docx"))
    read = open_.select("path", "kind", "content").mapInArrow(_read, "path string, text string, reason string")
    out = seen.join(read, "path", "left")
    method = F.when(F.col("kind") == "docx", "docx-text").when(F.col("kind").isin("txt", "md"), "plain-text")
    return out.select(
        "path", "name", "kind", "bytes", "modified",
        F.when(F.col("text").isNotNull(), method).alias("method"),
        "text", F.length("text").cast("long").alias("characters"), F.coalesce("early", "reason").alias("reason"),
    )


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(family, name, number, text)`` of ``path/<family>/<name>.txt``; ``number`` is the first in the name, for sorting."""
    texts = ship(spark).read.text(f"{path}/*/*.txt", wholetext=True).withColumn("path", F.input_file_name())
    parts = F.split("path", "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.txt\z", "")
    return texts.select(F.element_at(parts, -2).alias("family"), name.alias("name"), F.regexp_extract(name, r"\d+", 0).cast("long").alias("number"), F.col("value").alias("text"))


def readable_bytes(n: Column) -> Column:
    """As people read it, in steps of 1,024."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB")))
    )


def method_label(method: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in X.METHODS.items() for x in pair)), method)


def date_label(at: Column) -> Column:
    """A time as reports show it, in a session whose zone is UTC."""
    return F.concat(F.date_format(at, "d MMMM yyyy, HH:mm"), F.lit(" UTC"))
