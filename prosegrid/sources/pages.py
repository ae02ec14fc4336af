"""Page text: lines with a position, and what repeats at the top or bottom of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.functions import tokens as T
from prosegrid.sources.files import MOST_CHARACTERS, MOST_PAGES

BAND = 0.12
MOST_WORDS = 20
LEAST_CHARACTERS, LEAST_WORDS = 24, 4


def lines_of_pages(docs: DataFrame, book: str, page: str, text: str, height: float = 800.0) -> DataFrame:
    """``(book, page, line_no, line, y, height)``: a page's lines at even distances."""
    lines = F.split(F.col(text), "\n")
    each = docs.select(F.col(book).alias("book"), F.col(page).alias("page"), F.size(lines).alias("n"), F.posexplode(lines).alias("line_no", "line"))
    y = height * (1 - (F.col("line_no") + 0.5) / F.col("n"))
    return each.select("book", "page", "line_no", "line", y.alias("y"), F.lit(height).alias("height"))


#: Fixed value: what a line with nothing but a page number looks like.
NUMBER = r"(?i)^\s*(?:page\s+)?(?:\d{1,4}|[ivxlcdm]+)(?:\s*(?:of|/|-|–)\s*(?:\d{1,4}|[ivxlcdm]+))?\s*$"


def with_artifact_key(lines: DataFrame) -> DataFrame:
    """Adds ``band`` (top, bottom or null), ``is_number`` and ``key``.

    ``key`` is the band and the normalised text of a short line there that does
    not end like a sentence, else null.  Lines without a place are in no band.
    """
    band = F.when(F.col("height") > 0, F.when(F.col("y") >= (1 - BAND) * F.col("height"), "top").when(F.col("y") <= BAND * F.col("height"), "bottom"))
    plain = T.trimmed(F.regexp_replace(F.lower(T.nfkc(F.col("line"))), r"\s+", " "))
    lines = lines.withColumn("band", band).withColumn("_plain", F.when(F.col("band").isNotNull(), plain))
    number = T.count(F.col("_plain"), r"[\p{L}\p{N}]+")
    good = (number > 0) & (number <= MOST_WORDS) & ~F.col("_plain").rlike(r"""[.!?]["'”’)}\]]*\z""")
    lines = lines.withColumn("is_number", F.coalesce(F.col("line").rlike(NUMBER), F.lit(False)))
    return lines.withColumn("key", F.when(good, F.concat("band", F.lit(":"), "_plain"))).drop("_plain")


def repeated_artifacts(lines: DataFrame, least: int = 2) -> DataFrame:
    """``(book, key, pages)``: keys on at least ``least`` pages of a book, page numbers apart."""
    keyed = with_artifact_key(lines).where("key is not null and not is_number")
    return keyed.groupBy("book", "key").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least)


def without_artifacts(lines: DataFrame, least: int = 2) -> DataFrame:
    """The lines without repeated headers and footers, nor page numbers there; the same text in the body stays."""
    keyed = with_artifact_key(lines).where(F.col("band").isNull() | ~F.col("is_number"))
    return keyed.join(repeated_artifacts(lines, least).select("book", "key"), ["book", "key"], "left_anti").drop("band", "is_number")


def page_texts(lines: DataFrame) -> DataFrame:
    """``(book, page, text)``: a page's lines in order."""
    own = lines.groupBy("book", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return own.select("book", "page", T.trimmed(F.array_join("l.line", "\n")).alias("text"))


def with_ocr(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """``(book, page, text)`` -> the same with ``source``; sparse pages have the text of ``recognised(book, page, text, failed)``.

    ``source`` is ``embedded-text``, ``ocr`` or ``none``; ``outcome`` of a sparse
    page is ``recognised``, ``ocr-empty``, ``ocr-failed`` or ``sparse``.
    """
    other = recognised.select("book", "page", F.col("text").alias("_t"), F.coalesce("failed", F.lit(False)).alias("_f"))
    df = pages.withColumn("quality", quality(F.coalesce("text", F.lit("")))).join(other, ["book", "page"], "left")
    sparse, new = F.col("quality") != "readable-text", F.coalesce(T.trimmed(F.col("_t")), F.lit(""))
    outcome = F.when(~sparse, None).when(F.col("_f").isNull(), "sparse").when(F.col("_f"), "ocr-failed").when(new == "", "ocr-empty").otherwise("recognised")
    df = df.withColumn("outcome", outcome)
    text = F.when(F.col("outcome") == "recognised", new).otherwise(F.coalesce("text", F.lit("")))
    source = F.when(F.col("outcome") == "recognised", "ocr").when(text != "", "embedded-text").otherwise("none")
    return df.select("book", "page", text.alias("text"), source.alias("source"), "quality", "outcome")


def import_notes(pages: DataFrame) -> DataFrame:
    """``(book, pages, method, warnings, reason)`` of ``with_ocr``'s pages; ``reason`` says why a book is not taken."""
    numbers = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("page"))))
    df = pages.groupBy("book").agg(
        F.count(F.lit(1)).alias("pages"),
        numbers((F.col("quality") != "readable-text") & (F.col("outcome") != "recognised")).alias("sparse"),
        numbers(F.col("outcome") == "ocr-failed").alias("failed"),
        numbers(F.col("outcome") == "ocr-empty").alias("empty"),
        F.max((F.col("source") == "ocr").cast("int")).alias("ocr"),
        F.max(((F.col("source") == "embedded-text") & (F.col("text") != "")).cast("int")).alias("embedded"),
        F.sum(F.length("text")).alias("characters"),
    )
    several = lambda c: F.concat(F.when(F.size(c) == 1, "").otherwise("s"), F.lit(" "), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("."))
    warn = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), several(F.col(c))))
    warnings = F.array_compact(
        F.array(
            warn("sparse", "Embedded text was sparse or missing on page"),
            warn("failed", "Local OCR failed on page"),
            warn("empty", "Local OCR returned no readable text for page"),
        )
    )
    method = F.when(F.col("ocr") == 0, "pdf-text").when(F.col("embedded") == 1, "pdf-mixed").otherwise("pdf-ocr")
    reason = F.when(F.col("pages") > MOST_PAGES, "too-many-pages").when(F.col("characters") > MOST_CHARACTERS, "too-much-text").when(F.col("characters") == 0, "scanned")
    return df.select("book", "pages", method.alias("method"), warnings.alias("warnings"), reason.alias("reason"))


def page_of(places: DataFrame, found: DataFrame, book: str = "book", offset: str = "start") -> DataFrame:
    """``places`` with the ``page`` whose span of ``found(book, page, start, end)`` holds the offset, or null."""
    own = found.where(F.col("end") > F.col("start")).select(F.col("book").alias("_b"), "page", F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = (F.col(book) == F.col("_b")) & (F.col(offset) >= F.col("_s")) & (F.col(offset) < F.col("_e"))
    return places.join(own, inside, "left").drop("_b", "_s", "_e")


def quality(text: Column, characters: int = LEAST_CHARACTERS, words: int = LEAST_WORDS) -> Column:
    """``image-only`` without text, ``sparse-text`` with little of it, else ``readable-text``."""
    little = (T.count(text, r"[\p{L}\p{N}]") < max(1, characters)) | (T.count(text, r"[\p{L}\p{N}]+") < max(1, words))
    return F.when(F.coalesce(T.trimmed(text), F.lit("")) == "", "image-only").when(little, "sparse-text").otherwise("readable-text")


def spans(pages: DataFrame) -> DataFrame:
    """``(book, page, text)`` -> ``(book, page, start, end, quality)``: where trimmed pages lie in the book's text.

    Pages are joined by a blank line; an empty one has an empty span where the text ended before it.
    """
    t = F.coalesce(T.trimmed(F.col("text")), F.lit(""))
    own = Window.partitionBy("book").orderBy("page", "t").rowsBetween(Window.unboundedPreceding, -1)
    df = pages.select("book", "page", t.alias("t")).withColumn("n", F.length("t").cast("long"))
    df = df.withColumn("filled", (F.col("n") > 0).cast("long"))
    df = df.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).withColumn("pages", F.coalesce(F.sum("filled").over(own), F.lit(0)))
    gaps = F.when(F.col("n") > 0, F.col("pages")).otherwise(F.greatest(F.col("pages") - 1, F.lit(0)))
    df = df.withColumn("start", F.col("before") + 2 * gaps)
    return df.select("book", "page", "start", (F.col("start") + F.col("n")).alias("end"), quality(F.col("t")).alias("quality"))


def joined(pages: DataFrame) -> DataFrame:
    """``(book, text)``: the text that ``spans`` refers to; its rows are a book's pages."""
    t = F.coalesce(T.trimmed(F.col("text")), F.lit(""))
    own = pages.select("book", F.struct("page", t.alias("t")).alias("p")).groupBy("book").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return own.select("book", F.array_join(F.filter(F.col("p.t"), lambda x: x != ""), "\n\n").alias("text"))


def fragment(current: Column, following: Column) -> Column:
    """Both, with a space between them unless punctuation or white space makes it needless."""
    t = T.trimmed(following)
    apart = ~current.rlike(r"[\s(\[{]\z") & ~t.rlike(r"^[,.;:!?)}\]]")
    return F.when(t == "", current).when(current == "", t).otherwise(F.concat(current, F.when(apart, " ").otherwise(""), t))


def reading_lines(items: DataFrame) -> DataFrame:
    """``(book, page, seq, x, y, height, text, has_eol)`` -> ``(book, page, line_no, line, y)``.

    Items are taken from top to bottom, and join the line above them if its
    first item is within half the larger height (2 to 6 units).  If any item
    that is not blank has no position, the page is read in order of ``seq``, with
    breaks after items that end a line.
    """
    num = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    df = items.where(F.coalesce(T.trimmed(F.col("text")), F.lit("")) != "")
    item = F.struct(
        (-num("y")).alias("ny"), num("x").alias("x"), "seq", F.coalesce(F.abs(num("height")), F.lit(0.0)).alias("h"),
        F.col("text").alias("t"), F.coalesce("has_eol", F.lit(False)).alias("eol"),
    )
    pages = df.select("book", "page", item.alias("i")).groupBy("book", "page").agg(F.array_sort(F.collect_list("i")).alias("s"))
    kind = "array<struct<ny:double,h:double,s:array<struct<x:double,seq:bigint,t:string>>>>"

    def place(lines: Column, i: Column) -> Column:
        last = F.get(lines, F.size(lines) - 1)
        reach = F.greatest(F.lit(2.0), F.least(F.lit(6.0), F.greatest(last["h"], i["h"]) * 0.5))
        part = F.array(F.struct(i["x"].alias("x"), i["seq"].cast("long").alias("seq"), i["t"].alias("t")))
        new = F.array(F.struct(i["ny"].alias("ny"), i["h"].alias("h"), part.alias("s")))
        grown = F.array(F.struct(last["ny"].alias("ny"), F.greatest(last["h"], i["h"]).alias("h"), F.concat(last["s"], part).alias("s")))
        near = (F.size(lines) > 0) & (F.abs(last["ny"] - i["ny"]) <= reach)
        return F.when(near, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), grown)).otherwise(F.concat(lines, new)).cast(kind)

    def written(parts: Column) -> Column:
        return F.aggregate(F.array_sort(parts), F.lit(""), lambda s, x: fragment(s, x["t"]))

    placed = F.aggregate("s", F.array().cast(kind), place)
    by_place = F.transform(placed, lambda g: F.struct(written(g["s"]).alias("line"), (-g["ny"]).alias("y")))
    in_order = F.array_sort(F.transform("s", lambda i: F.struct(i["seq"].alias("seq"), i["t"].alias("t"), i["eol"].alias("eol"))))
    whole = F.aggregate(in_order, F.lit(""), lambda s, x: F.concat(fragment(s, x["t"]), F.when(x["eol"], "\n").otherwise("")))
    pieces = F.filter(F.transform(F.split(whole, r"\r?\n"), T.trimmed), lambda x: x != "")
    by_order = F.transform(pieces, lambda x: F.struct(x.alias("line"), F.lit(None).cast("double").alias("y")))
    lost = F.exists("s", lambda i: i["ny"].isNull() | i["x"].isNull())
    return pages.select("book", "page", F.posexplode(F.when(lost, by_order).otherwise(by_place)).alias("line_no", "l")).select("book", "page", "line_no", "l.line", "l.y")
