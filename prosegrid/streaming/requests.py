"""Requests for a revision: which are answered, and what a provider's answer holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.functions import tokens as T

# Fixed values.
MOST_BODY, LEAST_PASSAGE, MOST_PASSAGE = 12_000, 20, 8_000
ANSWER = "struct<output_text:string,output:array<struct<type:string,content:array<struct<type:string,text:string>>>>>"


def status_of(requests: DataFrame, intents: tuple[str, ...], available: Column, accepted: Column | None = None) -> DataFrame:
    """``requests`` with ``status``, of the first test that fails, or 200.

    ``(method, origin_host, host, body_bytes, passage, intent)``: 405 for other
    methods than GET and POST, 503 without a provider, 403 from another host,
    413 for large bodies, 429 where ``accepted`` (of the rate limiter) is false,
    400 for passages and intents out of range.  GET asks for availability.
    """
    p, ok = F.col("passage"), accepted if accepted is not None else F.lit(True)
    good = p.isNotNull() & (F.length(T.trimmed(p)) >= LEAST_PASSAGE) & (F.length(p) <= MOST_PASSAGE) & F.coalesce(F.col("intent").isin(*intents), F.lit(False))
    status = (
        F.when(F.col("method") == "GET", 200)
        .when(F.coalesce(F.col("method") != "POST", F.lit(True)), 405)
        .when(~available, 503)
        .when(~F.coalesce(F.col("origin_host") == F.col("host"), F.lit(False)), 403)
        .when(F.coalesce(F.col("body_bytes"), F.lit(0)) > MOST_BODY, 413)
        .when(~ok, 429)
        .when(~good, 400)
        .otherwise(200)
    )
    return requests.withColumn("status", status)


def answer_text(body: Column) -> Column:
    """The text of a provider's JSON answer: its own field, else the first text part of a message, else empty."""
    x = F.from_json(body, ANSWER)
    parts = F.flatten(F.transform(F.filter(x["output"], lambda o: o["type"] == "message"), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    found = F.filter(parts, lambda c: (c["type"] == "output_text") & c["text"].isNotNull())
    return F.coalesce(x["output_text"], F.get(F.transform(found, lambda c: c["text"]), F.lit(0)), F.lit(""))
