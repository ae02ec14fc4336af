"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegrid.functions import constants as C
from prosegrid.functions import tokens as T
from prosegrid.operators import calibration, comparison, coverage, documents, features, report, revision, signals
from prosegrid.operators.segments import lines, segment
from prosegrid.plans.oracles import ORACLES  # noqa: F401
from prosegrid.session import ship, spread
from prosegrid.sources import pages
from prosegrid.streaming import limits, requests


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that takes long for each of them."""
    return spread(_docs(spark, sf_dir).select("doc_id", "text"))


def word_counts(spark, sf_dir):
    t = F.col("text")
    number = lambda p: T.count(t, p).cast("long")
    return _docs(spark, sf_dir).select(
        "doc_id", number(C.TOKEN).alias("tokens"), number(C.WORD).alias("words"), number(r"\S+").alias("pieces")
    )


def statistical_sentences(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return found.select(
        "doc_id",
        F.size("s").cast("long").alias("sentences"),
        F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"),
    )


def window_ranges(spark, sf_dir):
    found = features.statistical_windows(_docs(spark, sf_dir))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


def statistical_features(spark, sf_dir):
    found = features.windowed(_texts(spark, sf_dir))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), *(F.round(n, 6).alias(n) for n in features.NAMES))


def window_likelihood(spark, sf_dir):
    found = features.with_likelihood(features.windowed(_texts(spark, sf_dir)))
    return found.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.round("logit", 6).alias("logit"), F.round("probability", 6).alias("probability")
    )


def writing_characteristics(spark, sf_dir):
    found = features.characteristics(_texts(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", F.round("long_word_ratio", 6).alias("long_word_ratio"), F.round("citation_sentence_ratio", 6).alias("citation_sentence_ratio")
    )


def fnv_split(spark, sf_dir):
    bucket = calibration.fnv_bucket(F.concat(F.lit("essay:"), F.col("doc_id").cast("string")))
    return _docs(spark, sf_dir).select("doc_id", bucket.alias("bucket")).withColumn("split", calibration.split_of(F.col("bucket")))


def line_assessment(spark, sf_dir):
    found = lines(_texts(spark, sf_dir)).select("doc_id", F.posexplode("lines").alias("line_no", "l"))
    return found.select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.col("l.start").cast("long").alias("start"),
        F.col("l.end").cast("long").alias("stop"),
        F.coalesce("l.reason", F.lit("prose")).alias("reason"),
    )


def sentence_split(spark, sf_dir):
    found = segment(_texts(spark, sf_dir)).select("doc_id", F.posexplode("sentences").alias("sentence_no", "s"))
    return found.select("doc_id", "sentence_no", "s.start", F.col("s.end").alias("stop"), "s.words", F.coalesce("s.reason", F.lit("prose")).alias("reason"))


def sentence_scores(spark, sf_dir):
    scored = coverage.score_sentences(_texts(spark, sf_dir))
    return scored.select("doc_id", "i", "start", F.col("end").alias("stop"), "words", F.round("probability", 6).alias("probability"), "detected")


def coverage_status(spark, sf_dir):
    return coverage.coverage(_texts(spark, sf_dir))


def quantile_floor(spark, sf_dir):
    return calibration.floor_quantiles(_docs(spark, sf_dir), "source", "n_chars", (0.5, 0.9, 0.995))


def roc_auc(spark, sf_dir):
    scored = window_likelihood(spark, sf_dir).join(_docs(spark, sf_dir, "labels"), "doc_id")
    return calibration.roc_auc(scored, "quality", "probability")


def class_weights(spark, sf_dir):
    labelled = window_ranges(spark, sf_dir).join(_docs(spark, sf_dir, "labels"), "doc_id")
    found = calibration.class_weights(labelled, "quality")
    return found.select("doc_id", "quality", F.round("weight", 9).alias("weight"))


def changed_tokens(spark, sf_dir):
    pairs = comparison.next_versions(_docs(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return comparison.changed_tokens(pairs, ["conv_id", "turn"])


def _books(spark, sf_dir):
    """Documents of a source as pages of a book, each with its language as a header and a page number below."""
    text = F.concat_ws("\n", "lang", "text", F.concat(F.lit("page "), F.col("doc_id").cast("string")))
    return pages.lines_of_pages(_docs(spark, sf_dir).withColumn("printed", text), "source", "doc_id", "printed")


def boundary_artifacts(spark, sf_dir):
    return pages.repeated_artifacts(_books(spark, sf_dir))


def body_lines(spark, sf_dir):
    return pages.without_artifacts(_books(spark, sf_dir)).groupBy("book", "page").agg(F.count(F.lit(1)).alias("lines"))


def rate_limiter(spark, sf_dir):
    found = limits.rate_limited(_docs(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return found.select(F.col("key").alias("event_id"), "accepted")


def ttl_latest(spark, sf_dir):
    events = _docs(spark, sf_dir, "events")
    return limits.latest_unexpired(events, "user_id", "ts", "event_id").select(F.col("owner").alias("user_id"), F.col("key").alias("event_id"))


def _sentences(spark, sf_dir):
    """Sentences of the raw texts, numbered from 0."""
    return _texts(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "text"))


def sentence_signals(spark, sf_dir):
    found = signals.with_signals(_sentences(spark, sf_dir)).select("doc_id", F.col("i").cast("long").alias("i"), F.explode("signals").alias("s"))
    evidence = F.array_join("s.evidence", " | ")
    return found.select("doc_id", "i", F.col("s.id").alias("signal"), F.col("s.impact").alias("impact"), evidence.alias("evidence"))


def pattern_intensity(spark, sf_dir):
    return signals.pattern_intensity(signals.with_signals(_sentences(spark, sf_dir))).select("doc_id", F.col("intensity").cast("long").alias("intensity"))


def top_signals(spark, sf_dir):
    top = signals.top_signals(signals.with_signals(_sentences(spark, sf_dir)))
    return top.select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("signal"), "affected", "occurrences", "impact")


def coaching(spark, sf_dir):
    found = signals.coaching(signals.top_signals(signals.with_signals(_sentences(spark, sf_dir))))
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("signal"), "priority", "title")


def document_factors(spark, sf_dir):
    means = features.windowed(_texts(spark, sf_dir)).groupBy("doc_id").agg(F.array(*(F.avg(n) for n in features.NAMES)).alias("mean"))
    found = signals.document_factors(means, ["doc_id"])
    number = lambda c: F.round(c, 6).alias(c)
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"), "feature", number("value"), number("standardized"), number("contribution"), "direction")


def audit_notes(spark, sf_dir):
    found = report.notes(coverage.audit(_texts(spark, sf_dir)))
    return found.select("doc_id", "status", "label", "summary", "confidence_label", "confidence_reason", "domain_label", "domain_reason", "long_words", "cited_sentences")


def passage_reviews(spark, sf_dir):
    found = report.passage_reviews(coverage.stored(_texts(spark, sf_dir)))
    return found.select("doc_id", "passage", "start", "end", "sentences", "words", "score", "band", "label", "text", F.col("signals.id").alias("signals"), F.col("factors.feature").alias("factors"))


def report_blocks(spark, sf_dir):
    audited = coverage.stored(_texts(spark, sf_dir))
    reviews = report.passage_reviews(audited)
    intensity = signals.pattern_intensity(report.scored_sentences(audited), key="row")
    head = report.summary_rows(audited, intensity, reviews).select(
        "doc_id", F.lit(0).cast("long").alias("passage"), F.col("line").alias("block"), F.lit("summary").alias("kind"), F.concat_ws(": ", "name", "value").alias("text")
    )
    body = report.review_blocks(reviews).select("doc_id", F.col("passage").cast("long").alias("passage"), "block", "kind", "text")
    return head.unionByName(body)


def revision_plan(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    audited = coverage.stored(docs)
    shown = report.reportable(audited)
    paragraph = F.sum(F.col("paragraph_before").cast("int")).over(Window.partitionBy("row").orderBy("i"))
    place = coverage.sentences(shown).withColumn("paragraph", paragraph).select("row", "i", "paragraph")
    targets = report.scored_sentences(shown).join(place, ["row", "i"])
    edits = revision.plan_edits(report.passage_members(audited), targets, "comprehensive")
    found = revision.plan_status(audited, report.passage_reviews(audited), edits, docs.select("doc_id", "text"))
    return found.select("doc_id", "status", "passages", "edits", "guidance")


def _labelled_windows(spark, sf_dir):
    found = window_likelihood(spark, sf_dir).join(_docs(spark, sf_dir, "labels"), "doc_id")
    return found.withColumn("human", F.col("quality") == 1)


def document_rates(spark, sf_dir):
    each = _labelled_windows(spark, sf_dir).withColumn("words", F.lit(1))
    found = calibration.document_rates(each, 0.5)
    return found.select("humans", F.round("human_rate", 6).alias("human_rate"), "machines", F.round("recall", 6).alias("recall"))


def window_metrics(spark, sf_dir):
    found = calibration.balanced_accuracy(_labelled_windows(spark, sf_dir), "human", "probability", 0.5)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


def domain_bounds(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    means = features.windowed(docs).groupBy("doc_id").agg(F.array(*(F.avg(n) for n in features.NAMES)).alias("mean"))
    parts = features.contributions(F.col("mean"))
    positive = lambda names: sum((F.greatest(F.lit(0.0), c) for c, name in zip(parts, features.NAMES) if name in names), F.lit(0.0))
    share = means.select("doc_id", F.round(T.ratio(positive(C.LEXICAL), positive(features.NAMES)), 6).alias("lexical_share"))
    per = writing_characteristics(spark, sf_dir).join(share, "doc_id").join(fnv_split(spark, sf_dir), "doc_id")
    found = calibration.domain_bounds(per, 0.9)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


def standardized_features(spark, sf_dir):
    found = calibration.standardize(features.windowed(_texts(spark, sf_dir)).withColumn("w", F.lit(1.0)), features.NAMES, "w")
    return found.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


def page_lookup(spark, sf_dir):
    turns = _docs(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")
    places = turns.select("book").distinct().withColumn("start", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 100, 250, 100000)))))
    found = pages.page_of(places, pages.spans(turns))
    return found.select(F.col("book").alias("conv_id"), F.col("start").alias("place"), F.col("page").alias("turn"))


def clean_paragraphs(spark, sf_dir):
    found = documents.clean_paragraphs(_docs(spark, sf_dir))
    return found.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "text")


def revision_requests(spark, sf_dir):
    asked = _docs(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 7 == 3, "PUT").when(F.col("turn") % 7 == 5, "GET").otherwise("POST").alias("method"),
        F.lit("a.example").alias("host"), F.when(F.col("conv_id") % 11 == 0, "b.example").otherwise("a.example").alias("origin_host"),
        (F.length("text") * 40).alias("body_bytes"), F.col("text").alias("passage"), F.when(F.col("role") == "user", "clarify").otherwise("shorten").alias("intent"),
    )
    found = requests.status_of(asked, ("clarify", "strengthen-reasoning"), F.lit(True))
    return found.select("conv_id", "turn", F.col("status").cast("long").alias("status"))


def flagged_passages(spark, sf_dir):
    found = signals.passages(coverage.sentences(coverage.stored(_texts(spark, sf_dir))))
    return found.select("doc_id", "passage", "start", "end", "sentences", "words", "score", "band")


def revise_text(spark, sf_dir):
    scored = signals.with_signals(_sentences(spark, sf_dir))
    found = scored.withColumn("stock", F.exists("signals", lambda s: s["id"] == "stock-phrases"))
    return revision.revise(found, "comprehensive").select("doc_id", "i", "revised", "rules")


def protected_diff(spark, sf_dir):
    pairs = comparison.next_versions(_docs(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return revision.protected_diff(pairs, ["conv_id", "turn"])


def text_statistics(spark, sf_dir):
    return documents.text_statistics(_docs(spark, sf_dir))


def prose_statistics(spark, sf_dir):
    return documents.prose_statistics(coverage.audit(_texts(spark, sf_dir)))


def report_excerpt(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", documents.excerpt(F.col("text")).alias("excerpt"))


def highlighted_runs(spark, sf_dir):
    found = flagged_passages(spark, sf_dir).select("doc_id", "start", "end", "band")
    return documents.highlighted_runs(_docs(spark, sf_dir), found)


def page_spans(spark, sf_dir):
    turns = _docs(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")
    return pages.spans(turns).select(F.col("book").alias("conv_id"), F.col("page").alias("turn"), "start", F.col("end").alias("stop"), "quality")


def threshold_choice(spark, sf_dir):
    scored = window_likelihood(spark, sf_dir).join(_docs(spark, sf_dir, "labels"), "doc_id")
    scored = scored.select("doc_id", "probability", F.lit(1).alias("weight"), (F.col("quality") == 1).alias("human"))
    return calibration.choose_threshold(scored, "probability", "weight", "human")


QUERIES = {
    f.__name__: f
    for f in (
        word_counts,
        statistical_sentences,
        window_ranges,
        statistical_features,
        window_likelihood,
        writing_characteristics,
        fnv_split,
        line_assessment,
        sentence_split,
        sentence_scores,
        coverage_status,
        quantile_floor,
        roc_auc,
        class_weights,
        changed_tokens,
        boundary_artifacts,
        body_lines,
        rate_limiter,
        ttl_latest,
        sentence_signals,
        pattern_intensity,
        top_signals,
        flagged_passages,
        revise_text,
        protected_diff,
        text_statistics,
        prose_statistics,
        report_excerpt,
        highlighted_runs,
        page_spans,
        threshold_choice,
        coaching,
        document_factors,
        audit_notes,
        passage_reviews,
        report_blocks,
        revision_plan,
        document_rates,
        window_metrics,
        domain_bounds,
        standardized_features,
        page_lookup,
        revision_requests,
        clean_paragraphs,
    )
}
FLAGSHIP = "coverage_status"
