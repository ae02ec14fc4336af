"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.llm import langid, media, mixing, packing, sharding, simhash, suffix, topk, urls, warc
from prosegrid.session import ship, spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that takes long for each of them."""
    return spread(_read(spark, sf_dir, "documents"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(_texts(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge_urls(_read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn languages from: crc32 of the id as text, modulo 4, is not 2."""
    return docs.where(_fold(docs) != 2)


def _fold(docs: DataFrame):
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % 4


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = langid.fit(training_rows(docs))
    return langid.identify(docs, model, keep={"doc_id": docs["doc_id"], "held_out": _fold(docs) == 2})


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_spans(_texts(spark, sf_dir))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("start").alias("start_word"),
        F.col("words").alias("n_words"),
        "duplicate_words",
        F.col("first_doc").alias("first_doc_id"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def op6_media_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read_media(media.with_media(_texts(spark, sf_dir)))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        F.size("clips").alias("clips"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(_texts(spark, sf_dir), tokenizer_path())
    return found.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of_pages(_read(spark, sf_dir, "pages")))
    return found.withColumn("target_id", F.coalesce("target_id", F.lit(-1)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk.top_k(vectors, vectors.where("id % 50 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_url_filters,
        op3_language_id,
        op4_suffix_dedup,
        op5_mixing,
        op6_media_mjpeg,
        op7_packing,
        op8_warc_revisits,
        op9_sharding,
        op10_topk,
        pipeline,
    )
}
