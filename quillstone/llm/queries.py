"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, forest, hmm, minhash, mixing, nndescent, pfor, quality, shards, warc
from quillstone.llm.common import table
from quillstone.llm.sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
#: Production mixture: weights by node of the tree domain / language / source; absent ones are 1.
MIX_WEIGHTS = {("d0", "en"): 4.0, ("d1", "en"): 4.0, ("d2", "en"): 4.0, ("d3", "en"): 4.0, ("d0",): 2.0, ("d0", "de", "src0"): 0.5, ("d1", "fr"): 2.0}
MIX_FRACTION = 0.6
SHARDS = 40


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mix_levels():
    """Tree of the documents table: domain (a bucket of the source), language, source."""
    domain = F.concat(F.lit("d"), F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(4)))
    return {"domain": F.when(F.col("source").isNotNull(), domain), "lang": F.col("lang"), "source": F.col("source")}


def crawl_records(pages: DataFrame) -> DataFrame:
    """Three captures of every page as web-archive records.

    The first is a full response (a revisit for pages of numbers 3 in 7, whose
    first fetch lies outside this crawl), the second a revisit, the third a full
    response for even pages and a revisit for others.  One page in five changed
    its entity tag between captures.
    """
    p = pages.select(
        F.col("page_id").alias("page"), "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")
    )
    c = p.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    full = ((F.col("k") == 0) & (F.col("page") % 7 != 3)) | ((F.col("k") == 2) & (F.col("page") % 2 == 0))
    tag = F.concat(F.lit('W/"'), F.substring("digest", 1, 8), F.when((F.col("page") % 5 == 0) & (F.col("k") > 0), "-x").otherwise(""), F.lit('"'))
    second = F.lit(1_700_000_000) + F.col("k") * 86_400 + F.pmod(F.col("page") * 7_919, F.lit(80_000))
    headers = F.when(full, F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), F.col("size").cast("string"), F.lit("Date"), second.cast("string"), F.lit("Server"), F.lit("a")))
    headers = headers.when(F.col("page") % 11 == 0, F.create_map(F.lit("Date"), second.cast("string"), F.lit("Server"), F.lit("b")))
    headers = headers.otherwise(F.create_map(F.lit("etag"), tag, F.lit("Date"), second.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0")))
    return c.select(
        (F.col("page") * 3 + F.col("k")).alias("record_id"), F.when(full, "response").otherwise("revisit").alias("record_type"), "url", F.timestamp_seconds(second).alias("ts"), headers.alias("headers"),
        F.when(full, F.col("digest")).alias("payload_digest"),
    )


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = crawl_records(table(spark, sf_dir, "pages"))
    got = warc.resolve_revisits(records)
    bodies = records.where("payload_digest is not null").select("record_id", F.col("payload_digest").alias("payload"))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
    return warc.attach_payload(got, bodies).select(
        "record_id", "record_type", "canonical_url", F.unix_seconds("ts").alias("ts_seconds"), "outcome", "refers_to", lines.alias("header_lines"), F.col("payload").alias("payload_digest")
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op4_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(table(spark, sf_dir, "embeddings"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.file_digests(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shards.assign(table(spark, sf_dir, "documents"), SHARDS)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, fraction=MIX_FRACTION)
    return got.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_epoch")


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.train_and_score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (op1_revisits, op2_quality, op3_bpe, op4_embedding_near_duplicates, op5_nearest_neighbours, op6_token_files, op7_minhash_near_duplicates, op8_shards, op9_mixing, op10_hmm)
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
