"""The thin queries over the operators: each applies one to its whole table and derives digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm import bpe, fingerprints, gif, licenses, packing, quality, secrets, sharding, shared, simhash, simple8b

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(shared.table(spark, sf_dir, "documents"), JSON)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compared(shared.table(spark, sf_dir, "documents"))
    return found.withColumn("n_differing", F.size("differing")).drop("differing")


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.texts_as_media(shared.table(spark, sf_dir, "documents")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(shared.table(spark, sf_dir, "documents"))
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"])))
    listed = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",")
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(families, ",").alias("families"), listed.alias("spans"), F.array_max(F.transform("notices", lambda x: x["probability"])).alias("probability"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scored(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", quality.listed_votes(F.col("pattern")).alias("votes"), F.round("posterior", 4).alias("posterior"), F.round("score", 4).alias("score"), "kept")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = simple8b.write_ids(shared.table(spark, sf_dir, "documents"), JSON)
    return simple8b.read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encoded(shared.table(spark, sf_dir, "documents"), RANKS)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(shared.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = secrets.listed(F.filter("spans", lambda x: x["base"]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(shared.table(spark, sf_dir, "documents"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_fingerprints": op2_fingerprints,
    "op3_gif": op3_gif,
    "op4_licenses": op4_licenses,
    "op5_token_output": op5_token_output,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
}
#: None of these can be said in SQL: tokenizer files, codecs, trained models, bit fingerprints and seeded draws. Each is
#: held against a brute-force version in tests/llm.
ORACLES: dict[str, str] = {}
