"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, id_files, langid, lm, packing, pii, sharding, simhash, toxicity
from .common import held_out, scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned outside the fold of remainder 1 modulo 3. Texts without a letter are ``und`` with score 0."""
    docs = _documents(spark, sf_dir)
    out = held_out("doc_id", 3, 1)
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash fingerprint of every text of ``documents`` and its component over links of at most three bits. Null texts have fingerprint zero."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` found in a text of ``documents``. Null texts and items hold nothing."""
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every text of ``documents``, learned outside the fold of remainder 2 modulo 7. Null texts are empty."""
    return lm.score_documents(_documents(spark, sf_dir), ~held_out("doc_id", 7, 2))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text of ``documents``, learned from ``labels`` outside the fold of remainder 2 modulo 4. Null texts score as clean."""
    docs = _documents(spark, sf_dir)
    out = held_out("doc_id", 4, 2)
    costs = toxicity.trigram_costs(toxicity.trigram_counts(docs))
    listed, otherwise = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~out, costs)
    found = toxicity.score(docs, costs, listed, otherwise)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row of ``documents`` by the law ``key``, with 16 and with 17 shards. Null texts have size 1."""
    tree = sharding.even_tree(16)
    return sharding.shard_documents(_documents(spark, sf_dir), tree, sharding.grown_tree(tree, 16))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of sequences of at most 1024 ids. Null texts hold the end id alone."""
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), "spaces", end_id=2, capacity=1024)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text of ``documents``, written as files and read back by key. Null texts hold the end id alone."""
    path = scratch_path(spark, "ids")
    written = id_files.write_id_files(_documents(spark, sf_dir), path, _tokenizer("word_bpe_49k.json"), "words", end_id=2)
    return id_files.read_id_files(spark, path, written)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text. Null texts are empty."""
    return fingerprint.fingerprint_documents(_documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``. Null texts are empty."""
    return pii.find_personal_data(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_simhash": op2_simhash,
        "op3_decontaminate": op3_decontaminate,
        "op4_lm_score": op4_lm_score,
        "op5_toxicity": op5_toxicity,
        "op6_sharding": op6_sharding,
        "op7_packing": op7_packing,
        "op8_token_files": op8_token_files,
        "op9_fingerprint": op9_fingerprint,
        "op10_personal_data": op10_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    """None of these can be said in DuckDB's SQL: they hash with XXH64, or fit and apply a model."""
    return {}
