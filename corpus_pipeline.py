"""The corpus pipeline over ``documents``: five stages, each over all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, langid, packing, pii, simhash
from weftline.llm.common import held_out, materialise

#: a document is rejected if the model has met less than this share of its distinct n-grams: it is in none of
#: the languages, however many there are
LEAST_KNOWN = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a language that the model knows; those without a letter are rejected too.

    The model learns from the labelled part of the same documents, outside the held-out fold.
    """
    model = langid.train(docs, ~held_out("doc_id", 3, 1))
    names = ("__wl_lang", "__wl_score", "__wl_known")
    found = langid.identify(docs, model, names)
    return found.filter((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[2]) >= LEAST_KNOWN)).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash near-duplicates, that with the least doc_id."""
    return simhash.keep_one_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a benchmark item is found."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the personal data in every text."""
    return pii.mask_personal_data(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 1024 tokens: one row a piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "spaces", end_id=2, capacity=1024)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the fitted model nor the tokenizer; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each one's rows being written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
