"""A corpus from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of documents. Null and empty texts pass the filters and are packed as empty documents; rows without a doc_id pass them too, and
those that repeat one stay or go together; equal texts in one group leave the smallest doc_id. Further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, packing, secrets, toxicity
from tidemark.llm.scratch import Scratch, clear, folders_made


def mild(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go. It is learned from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.keep_mild(docs, toxicity.learn(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard index of 0.75 or more the one of the smallest doc_id stays."""
    return jaccard_join.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows."""
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", mild),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", uncontaminated),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: The stages' scores, edit distances and best-fit bins are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        before = docs
        with folders_made() as own:
            docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
        clear(spark, own)  # what the stage wrote for itself
    return STAGES[-1][1](spark, docs, sf_dir)
