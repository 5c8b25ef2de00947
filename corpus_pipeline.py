"""A training corpus from raw documents: each stage works on what the one before it kept.

``STAGES`` lists the stages in order. A stage takes (spark, docs, sf_dir) and returns documents
with the columns they came with; the last one returns the pieces of packed sequences.

Stages write tables of their own. Those of a stage are removed when the next one starts, as its result
is written by then; the last one's stay with the result that reads them.

Defined cases are those of the operators. Rows with a null or repeated id, and columns of other
names, pass through the stages that keep them; an empty table gives an empty result.
"""

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.llm import classifier, decontamination, near_copies, packing, secret_ledger
from contentloom.session import remove_stages, stage, stage_folder, staged

#: Documents of a lower score go.
LEAST_QUALITY = 0.3


_BEFORE: list[str] = []


def _own_tables(apply):
    """A stage that removes the tables of the stage before it."""

    @functools.wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_stages(spark, _BEFORE)
        there = set(staged())
        result = apply(spark, docs, sf_dir)
        _BEFORE[:] = [p for p in staged() if p not in there] if apply is not sequences else []
        return result

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from all labelled documents, so
    it is the same whatever came before."""
    everything = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = classifier.fit(everything, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.accepted(spark, docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked. ``n_chars`` follows the text where it changes."""
    ledger = secret_ledger.Ledger(spark, f"{stage_folder(spark)}/ledger-{uuid.uuid4().hex}")
    masked = secret_ledger.redact(docs, ledger)
    changed = F.contains("text", F.lit(secret_ledger.MARK))
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    pieces = packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", _own_tables(quality)),
    ("simhash near-dedup", _own_tables(near_duplicates)),
    ("benchmark decontamination", _own_tables(contamination)),
    ("secret scans", _own_tables(secrets)),
    ("packing", _own_tables(sequences)),
]

# The classifier is learned and packing is greedy; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
