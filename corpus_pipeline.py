"""From raw documents to packed training sequences, as stages that each write their table.

Quality rules reject documents; one document of each near-duplicate group stays; documents that hold a benchmark item go;
personal data is masked; what is left is packed. Every stage but the last returns the columns of `documents`.

Stages work on whatever they are given: null, empty and very long texts, repeated rows, rows without an id and empty
tables (see the operators for what each case gives), and they pass other columns through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.decontamination import without_contaminated
from faultline.llm.ngram_join import one_of_each_group
from faultline.llm.packing import packed_documents
from faultline.llm.personal_data import masked_text, train_tagger
from faultline.llm.quality_rules import fit_rules, rule_counts
from faultline.llm.support import fresh, materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the forest (fitted on all of `docs`, its threshold on their labelled rows)."""
    rules = fit_rules(materialise(rule_counts(docs), "rule-counts"), table(spark, sf_dir, "labels"))
    kept = fresh(docs, "kept")
    return docs.withColumn(kept, rules.kept_text(spark)).where(F.col(kept)).drop(kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is the new text's length."""
    masked = docs.withColumn("text", masked_text(spark, train_tagger()))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
