"""From raw documents to packed training sequences: quality, near copies, benchmark passages, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.llm.decontaminate import drop_contaminated
from loadloom.llm.line_crf import classify
from loadloom.llm.ngram_join import one_of_each
from loadloom.llm.packing import pack
from loadloom.llm.pii import replace_entities
from loadloom.session import materialize, read_table


def aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names put under private ones, and the way back."""
    back = {f"_pipeline_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    renamed, back = aside(docs, ("held_out", "score", "predicted"))
    good = classify(renamed, read_table(spark, sf_dir, "labels")).where("predicted = 1")
    return good.select(*renamed.columns).withColumnsRenamed(back)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; texts without words all stay."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    renamed, back = aside(docs, ("entities",))
    told = replace_entities(renamed).select(*renamed.columns)
    if "n_chars" in docs.columns:
        told = told.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return told.withColumnsRenamed(back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]
#: The classifier's fit has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
