"""The corpus pipeline: language, near duplicates, decontamination, PII and packing, one after the other.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, language_id, ngram_join, packing, pii
from strandlake.llm.common import table, written
from strandlake.llm.queries import tokenizer_files

#: A document goes if no language reaches this mean probability.
LEAST_LANGUAGE = 0.4


def _unused(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until no column is called so."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those in which no language stands out.

    Null and empty texts go. Rows are judged one by one by their text, whatever their ids; equal texts share their fate. Without
    a labelled text all rows go. An empty table gives an empty result.
    """
    net = language_id.fit(docs)
    lang = _unused(docs, "lang_pred")
    score = _unused(docs, "score")
    out = language_id.labelled(docs, net, lang_name=lang, score_name=score)
    return out.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the one with the smallest id.

    Texts without words are in no group and stay. Where ids repeat or are null, rows are numbered and judged one by one; a
    group keeps its smallest id, null ids last, then the row numbered first, and rows with one id and unlike texts all
    stay. An empty table gives an empty result.
    """
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id is null or count > 1").isEmpty():
        later = ngram_join.near_duplicates(docs).where("component_id <> doc_id").select("doc_id")
        return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
    row = _unused(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    near = ngram_join.near_duplicates(numbered, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row")))["row"].alias(row)
    kept = numbered.select("doc_id", row).join(near, row).groupBy("component_id").agg(first).select(row)
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or one with other numbers, units or names.

    Null and empty texts stay. Rows are judged by their text, whatever their ids. Empty tables drop nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by surrogates; n_chars follows the text. All rows stay, null and empty texts as they are."""
    out = pii.replace(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; null and empty texts are one token, repeated ids are packed one by one."""
    return packing.pack(docs, *tokenizer_files(), size=1024)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII surrogates", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the network and the tokenizer; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
