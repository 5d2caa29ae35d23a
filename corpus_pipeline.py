"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing; each stage calls one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last keep the columns of ``documents``. Rows with null ids pass the filters that work by id; null and
empty texts are scored and packed like any other; an empty table runs through. No stage is expressible in SQL as a whole
(a learned classifier, XXH64, a tokenizer), so there is no oracle: the operators' tests compare each with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swirlframe.llm import decontaminate, line_dedup, packing, quality, simhash
from swirlframe.llm.common import table, unused, without, written

#: Lines in so many documents are kept in the first of them only.
LINE_MIN_DOCS = 10
#: Near-duplicates: five words, similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    metadata = ("n_chars",) if "n_chars" in docs.columns else ()
    scored = quality.scores(docs, table(spark, sf_dir, "labels"), metadata, score=(name := unused(docs, "score")[0]))
    return scored.filter(F.col(name) >= 0.5).drop(name)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; a document that is left without any text by that goes."""
    names = unused(docs, "n_lines", "n_dropped")
    cleaned = line_dedup.dedup_lines(docs, LINE_MIN_DOCS, keep="first", counts=tuple(names))
    return cleaned.filter((F.col(names[1]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(*names)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near-duplicates."""
    return simhash.first_of_groups(docs, simhash.similar_groups(docs, SIMILARITY, SHINGLE))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's window."""
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter(F.size("hits") > 0).select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of at most 4096 ids."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("lines", unrepeated_lines), ("near_duplicates", one_of_each_group), ("decontaminate", uncontaminated), ("pack", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
