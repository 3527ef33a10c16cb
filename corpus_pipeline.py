"""A training corpus from the documents table: language, lines, near copies, leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs with the same columns;
the last returns the packed pieces. STAGES lists them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.llm import decontam, langid, linededup, minhash, packing
from codeseam.llm.common import doc_bucket, fresh, written
from codeseam.llm.queries import TOKENIZER, VOCABULARY, table, tokenizer_path

#: A document whose best language has a lower probability is rejected, as one without letters is.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; models come from the labelled rows outside the fold."""
    model = langid.trained(docs.where(doc_bucket("doc_id", 5) != 0), tokenizer_path(VOCABULARY))
    lang, score = fresh(docs.columns, "lang_pred", "score")
    out = langid.identified(docs, model, lang, score)
    return out.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier one."""
    return linededup.line_deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return minhash.deduplicated(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 2048 tokens."""
    return packing.packed(docs, tokenizer_path(TOKENIZER))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("sequences", sequences)]

#: Language models, links by edit distance over classes and packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
