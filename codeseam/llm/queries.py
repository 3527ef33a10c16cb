"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontam, fingerprint, infill, langid, linededup, lm, minhash, packing, pii, setjoin, toxicity, urlfilter
from .common import doc_bucket

TOKENIZER, VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"
#: The key of the pseudonyms; a deployment passes its own secret to pii.pseudonymized().
PII_KEY = "replace-me"
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@cache
def tokenizer_path(name: str) -> str:
    if importlib.util.find_spec("public_tokenizers") is None:
        return f"/opt/tokenizers/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(doc_bucket("doc_id", 4) == 2, F.lit(True))
    settings = toxicity.Settings()
    machine = toxicity.trained(docs.where(~held), table(spark, sf_dir, "labels"), settings)
    out = toxicity.scored(docs, machine, settings)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymized(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", *(f"n_{k}" for k in pii.KINDS), "n_values")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judged(table(spark, sf_dir, "pages"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(doc_bucket("doc_id", 5) == 0, F.lit(True))
    model = langid.trained(docs.where(~held), tokenizer_path(VOCABULARY))
    out = langid.identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(doc_bucket("doc_id", 7) == 2, F.lit(True))
    out = lm.scored(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_sets(table(spark, sf_dir, "documents"), percent=90)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.filled_in(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored("form", "output")).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_pii, op4_near_duplicates, op5_line_dedup, op6_fingerprints, op7_packing, op8_url_filter, op9_language, op10_lm, op11_filter_audit, op12_set_join, op13_fill_in_middle)}
