"""A corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinloom.llm import bpe, langid, linededup, mixing, similar
from coinloom.llm.common import materialize, table
from coinloom.llm.queries import learn_languages, tokenizer_json


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the language model finds no language go; where none could be learned, those without letters. All columns stay."""
    model = learn_languages(docs)
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.classify(docs, model).where("lang_pred <> 'und'").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages go, whole lines or not; every document stays, n_chars follows its text."""
    kept = linededup.drop_repeated_runs(docs)
    return kept.withColumn("n_chars", F.when(F.col("__deleted_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash of five-word shingles, similarity 0.8) the document with the smallest id stays, of repeated rows one."""
    return similar.keep_first(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(mixing.mix(docs)).select(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids."""
    coded = bpe.encode(docs, tokenizer_json(), keep=("doc_id", "lang", "source"))
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL can't express the learned and hashed stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
