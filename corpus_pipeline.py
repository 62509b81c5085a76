"""From documents to training data: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever further columns these have.

Documents without text or without a letter go in the first stage, as they are of no language. Repeated rows are near
copies of each other, of which one stays; a null doc_id, lang or source is a value like any other. Empty tables give empty
tables, and no token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.llm import decontaminate, jaccard, language, mixing, token_files
from mixlens.llm.common import drop_stored, stored, table, unused

#: Near copies, on word shingles: five words, a similarity of 0.8.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language: without a letter, or as near to the second language as to the first if not short."""
    lang, score = unused(docs, "predicted", "clearness")
    found = language.identify(docs, language.samples(docs), names=(lang, score))
    clear = (F.col(score) >= language.MIN_SCORE) | (language.letters(F.col("text")) < language.MIN_LETTERS)
    return found.filter((F.col(lang) != language.UNKNOWN) & clear).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return jaccard.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other numbers or names."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents as the mix of sources takes their words."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files; return what they hold of each document."""
    import public_tokenizers

    return token_files.read_digests(token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("source mix", mix_sources),
    ("token files", write_token_files),
]
#: Cross-parsing, near-copy components and byte-pair encoding have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if k:
            drop_stored(docs)
        docs = made
    return docs
