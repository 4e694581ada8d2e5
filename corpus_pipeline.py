"""A corpus from raw documents to token ids, in five stages that each are one operator.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes
every stage as Parquet and reads it again. Other columns than doc_id, text and n_chars go through
unread, as one, so whatever they are called they are not taken for an operator's own. Stages judge a row by its own text, so rows that repeat a doc_id or hold none are no
exception; an empty table stays empty, with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, decontaminate, pseudonyms, quality_knn, simhash
from barloom.llm.common import Scratch, documents
from barloom.llm.queries import PSEUDONYM_KEY


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others).alias("others")) if others else docs


def together(made: DataFrame, docs: DataFrame, **changed: F.Column) -> DataFrame:
    """The columns of `docs` again, some of them changed."""
    plain = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c)
    return made.select(*[changed.get(c, plain(c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for label 1: a score of 0.3 or more. Null, empty and
    other texts without terms have the share of label 1 as their score, and so are kept or go together."""
    scored = quality_knn.score_quality(apart(docs), documents(spark, sf_dir, "labels"), threshold=0.3)
    return together(scored.where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are similar by 0.8 or more, directly or over others,
    the one with the smallest doc_id, nulls last; ties are broken by the text and then by the columns.
    Shorter texts are one shingle; null, empty and blank texts are equal, so one of them stays."""
    return together(simhash.one_of_each(apart(docs), words=5, similarity=0.8), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark occurs with 5 % of edits; null and empty texts stay."""
    return together(decontaminate.clean(apart(docs), documents(spark, sf_dir, "benchmark")), docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars counts the new text. A null text stays null."""
    changed = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return together(pseudonyms.pseudonymise(apart(docs), PSEUDONYM_KEY), docs, **changed)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the byte-level encoding, a row a row; null counts as empty."""
    return byte_bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("private_data", private_data), ("token_ids", token_ids)]

#: SQL can express neither the classifier nor the encoder; the tests hold each stage against a second, plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. What a stage has written in between is freed after it."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        since = len(Scratch.made)
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.release(since)
        if number:
            scratch.drop(STAGES[number - 1][0])
    return docs
