"""A training corpus from the documents table in five stages.

1. language: documents whose language cannot be told go; a document without a label gets the predicted one.
   Without a labelled document nothing can be told and all stay.
2. near duplicates: documents whose 5-word shingles have a Jaccard similarity of 0.8 or more link, and of linked ones
   that with the smallest doc_id stays. Candidates come from fingerprints, every link is checked.
3. secrets: every secret found is replaced by a mark, and n_chars follows.
4. mixing: every document is repeated or left out as the target shares of the sources ask.
5. tokens: token ids of every whole text as a digest, and the digest of the text they decode to.

Every stage takes what its predecessor kept. The first four return the columns of documents. A row
without doc_id is identified by its text; rows that repeat a doc_id are one document, of which stage 2 keeps
the row with the smallest text hash. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakfree.llm.common import free_name
from leakfree.llm.language import UNDETERMINED, identified, train
from leakfree.llm.mixing import mixed_documents
from leakfree.llm.near_copies import near_copies
from leakfree.llm.pieces import op9_sentencepiece
from leakfree.llm.secret_scan import redact_secrets
from leakfree.session import drop_stage, scratch

MIN_SCORE = 0.3
"""Documents whose language score is below go, with those that have no letter."""


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with the label they have or else the predicted one.

    A null text and one without letters go. Null keys and sources, repeated rows and other columns are kept. Without a labelled
    document, as in an empty table, all rows stay.
    """
    with scratch(spark):
        model = train(docs)
    if not model.families:
        return docs
    found = free_name(docs, "language_found")
    told = docs.withColumn(found, identified(docs, model))
    kept = told.where((F.col(f"{found}.lang_pred") != UNDETERMINED) & (F.col(f"{found}.score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", f"{found}.lang_pred")).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id.

    A row without doc_id is known by its text's hash. Rows that repeat a doc_id are one document, of which the row with the smallest
    text hash stays. Null and empty texts are copies of each other. An empty table gives no rows, other columns are kept.
    """
    text_hash, key = F.xxhash64("text"), free_name(docs, "dedup_key")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), text_hash))
    with scratch(spark) as block:
        classes = near_copies(keyed, key=key)
        keepers = block.keep(classes.where("key = component").select(F.col("key").alias(key)).distinct(), "keepers")
    first, place = Window.partitionBy(key).orderBy(text_hash), free_name(docs, "dedup_place")
    kept = keyed.join(keepers, key, "left_semi").withColumn(place, F.row_number().over(first))
    return kept.where(F.col(place) == 1).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced by a mark; n_chars follows where a text has changed.

    Null and empty texts stay as they are, as do null keys, repeated rows and other columns; an empty table gives no rows.
    """
    was = free_name(docs, "text_before")
    cleaned = redact_secrets(docs.withColumn(was, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(was))
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target shares of the sources ask; see ``mixed_documents`` for nulls, repeats and empty tables."""
    return mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; a null text is encoded as an empty one, an empty table gives no rows."""
    return op9_sentencepiece(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", tokens_stage),
]

#: SQL cannot express the trained models, the fingerprints' hash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document copy of the mix.

    A stage's tables go as soon as its result is written; only the last stage's input is left.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as block:
            after = block.keep(stage(spark, docs, sf_dir), "corpus")
        drop_stage(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
