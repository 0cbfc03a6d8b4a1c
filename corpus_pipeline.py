"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, quality, similar
from tidemark.llm.common import cut, made, remove, table, text_key
from tidemark.llm.queries import TOKENIZERS

#: The columns that all stages but the last return.
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are.

    Null texts are judged as empty ones; null languages and sources are groups of their own; all rows
    of repeated documents are judged alike; without labels of both kinds all stay; no documents give
    none. Columns beyond those of documents go."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).filter("accepted").select(*DOCUMENTS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has in a repeated chunk or in a run
    of over 50 words.

    Null texts stay null, empty ones empty; a text may become empty, but no row goes; rows repeated
    with one id and text keep the same lines; of equal chunks that of the smallest id stays; n_chars
    is counted anew where lines went. No documents give none. Columns beyond those of documents go."""
    return line_dedup.dedup_lines(docs.select(*DOCUMENTS)).select(*DOCUMENTS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more of their 5-word shingles alike) the document with
    the smallest id.

    Null, empty and wordless texts are alike. Rows without an id are never dropped; rows repeated with
    one id and text are one document and stay together; of rows of one id with other texts each is
    judged by its own. No documents give none. Columns beyond those of documents go."""
    found = similar.near_duplicates(docs)
    kept = found.filter("doc_id is not null and component_id = doc_id").select("doc_id", "text_key").distinct()
    rows = docs.filter("doc_id is not null").select(*DOCUMENTS, text_key(F.col("text")).alias("text_key"))
    return rows.join(kept, ["doc_id", "text_key"], "left_semi").select(*DOCUMENTS).unionByName(docs.filter("doc_id is null").select(*DOCUMENTS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no word inside a window of the benchmark, as they are.

    Null and empty texts have no words and stay; without items all stay; repeated rows stay or go
    together. No documents give none. Columns beyond those of documents go."""
    return decontaminate.decontaminate(docs.select(*DOCUMENTS), table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*DOCUMENTS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian, 32 bits each), how many, and SHA-256 digests of
    them and of what they decode to.

    Null texts are encoded as empty ones, with no ids; repeated rows stay. No documents give none."""
    out = bpe.round_trip(docs, f"{TOKENIZERS}/byte_bpe_50k.json", keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The stages train a classifier, hash with XXH64 and encode with a vocabulary: SQL can't say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next. What a
    stage wrote on its way is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with made() as paths:
            docs = cut(stage(spark, docs, sf_dir), name)
        remove(spark, paths[:-1])  # the last is the result
    return STAGES[-1][1](spark, docs, sf_dir)
