"""The corpus pipeline: quality, line dedup, near-dedup, mixing, BPE. Part of the subpackage llm.

Stages take (spark, docs, sf_dir) and give a DataFrame; each is written as Parquet to the shared folder and read again
as the next stage's docs. All but the last return the columns of documents.

Defined cases, in every stage: an empty table gives an empty result; other columns, whatever their names, pass through all
stages but the last; repeated rows share their fate, but near-dedup keeps each row of the smallest doc_id. Null texts have
importance 0 in the first stage, no lines in the second, count as empty and alike to other empty ones in the third, have
size 0 in the fourth and no tokens in the fifth. Null doc_ids come last where order matters. Very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import bpe, jaccard, lines, mix, quality
from vexel.llm.common import fresh, stored, table
from vexel.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes; the others go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, n_chars counted anew. A document that has lost all its lines stays, empty."""
    total, removed = fresh(docs, "total", "removed")
    out = lines.dedup_lines(docs, counts=(total, removed), short=lines.SHORT_CHARS)
    if "n_chars" in docs.columns:
        n = F.when(F.col(removed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n)
    return out.drop(total, removed)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id.

    Documents link at a Jaccard similarity of five-word shingles of 0.8 or more; SimHash with ball hashing gives the
    candidates, MinHash bands those beyond its radius. A null doc_id stays only where the component has no other.
    """
    groups = jaccard.similar_groups(docs, width=5)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first_id")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["first_id"]), "left_semi")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mix.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of tokens and of decoded text."""
    return bpe.encode_digests(docs, tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near", near_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: Several stages can't be put as SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
