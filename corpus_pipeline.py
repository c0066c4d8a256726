"""A corpus pipeline of five operators: quality, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
reread as the next stage's docs. All but the last keep the columns of documents.

In every stage: null and empty texts are texts without words, and stay; null ids are
ids like others, but are no copies of each other; rows may repeat; extra columns are kept,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.decontaminate import decontaminate
from tessella.llm.jaccard import jaccard_components
from tessella.llm.pack import pack
from tessella.llm.pii import sanitised
from tessella.llm.quality import accepted, held_out, train
from tessella.llm.store import mark, small, sweep, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled rows of these documents, accepts.

    Null and empty texts are scored as texts without features; repeated rows get one score and stay or go together.
    Labels that are null or of ids that are not here are unused; without any usable label all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return accepted(docs, train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows without an id or without words stay.

    Word shingles are of five words and links have a Jaccard of 0.8 or more; the four words and 0.85 of ``op9_jaccard`` are that query's.
    Rows that repeat an id are one document: of these the smallest row, column by column, stays (nulls first).
    """
    found = written(jaccard_components(docs, k=5, percent=80), "components")
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    own = docs.select(F.struct(*docs.columns).alias("own"))  # one name, so that none of theirs can clash
    kept = own.join(small(gone), F.col("own.doc_id") == F.col("gone"), "left_anti")
    again = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "again")
    if again.head(1):
        repeated = F.col("own.doc_id") == F.col("again")
        one = kept.join(small(again), repeated, "left_semi").groupBy(F.col("own.doc_id").alias("id")).agg(F.min("own").alias("own")).select("own")
        kept = kept.join(small(again), repeated, "left_anti").unionByName(one)
    return kept.select("own.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; of rows that share an id, all go if one holds a window."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("hit")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("own"))
    return own.join(small(written(found, "contaminated")), F.col("own.doc_id").eqNullSafe(F.col("hit")), "left_anti").select("own.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised and disclosing terms removed; null texts stay null, ``n_chars`` is recounted where a text changed."""
    return sanitised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is its end token alone."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packing),
]

#: The classifier, the components and the packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            sweep(spark, since, [docs])
    return docs
