"""Cleaning pipeline over ``documents``: five stages of the ``llm`` operators.

Toxic documents go; of equal texts the one with the largest id stays; of near
duplicates the one with the smallest id; contaminated documents go; the rest is
packed into token windows.  Every stage works on the whole of what the stage
before kept and is written and read again.

No stage but the last drops a document that its operator does not name, so
clean documents pass whatever their text: null and empty texts too (of several
empty texts one stays, as they are equal).  Stages match documents by a 64-bit
hash of id and text, a null id included: a decision against one of several texts
under an id leaves the others, and 12 million documents (30 GB) have 4e-6 wrong
pairs.  Rows that repeat an id and a text are one document to every stage and
stay or go together; a null id names no document, so of rows with a null id and
equal texts exact deduplication keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortvec.llm.decontamination import contamination
from cohortvec.llm.exact_dedup import exact_duplicates
from cohortvec.llm.jaccard_join import near_duplicate_groups
from cohortvec.llm.packing import pack_documents
from cohortvec.llm.sizes import join_counted, keep_rows, row_key, store_counted
from cohortvec.llm.toxicity import THRESHOLD, fit_toxicity, toxicity_score
from cohortvec.session import store

#: Toxicity is learned, not expressible in SQL.
ORACLE_SQL = None


def _documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones."""
    model = fit_toxicity(docs.select("doc_id", "text"), _documents(spark, sf_dir, "labels"))
    return docs.filter(toxicity_score(F.col("text"), model) < THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id.

    A null id is the smallest; of several the row with the smallest columns stays.
    """
    gone = exact_duplicates(docs).filter(~F.col("kept")).select(row_key("doc_id", F.col("text_sha256")))
    text = F.coalesce("text", F.lit(""))
    kept = keep_rows(docs, gone, row_key("doc_id", F.sha2(text.cast("binary"), 256)), "exact-gone")
    unnamed = kept.filter(F.col("doc_id").isNull()).groupBy(text).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.filter(F.col("doc_id").isNotNull()).unionByName(unnamed.select("row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    A null id is the largest; several texts under the smallest id, or under null
    alone, come in the order of their hash.
    """
    key = row_key("doc_id", F.col("text"))
    rows = docs.select("doc_id", "text", key.alias("_row"))
    groups = near_duplicate_groups(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    groups, _ = store_counted(groups.distinct(), "near-groups")
    several, n = store_counted(groups.filter(F.col("_row") != F.col("_group")).select("_group").distinct(), "near-several")
    members, n = store_counted(join_counted(groups, several, n, ["_group"], "left_semi"), "near-members")
    named, n = store_counted(join_counted(rows.select("_row", "doc_id"), members, n, ["_row"]), "near-named")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = named.groupBy("_group").agg(F.min(order)["_row"].alias("_first"))
    gone = named.join(first, "_group").filter(F.col("_row") != F.col("_first")).select("_row")
    return keep_rows(docs, gone, key, "near-gone")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows, or with too few of their words in them."""
    key = row_key("doc_id", F.col("text"))
    rows = docs.select("text", key.alias("_row"))
    found = contamination(rows, _documents(spark, sf_dir, "benchmark"), id_col="_row")
    return keep_rows(docs, found.filter("contaminated").select("doc_id"), key, "contaminated")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in the token windows."""
    packed = pack_documents(docs)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read back."""
    docs = _documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}").df
    return docs
