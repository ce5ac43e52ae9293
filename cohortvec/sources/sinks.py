"""Results on storage.  An existing location is never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR = "embedding"
COLUMN_PREFIX = "emb_vec_"


def wide_embeddings(embeddings: DataFrame, vector: str = VECTOR, prefix: str = COLUMN_PREFIX) -> DataFrame:
    """One column per dimension; reads one row for the number of dimensions."""
    first = embeddings.select(F.size(vector).alias("n")).first()
    dimensions = first["n"] if first else 0
    others = [c for c in embeddings.columns if c != vector]
    return embeddings.select(*others, *[F.col(vector)[j].alias(f"{prefix}{j}") for j in range(dimensions)])


def write_embeddings(embeddings: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Parquet with the vector as array, or CSV with one column per dimension."""
    if file_format == "csv":
        wide_embeddings(embeddings).write.mode("errorifexists").option("header", "true").csv(path)
    elif file_format == "parquet":
        embeddings.write.mode("errorifexists").parquet(path)
    else:
        raise ValueError("file_format must be 'parquet' or 'csv'")


def write_index(index: DataFrame, path: str, file_format: str = "parquet") -> None:
    index.write.mode("errorifexists").option("header", "true").format(file_format).save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("errorifexists").json(path)
