"""Pipe-delimited thesaurus tables that come with their own metadata files.

Every line ends with a delimiter and there is no header.  ``MRFILES.RRF`` names
the columns of each file, ``MRCOLS.RRF`` describes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Names of the metadata files and of the columns used from them.
FILES_TABLE, COLUMNS_TABLE = "MRFILES.RRF", "MRCOLS.RRF"
FILE_NAME_AT, COLUMN_LIST_AT = 0, 2
DESCRIBED_COLUMN, DESCRIBED_FILE = "COL", "FIL"
# Columns that receive the nothing after the last delimiter, and a line that
# has too few or too many delimiters.
LINE_END, BROKEN_LINE = "_end", "_broken"


def _delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in [*columns, LINE_END, BROKEN_LINE]])
    return (
        spark.read.schema(schema)
        .option("sep", "|")
        .option("quote", "")
        .option("escape", "")
        .option("header", "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN_LINE)
        .option("columnPruning", "false")  # else only the chosen columns are looked at
        .csv(path)
    )


def column_names(spark: SparkSession, folder: str, filename: str) -> list[str]:
    """Column names of ``filename``, from the metadata row of that file."""
    width = COLUMN_LIST_AT + 1
    metadata = _delimited(spark, f"{folder}/{FILES_TABLE}", [f"_c{i}" for i in range(width)])
    row = (
        metadata.filter(F.col(f"_c{FILE_NAME_AT}") == filename)
        .select(F.split(f"_c{COLUMN_LIST_AT}", ",").alias("names"))
        .first()
    )
    if row is None:
        raise ValueError(f"{filename} is not listed in {FILES_TABLE}")
    return row["names"]


def column_descriptions(
    spark: SparkSession, folder: str, filename: str, columns: list[str] | None = None
) -> DataFrame:
    """Rows of the column description table for one file and the given columns."""
    wanted = columns or column_names(spark, folder, filename)
    table = read_table(spark, folder, COLUMNS_TABLE)
    return table.filter((F.col(DESCRIBED_FILE) == filename) & F.col(DESCRIBED_COLUMN).isin(wanted))


def read_table(
    spark: SparkSession,
    folder: str,
    filename: str,
    columns: list[str] | None = None,
    where: Column | str | None = None,
    line_order: str | None = None,
    broken_lines: str = "raise",
) -> DataFrame:
    """Table with the columns named by the metadata, all strings.

    ``columns`` selects and orders, ``where`` filters the table's own columns in
    the scan.  Only the empty string is null and quotes are plain characters.
    ``line_order`` names an extra column that sorts like the lines of the file.
    A line with too few or too many delimiters is an error when it is read, or
    with ``broken_lines="skip"`` is left out.
    """
    if broken_lines not in ("raise", "skip"):
        raise ValueError("broken_lines must be 'raise' or 'skip'")
    names = column_names(spark, folder, filename)
    chosen = columns or names
    missing = [c for c in chosen if c not in names]
    if missing:
        raise ValueError(f"{filename} has no columns {missing}; it has {names}")
    table = _delimited(spark, f"{folder}/{filename}", names)
    broken = F.col(BROKEN_LINE).isNotNull()
    if broken_lines == "raise":
        said = F.raise_error(F.concat(F.lit(f"{filename} has a broken line: "), BROKEN_LINE))
        table = table.filter(F.when(broken, said.cast("boolean")).otherwise(F.lit(True)))
    else:
        table = table.filter(~broken)
    if where is not None:  # before the line numbers, which no filter passes
        table = table.filter(where)
    selected = [F.col(c) for c in chosen]
    if line_order:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        )
        table = table.select("*", place.alias(line_order))
        selected.append(F.col(line_order))
    return table.select(*selected)
