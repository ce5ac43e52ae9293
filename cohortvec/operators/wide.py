"""Wide tables from long ones, for any number of columns.

Column numbers come from an index over the names; a key's values are one row of
numbered cells, which tasks lay out in Arrow, a block of rows at a time.  Only
the names themselves reach the driver, as a table's columns have to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_arrow_batches
from .indexing import attach_index, build_key_index

# Numbers of a block of rows that is laid out at a time.
BLOCK_CELLS = 1_000_000

ARROW_TYPES = {"double": pa.float64(), "bigint": pa.int64()}


def wide_table(
    long: DataFrame,
    key: str,
    column: str,
    values: list[str],
    fill: int | None = None,
    beside: DataFrame | None = None,
    order: list[Column] | None = None,
) -> DataFrame:
    """One row per ``key`` with the ``values`` (double or bigint) of every name in ``column``.

    Columns follow the sorted names: the name itself for a single value, else
    ``<name>_<value>`` for each.  A cell that is missing is ``fill`` or null.
    ``long`` has unique (key, column) rows and is read twice.  Columns of
    ``beside``, joined on the key, come last; rows are sorted by ``order`` before
    they are laid out.  Runs jobs for the index.
    """
    bound_arrow_batches(long.sparkSession)
    index = build_key_index(long.filter(F.col(column).isNotNull()), column, "_at")
    names = [r[column] for r in index.table.orderBy("_at").select(column).collect()]
    cell = F.struct(F.col("_at").cast("int").alias("at"), *values)
    rows = attach_index(long, index, [key]).groupBy(key).agg(F.collect_list(cell).alias("_cells"))
    others = [] if beside is None else [c for c in beside.columns if c != key]
    if beside is not None:
        rows = rows.join(beside, key)
    if order:
        rows = rows.orderBy(*order)
    kinds = {v: long.schema[v].dataType.simpleString() for v in values}
    fields = [rows.schema[key]]
    for name in names:
        fields += [T.StructField(name if len(values) == 1 else f"{name}_{v}", long.schema[v].dataType) for v in values]
    fields += [rows.schema[c] for c in others]
    schema, width = T.StructType(fields), len(names)

    def lay_out(part: pa.RecordBatch) -> pa.RecordBatch:
        cells = part.column("_cells")
        row_of = np.repeat(np.arange(part.num_rows), np.asarray(cells.value_lengths()))
        flat = cells.flatten()
        at = flat.field("at").to_numpy(zero_copy_only=False)
        columns = {}
        for v, kind in kinds.items():
            found = flat.field(v)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            matrix = np.zeros((part.num_rows, width), np.float64 if kind == "double" else np.int64)
            missing = np.ones(matrix.shape, bool)
            matrix[row_of, at] = found.fill_null(0).to_numpy(zero_copy_only=False)
            missing[row_of[known], at[known]] = False
            if fill is not None:
                matrix[missing], missing[:] = fill, False
            columns[v] = matrix, missing
        out = [part.column(key)]
        for j in range(width):
            out += [pa.array(matrix[:, j], ARROW_TYPES[kinds[v]], mask=missing[:, j]) for v, (matrix, missing) in columns.items()]
        out += [part.column(c) for c in others]
        return pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(BLOCK_CELLS // max(width * len(values), 1), 1)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                yield lay_out(batch.slice(start, step))

    return rows.mapInArrow(run, schema)
