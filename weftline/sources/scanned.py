"""Scans of whole files by Python: files are dealt to tasks, and what is found comes in batches of many rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch.
ROWS = 8192


def dealt(files: DataFrame, *keys: str) -> DataFrame:
    """Files by the hash of keys in as many parts as shuffles have: a table that is small on disk is one split, and one task would scan it all."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def large(df: DataFrame) -> DataFrame:
    """Rows that are joined by sorting. Spark takes the size of what a scan or an explode gives for that of its input, and would send it whole
    through the driver to broadcast it."""
    return df.hint("merge")


def batched(rows_of: Callable[[Iterable], Iterable[tuple]], ddl: str) -> Callable[[Iterable], Iterable]:
    """A function of Arrow batches that gives what ``rows_of`` makes of them (rows, as ddl has them) in batches of ROWS rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        rows = iter(rows_of(batches))
        while held := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def scanned(files: DataFrame, columns: list[str], rows_of: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """The rows (as ddl has them) that ``rows_of`` gives for the columns of each file, the first of which is its key."""

    def rows(batches):
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from rows_of(*values)

    return large(dealt(files.select(*columns), columns[0]).mapInArrow(batched(rows, ddl), ddl))
