"""What the operators share: rows as Arrow batches, tables in the shared folder, keys of documents."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text, as the contracts have them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a local session, all of it in one process, may
    leave it unset; a cluster without the setting is refused."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/weftline-shared"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, and later reads see the same rows.

    The files stay until the folder is cleared: results may be lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow: ``work`` gives dicts of columns for each batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) and x.type == f.type else pa.array(x, f.type) for x, f in ((columns[f.name], f) for f in fields)], schema=fields)

    return df.mapInArrow(run, schema)


def sent(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcast a value whose class the executors may not have: classes of this subpackage travel by value. Its size is the caller's to bound."""
    packed, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def got():
        if not held:
            held.append(pickle.loads(packed.value))
        return held[0]

    return got


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text, no_id):
    """(t1, t2): 128 bits of a text's hash, which with the id tell rows apart; t2 is inverted where the id is null."""
    t2 = F.xxhash64(F.lit(1), text)
    return F.xxhash64(text).alias("t1"), F.when(no_id, F.bitwise_not(t2)).otherwise(t2).alias("t2")


def crc_mod3(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(0))
