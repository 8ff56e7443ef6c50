"""Helpers shared by the corpus operators: table reading, shared scratch tables, Arrow passes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.scratch import scratch_path

#: Rows per Arrow batch handed to Python: texts are long, so batches are kept far below the default 10,000.
BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches of text-carrying stages (a session setting, read when a plan is made)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and returns the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def without(table: DataFrame, names: list[str]) -> DataFrame:
    """A written table without these columns, still known as written."""
    rest = table.drop(*names)
    rest.scratch_path = table.scratch_path
    return rest


def drop_table(table: DataFrame) -> None:
    """Deletes what write_table wrote, once all that was computed from it has been written itself."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's context cleaner drop the shuffle files of finished jobs whose plans are out of use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns the memory that a Python worker has freed to the machine: idle workers would hold it while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; once they end, so does the hold on what making them took."""
    try:
        yield from batches
    finally:
        give_back()


def utf8(col: Column) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(col, F.lit("")).cast("binary")


def add_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """df with further columns computed batch by batch; an input column of the same name is replaced.

    make() runs once per task and returns the function from a batch (all columns of df) to the new arrays.
    """
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    wanted = list(dict.fromkeys([f.name for f in kept] + inputs))
    schema = T.StructType(kept + fields)
    source = df.select(*[quoted(c) for c in wanted])
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept_names] + work(batch), names=kept_names + names)
        del work
        give_back()

    return source.mapInArrow(run, schema)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shielded(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names called otherwise, and the way back to df's columns from a later table."""
    other = {c: c + "_" * (1 + max(map(len, df.columns))) for c in df.columns if c in names}
    away = df.select(*[quoted(c).alias(other.get(c, c)) for c in df.columns])
    return away, lambda later: later.select(*[quoted(other.get(c, c)).alias(c) for c in df.columns])


def texts_of(array: pa.Array) -> list[str]:
    return ["" if x is None else x for x in array.to_pylist()]


#: SQL names of the Arrow types that tables between stages use.
SQL_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}

Fields = dict[str, pa.DataType]


def ddl(fields: Fields) -> str:
    return ", ".join(f"{name} {SQL_NAMES[kind]}" for name, kind in fields.items())


def batch_of(rows: list, fields: Fields) -> pa.RecordBatch:
    """Rows as an Arrow batch."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(fields.values())], names=list(fields))
