"""What the training-data operators share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes an Arrow batch may hold, so that a worker's memory doesn't follow the text length.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches bounded by rows and by bytes.

    Plans take these settings when they run, after an operator has returned, so they are not put back; a setting that the caller has made stays.
    """
    spark = df.sparkSession
    made = spark.conf.getAll
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if f"spark.sql.execution.arrow.{name}" not in made:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(bound))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder of our own only where that is unset and everything runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or _own_dir(spark.sparkContext.master)).rstrip("/")


@lru_cache
def _own_dir(master: str) -> str:
    """A temporary folder for a session on one machine, removed at exit."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="grainmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/grainmill/{name}-{uuid.uuid4().hex}"


#: Tables written in this process, the innermost scratch() last.
_MADE: list[list[str]] = [[]]


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors. cleanup() or the scratch() around it removes the table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _MADE[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def cleanup(spark: SparkSession) -> None:
    """Removes all intermediate tables of this process from the shared folder; results that weren't saved can't be computed any more."""
    for paths in _MADE:
        _removed(spark, paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the intermediate tables written inside: for code that saves its result before."""
    _MADE.append([])
    try:
        yield
    finally:
        _removed(spark, _MADE.pop())


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of make() from a written table; the intermediate tables that make() needed go."""
    path = new_path(spark, name)
    with scratch(spark):
        made = make()
        made.write.parquet(path)
    _MADE[-1].append(path)
    return spark.read.schema(made.schema).parquet(path)


def map_rows(df: DataFrame, columns: list, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """Arrow batches of the columns through fn."""
    session(df)
    return df.select(*columns).mapInArrow(fn, schema)


def kept_rows(df: DataFrame, column: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """All columns, whatever their names, of the rows for whose value in ``column`` keep gives True; keep sees a batch at a time."""
    session(df)
    at, plain = df.columns.index(column), df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def field(df: DataFrame, name: str):
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
