"""Lineage cuts and row numbering that stay distributed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local master without the setting gets a folder of its own: there all
    tasks share one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
        named = tempfile.mkdtemp(prefix="kinshelf-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has written to yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def removing_steps(spark: SparkSession):
    """Delete, at the end, the steps that operators wrote to the shared folder inside.

    Results read those steps, so write or collect what is wanted before the end.
    """
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not made]
        conf = spark._jsc.hadoopConfiguration()
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Shuffle files of what is written inside go as soon as it is written.

    Otherwise they stay until the driver happens to collect its garbage, so that the
    shuffles of all steps would lie on the disks together.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def write_step(df: DataFrame, path: str, mode: str = "error", by: Sequence[str] = ()) -> None:
    """Write ``df`` to the shared folder, small, and without leaving shuffle files behind."""
    with dropping_shuffles(df.sparkSession):
        writer = df.write.mode(mode).option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and go on from the written table.

    A lost executor then replays one step and not the whole past. The plan starts
    anew as well, with the true size of the table; a checkpointed plan would carry
    the constraints of all earlier rounds along.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "step")
    write_step(df, path)
    return spark.read.schema(df.schema).parquet(path)


def one_step(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is one written step: those it wrote on the way go when that is there."""

    @wraps(make)
    def made(*args, **kwargs) -> DataFrame:
        spark = SparkSession.active()
        path = fresh_path(spark, "step")
        with removing_steps(spark):
            df = make(*args, **kwargs)
            write_step(df, path)
        return spark.read.schema(df.schema).parquet(path)

    return made


#: Documents whose words move in one round, about, and most rounds.
ROUND_DOCUMENTS, ROUNDS = 16_384, 16


def rounds_for(documents: int | None) -> int:
    return max(1, min(ROUNDS, -(-(documents or 0) // ROUND_DOCUMENTS)))


def in_rounds(
    rows: DataFrame, by: list[str], rounds: int, make: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]
) -> DataFrame:
    """``make(part, mine)`` of all ``rows``, a part after the other: what lies on disk at once is that of a part.

    Rows with one value of ``by`` are in one part; ``mine`` tells the rows of another table
    that belong to it. What a round wrote on the way goes with it. One round is not written.
    """
    if rounds == 1:
        return make(rows, lambda other: other)
    spark, number = rows.sparkSession, F.pmod(F.xxhash64(*by), F.lit(rounds)).cast("int")
    path, found = fresh_path(spark, "rounds"), None
    with removing_steps(spark):
        laid = fresh_path(spark, "laid")
        write_step(rows.withColumn("_round", number), laid, by=["_round"])
        schema = StructType([*rows.schema.fields, StructField("_round", IntegerType())])
        for now in range(rounds):
            with removing_steps(spark):
                part = spark.read.schema(schema).parquet(laid).where(F.col("_round") == now).drop("_round")
                found = make(part, lambda other, now=now: other.where(number == now))
                write_step(found, path, "append")
    return spark.read.schema(found.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Share out a scan of fewer files than there are cores.

    A large collection has more files than cores and is left as it is, and so is
    anything that is no file scan. Nothing runs to find out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def number_rows(
    df: DataFrame, by: list[str], order: list[Column], name: str = "ordinal"
) -> DataFrame:
    """1-based position of each row within ``by``, sorted by ``order``.

    ``row_number`` alone would sort a whole group in one task. Here the sort is a
    range partitioning; each slice numbers its own rows and adds the row counts of
    the slices before it.
    """
    keys = [F.col(c) for c in by] + order
    sliced = cut_lineage(
        df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id())
    )
    local = Window.partitionBy("_slice", *by).orderBy(*order)
    before = (
        Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy("_slice", *by)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return (
        sliced.withColumn("_local", F.row_number().over(local))
        .join(offsets, ["_slice", *by])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_slice", "_local", "_offset")
    )
