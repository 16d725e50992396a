"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a write go when it ends, and not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that go with the innermost ``passing``, if there is one.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session (tests) may go without the setting; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:/tmp/quirefold-shared"


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/quirefold/{spark.sparkContext.applicationId}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage, outlives executors.

    ``codec``: of its Parquet files, if not the session's.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (going := _passing.get()) is not None:
        going.append(path)
    with tidy(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Tables that are stored inside go at its end; what it yields is ``stored`` for those that stay.

    Only tables that no later plan reads may go, so results of lazy plans are stored inside.
    """
    around, going = _passing.get(), []

    def lasting(*args, **kwargs) -> DataFrame:
        mark = _passing.set(around)
        try:
            return stored(*args, **kwargs)
        finally:
            _passing.reset(mark)

    mark = _passing.set(going)
    try:
        yield lasting
    finally:
        _passing.reset(mark)
        for path in going:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application has stored; no query may still read them."""
    delete(spark, own_dir(spark))
