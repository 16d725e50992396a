"""Extension: converts documents as their decoded lines arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from quirefold.plans.convert import ConvertOptions, convert


def convert_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType, options: ConvertOptions | None = None):
    """Each batch of new files of lines (whole documents) is converted into a folder ``batch=n`` of ``target``.

    A batch that runs again replaces its own folder, so its sections are there once.
    """
    lines = spark.readStream.schema(schema).parquet(source)

    def batch(df, n: int) -> None:
        convert(df, options=options).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
