"""The batch as a stream: new documents are vetted once, and the approved ones' records appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def vet_new(spark: SparkSession, folder: str, schema: str, vet: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a query that vets the Parquet files that appear in a folder; its checkpoint remembers the ones done.

    A batch that is run again after a failure overwrites its own folder, so no record is written twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        vet(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
