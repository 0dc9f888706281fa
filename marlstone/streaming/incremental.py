"""The incremental loop as a stream: found addresses come in, the item table goes on from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import state

ITEM_SCHEMA = "source_id string, original_url string, status string, attempt_count int, last_error string, article_id string, discovered_at string, updated_at string"


def discover_stream(found: DataFrame, folder: str, checkpoint: str, as_of: str, keep: int = 3):
    """Write a snapshot of the items to ``folder`` for every batch of ``found`` (source_id, original_url).

    A batch that is run again writes the same snapshot again: it starts from the one before it. Of the
    snapshots the last ``keep`` stay, two at least.
    """
    spark = found.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = f"{folder}/batch={number - 1}"
        items = spark.read.schema(ITEM_SCHEMA).parquet(before) if number else spark.createDataFrame([], ITEM_SCHEMA)
        state.discover(items, batch, F.lit(as_of)).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={number - max(2, keep)}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return found.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
