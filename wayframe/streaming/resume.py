"""The restartable runner as a stream: a file source, the batch operator per micro-batch, and a checkpoint as the restart boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.runner import predictions


def stream_predictions(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, predictor, parser, files: int = 4, **options) -> None:
    """Predict the records of all files that no earlier run has seen, append them to out, and stop.

    A micro-batch that is run again after a failure overwrites its own folder, so no id is written twice.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        predictions(batch, predictor, parser, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
