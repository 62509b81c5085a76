"""Evaluation as a file stream: new response files are scored once each, through a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mixlens.operators import evaluate as E
from mixlens.sources.tables import INFERENCE


def read_responses(spark: SparkSession, path: str, schema: str = INFERENCE, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def evaluate_stream(responses: DataFrame, dataset: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score each batch and append it. A batch run again writes the same folder, so no row comes twice."""

    def score(batch: DataFrame, number: int) -> None:
        E.evaluate(batch, dataset).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return responses.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(records: DataFrame, done: DataFrame, retry_failures: bool = False) -> DataFrame:
    """Records whose key is not done. Failed ones count as done unless they are to be tried again."""
    finished = done.filter("success") if retry_failures else done
    return records.join(finished.select(*E.KEY).distinct(), E.KEY, "left_anti")
