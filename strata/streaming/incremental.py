"""The questionnaire loader and the executive summary over a folder that keeps
receiving files (Structured Streaming). Nothing here is a new operator: the stream
reads with the same fixed schema, applies the same ``clean`` and the same summary
aggregate; Spark keeps the per-stage aggregation state in the checkpoint folder and
re-emits the complete summary after each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.clean import clean
from strata.plans.queries import executive_summary
from strata.sources.cohort import CSV_QUOTING, TEXT_SCHEMA, typed_cells
from strata.sources.sinks import shared_scratch


def read_questionnaire_stream(spark: SparkSession, input_dir: str, max_files_per_trigger: int = 100,
                              multi_line: bool = False) -> DataFrame:
    """Header CSV files arriving in ``input_dir`` with the fixed 32-column schema.

    Streamed rows carry no surrogate key (``id`` is NULL): a position-based id is not
    available to a stream, and the summary never reads the key."""
    df = (spark.readStream.schema(TEXT_SCHEMA).option("header", True).option("enforceSchema", False)
          .option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("maxFilesPerTrigger", max_files_per_trigger).option("multiLine", multi_line).options(**CSV_QUOTING).csv(input_dir))
    return df.select(F.lit(None).cast("long").alias("id"), *typed_cells())


def summary_stream(spark: SparkSession, input_dir: str) -> DataFrame:
    """Streaming DataFrame of the executive summary (complete-mode aggregate)."""
    return executive_summary(clean(read_questionnaire_stream(spark, input_dir)))


def start_summary_stream(spark: SparkSession, input_dir: str, output_path: str,
                         checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Keep ``output_path`` (Parquet) equal to the summary of every file seen so far.

    Each micro-batch carries the complete summary (a handful of rows) and overwrites
    the output; the batch id makes a replayed batch rewrite the same result.
    """
    checkpoint = checkpoint or shared_scratch(spark, "stream-ckpt")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(output_path)

    writer = (summary_stream(spark, input_dir).writeStream.outputMode("complete")
              .option("checkpointLocation", checkpoint).foreachBatch(write))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
