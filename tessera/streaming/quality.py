"""Structured Streaming: apply a cleaning plan fitted on a batch table to a stream,
and keep per-window data-quality counts.

Every transform of a fitted plan is a narrow projection/filter with literal
parameters (fences, fill values, scale groups), so it runs unchanged on a
streaming DataFrame. Quality counts are a watermarked tumbling-window
aggregation (bounded state, late rows beyond the watermark are dropped by Spark)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.operators.outliers import IqrBounds, ScaleGroups
from tessera.plans.cleaning import CleaningPlan
from tessera.session import ensure_checkpoint_dir


def parquet_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over a Parquet folder, or over one file (its folder filtered to
    that file name)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # the path's own file system: local, hdfs, object store
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader = reader.option("pathGlobFilter", place.getName())
        path = place.getParent().toString()
    return reader.parquet(path)


def clean_stream(plan: CleaningPlan, stream: DataFrame) -> DataFrame:
    """The fitted plan's transform on a streaming DataFrame (stateless)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return plan.transform(stream)


def quality_counts(stream: DataFrame, time_col: str, window: str, bounds: IqrBounds,
                   groups: ScaleGroups | None = None, watermark: str = "10 minutes",
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Per event-time window: rows, null cells, outlier cells, straight-liners."""
    cols = [c for c in (columns or stream.columns) if c != time_col]
    nulls = F.lit(0).cast("long")
    for c in cols:
        nulls = nulls + col(c).isNull().cast("long")
    outs = F.lit(0).cast("long")
    for c in bounds.columns:
        outs = outs + bounds.flag(c).cast("long")
    sl = groups.flag() if groups is not None else F.lit(False)
    if stream.schema[time_col].dataType.simpleString() != "timestamp":
        stream = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))  # watermarks need TIMESTAMP
    return (stream.withWatermark(time_col, watermark)
                  .groupBy(F.window(time_col, window).alias("window"))
                  .agg(F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("null_cells"),
                       F.sum(outs).alias("outlier_cells"), F.count_if(sl).alias("straightliners")))


def run_to_table(stream: DataFrame, output_mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a streaming query over everything available (``availableNow``), write it
    as Parquet under the session's checkpoint folder (shared storage on a cluster),
    and return the written table as a batch DataFrame."""
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark)
    run = f"{name}-{uuid.uuid4().hex[:12]}"
    out, ckpt = os.path.join(base, "streams", run, "data"), os.path.join(base, "streams", run, "checkpoint")
    q = (stream.writeStream.format("parquet").outputMode(output_mode).option("path", out)
               .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
