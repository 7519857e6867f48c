"""Daily maxima and rolling intensities of a stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def daily_max(stream: DataFrame, keys: list[str], ts: str, value: str, late: str = "1 hour") -> DataFrame:
    """date and highest value by key in tumbling days; rows later than the watermark are dropped."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    v = F.when(~F.isnan(value), F.col(value))
    out = rows.groupBy(F.window("_ts", "1 day").alias("w"), *keys).agg(F.max(v).alias("value_max"))
    return out.select(*keys, F.to_date("w.start").alias("date"), "value_max")


def rolling_total(stream: DataFrame, keys: list[str], ts: str, value: str, hours: int, late: str = "1 hour") -> DataFrame:
    """Sums over the last hours at each full hour, as sliding windows."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = rows.groupBy(F.window("_ts", f"{hours} hours", "1 hour").alias("w"), *keys).agg(F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.end").alias("hour"), "total")


def write_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends closed windows to Parquet; once takes what is there and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
