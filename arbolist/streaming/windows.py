"""S-expressions on streams: every function here is stateless, so Structured Streaming's own state does windows and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..sources.tables import parsed


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, ts: str, text: str, path: tuple[int, ...], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows for each window and value at a path; late rows are dropped after `late`."""
    value = C.at_path("sx", path)
    rows = parsed(stream, text).select(F.col(ts), C.sexp_key(value).alias("key"), C.sexp_text(value).alias("value"))
    return rows.withWatermark(ts, late).groupBy(F.window(ts, window), "key", "value").agg(F.count("*").alias("n"))


def distinct_within(stream: DataFrame, ts: str, text: str, late: str = "1 hour") -> DataFrame:
    """Rows without repeats of an equal value within the watermark."""
    keyed = parsed(stream, text).withColumn("sx_key", C.sexp_key("sx"))
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["sx_key"]).drop("sx_key")


def run_to_end(out: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there, into a table in memory (tests and small results only)."""
    query = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.table(name)
