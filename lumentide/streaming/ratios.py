"""Label shares over time from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentide.operators.tables import new_path


def windowed_counts(events: DataFrame, time: str, label: str, width: str = "1 day", late: str = "31 days") -> DataFrame:
    """Counts of each label in each window, whose start has no time zone, as event times have none; events later than `late` behind the newest are left out, which bounds the state."""
    instant = F.expr(f"timestamp'1970-01-01 00:00:00Z' + (cast(`{time}` as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00')")
    counts = events.withColumn(time, instant).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), label).agg(F.count("*").alias("n"))
    return counts.select(F.expr("timestamp_ntz'1970-01-01 00:00:00' + (w.start - timestamp'1970-01-01 00:00:00Z')").alias("start"), label, "n")


def label_ratios(spark: SparkSession, folder: str, glob: str, schema: str, time: str, label: str, width: str = "1 day") -> DataFrame:
    """Runs the stream over what is in the folder and gives counts and shares of labels in each window.

    Every batch writes the windows it changed; the latest count of each stands. Progress is kept in the shared folder, so
    a restarted query goes on where the last one ended.
    """
    out, state = new_path(spark, "stream-counts"), new_path(spark, "stream-state")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:010d}")  # a batch that runs again writes the same

    counts = windowed_counts(stream, time, label, width)
    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(f"start timestamp_ntz, `{label}` string, n long, batch int").option("recursiveFileLookup", "true").parquet(out)
    last = got.groupBy("start", label).agg(F.max_by("n", "batch").alias("n"))
    total = last.groupBy("start").agg(F.sum("n").alias("t"))
    return last.join(total, "start").select("start", label, "n", (F.col("n") / F.col("t")).alias("ratio"))
