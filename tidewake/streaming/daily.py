"""Process position files once, as they arrive.

The file source keeps the list of processed files in its checkpoint. A batch names days; all files of these days are read
again, each by its own header, and exactly these day partitions are replaced. So a day whose files come in two batches is
whole after the second, and a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewake.sources.panels import new_days, write_days
from tidewake.sources.positions import named_day, read_positions


def run_new_files(spark: SparkSession, source: str, output: str, checkpoint: str, compute, files_per_batch: int = 30) -> None:
    """Run compute(messages) -> DataFrame with a date column on the days of every unseen file, then stop.

    Files have to name their day.
    """
    stream = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
              .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(source).select("path"))

    def write(batch: DataFrame, _id: int) -> None:
        fresh = [r.path for r in batch.collect()]
        nameless = [p for p in fresh if named_day(p) is None]
        if nameless:
            raise ValueError(f"files without a day in their name: {nameless[:5]}")
        days = sorted({named_day(p) for p in fresh})                # at most files_per_batch
        if days:
            write_days(compute(read_positions(spark, source, days=days)), output)

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def append_new_days(source: DataFrame, output: str, compute, day: str = "date") -> None:
    """Batch form: compute the days of source that output lacks and add them."""
    spark = source.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(output)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        write_days(compute(source), output, day)
        return
    write_days(compute(new_days(source, spark.read.parquet(output), day)), output, day)
