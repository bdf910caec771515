"""Keeps a snapshot current from a stream of looks at a source tree."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.plans.engine import Options, analyze
from callweave.sources.scan import scan_sources
from callweave.sources.storage import create_new, delete_path, names_in

STATE = "file_key string, last_modified double, file_size bigint"


def listing(spark: SparkSession, options: Options) -> DataFrame:
    """(file_key, last_modified, file_size) of the tree's source files; no content is read."""
    return scan_sources(spark, options.input, options.skip_tests, None, options.skipped).select("file_key", "last_modified", "file_size")


def tree_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(file_key, change) between two listings: added, changed (time or size) or deleted. A renamed file is both a deleted one
    and an added one; a file that stayed as it was gives no row."""
    look = lambda rows, name: rows.select("file_key", F.struct("last_modified", "file_size").alias(name))
    met = look(now, "now").join(look(before, "before"), "file_key", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("before"), "changed")
    return met.select("file_key", change.alias("change")).where("change is not null")


def watch(spark: SparkSession, options: Options, checkpoint: str, once: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Lists the tree in each batch (one batch, or one ``every`` so often) and, where files were added, changed or deleted since
    the last batch that was finished, analyses the tree and applies the difference to ``options.snapshot``.

    A stream of files alone would tell neither of changed files nor of deleted ones. Resolution needs the whole program, so
    all of it is resolved; parsed files come from a cache (``options.cache``, else one in the checkpoint), and unchanged
    modules keep their rows. ``checkpoint`` also holds the last listing and, in ``changes``, a table (file_key, change) for
    each batch that found any. A batch that fails is run again: its listing counts only once the snapshot is written, and a
    file that changes in between is seen by the next batch.
    """
    given = options if options.cache else replace(options, cache=f"{checkpoint}/cache")
    tree = f"{checkpoint}/tree"

    def apply(batch: DataFrame, number: int) -> None:
        done = sorted(int(n.removesuffix(".done")) for n in names_in(spark, tree) if n.endswith(".done"))
        if done and done[-1] >= number:
            return
        listing(spark, given).write.mode("overwrite").parquet(f"{tree}/{number}")
        now = spark.read.schema(STATE).parquet(f"{tree}/{number}")
        before = spark.read.schema(STATE).parquet(f"{tree}/{done[-1]}") if done else spark.createDataFrame([], STATE)
        found = tree_changes(now, before)
        if found.isEmpty():
            delete_path(spark, f"{tree}/{number}")
            return
        found.write.mode("overwrite").parquet(f"{checkpoint}/changes/batch={number}")
        analyze(spark, given)
        create_new(spark, f"{tree}/{number}.done", "")
        for old in done:
            delete_path(spark, f"{tree}/{old}.done")
            delete_path(spark, f"{tree}/{old}")

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
