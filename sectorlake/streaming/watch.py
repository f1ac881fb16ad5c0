"""Watching a journal: its stream with names, times, and paths that follow the volume."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.journal import history, named, with_paths
from ..operators.paths import PathOptions, summaries
from ..session import fresh_path, keep
from ..sources.journal import NAME, JournalSource
from ..sources.pages import register

PERIOD = "30 seconds"


def watch(spark: SparkSession, path: str, starting: str = "latest") -> DataFrame:
    """Records as they are written; stop it with the query's ``stop``."""
    register(spark, JournalSource)
    return named(spark.readStream.format(NAME).option("startingOffset", starting).load(path))


@dataclass
class PathWatch:
    """Gives every batch of a watched journal its paths.

    ``snapshot`` reads the file records anew for each batch.  The folder
    ``memory`` remembers the first name and parent of every (file, sequence) that
    the journal has shown, so names of files that are gone by now still resolve;
    it is written once for each batch, under the batch's number, so a batch that
    is run again replaces its own part.
    """

    spark: SparkSession
    snapshot: Callable[[], DataFrame]
    sink: Callable[[DataFrame, int], None]
    options: PathOptions = PathOptions()
    memory: str = field(default="")

    def __post_init__(self) -> None:
        self.memory = self.memory or fresh_path(self.spark, "journal-history")

    def remembered(self, before: int) -> DataFrame | None:
        try:
            have = self.spark.read.schema("file long, file_seq int, name string, parent long, parent_seq int, batch long").parquet(self.memory).where(F.col("batch") < before)
        except Exception as e:  # no batch has been written yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return have

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = keep(batch)
        fresh, old = history(rows), self.remembered(number)
        if old is not None:
            fresh = fresh.join(old.select("file", "file_seq"), ["file", "file_seq"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.memory}/batch={number}")
        past = fresh if old is None else fresh.unionByName(old.drop("batch"))
        self.sink(with_paths(rows, keep(summaries(self.snapshot(), self.options)), past, self.options), number)


def watch_paths(records: DataFrame, follow: PathWatch, checkpoint: str, period: str = PERIOD) -> StreamingQuery:
    return records.writeStream.foreachBatch(follow).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()


def counts_by_window(records: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Records for each window of time and reason; records later than ``late`` are left out."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", length), "reasons").count()
