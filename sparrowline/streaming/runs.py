"""Landing and run state as Structured Streaming over a folder of Parquet files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_folder(spark: SparkSession, path: str, schema: StructType, only: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", only).parquet(path)


def first_of_key(events: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Each key once; state is dropped when the watermark has passed it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by window and kind, given out when the watermark closes the window."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n"))


class StreakProcessor(StatefulProcessor):
    """For each source: runs so far and failures in a row, given out with each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "runs long, streak long, last_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, streak, last = self.state.get() if self.state.exists() else (0, 0, -1)
        frames = [r for r in rows if len(r)]
        if frames:
            for r in pd.concat(frames).sort_values("id").itertuples():
                runs, streak, last = runs + 1, streak + 1 if r.failed else 0, max(last, r.id)
            self.state.update((runs, streak, last))
        yield pd.DataFrame({"user_id": [key[0]], "runs": [runs], "streak": [streak], "last_id": [last]})

    def close(self) -> None:
        pass


def streaks(runs: DataFrame) -> DataFrame:
    """Updates of (user_id, runs, streak, last_id) from a stream of (user_id, id, failed)."""
    return runs.groupBy("user_id").transformWithStateInPandas(
        StreakProcessor(), "user_id long, runs long, streak long, last_id long", outputMode="Update", timeMode="None"
    )


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there now and ends; a second call goes on where the first ended."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.format("parquet").option("path", out).start().awaitTermination()
