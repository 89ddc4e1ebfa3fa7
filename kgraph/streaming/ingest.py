"""Incremental ingestion by Structured Streaming.

A file-source stream's checkpoint is the ledger of files: each is read once, and a failed batch is read again whole (L6).
Every stream here runs over what there is and ends (availableNow); a service would pass another trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cut import shared_dir


def work_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A folder or one file: as a pattern that matches nothing else, it may be either."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def run(stream: DataFrame, mode: str = "append", folder: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over what there is; gives what it wrote.  Batches are written by number, so that one that is run
    again replaces itself."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(each or write).start()
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch int").parquet(f"{folder}/out")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def segment(rows: DataFrame) -> DataFrame:
    """Rows: session_id, at, id, kind.  session_id, id, seq: the window number of each row, kept as state per session.
    Rows of a session that come in one batch are ordered by (at, id); batches must come in order."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq = state.get[0] if state.exists else 0
        part = pd.concat(list(batches)).sort_values(["at", "id"])
        closes = (part["kind"] == "boundary").astype(int).cumsum()
        before = closes.shift(1, fill_value=0)
        yield pd.DataFrame({"session_id": key[0], "id": part["id"], "seq": (before + seq).astype("int32")})
        state.update((int(seq + closes.iloc[-1]),))

    return rows.groupBy("session_id").applyInPandasWithState(work, "session_id string, id long, seq int", "seq int", "append", GroupStateTimeout.NoTimeout)


def changed_files(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """L1: a stream of project, file, hash, at without rows whose hash was seen for that file."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["project", "file", "hash"])


def windowed_counts(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Extension: events per tumbling window and kind, late ones dropped after the delay."""
    return stream.withWatermark("at", delay).groupBy(F.window("at", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
