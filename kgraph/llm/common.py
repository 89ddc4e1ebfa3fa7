"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cut import delete, shared_dir

#: A word: a run of characters that are none of space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that are split into words at a time.
SLICE = 1 << 20
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The text cut at white space into slices of about so many bytes."""
    at = 0
    while at < len(data):
        found = _BLANK.search(data, at + size)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


#: Folders that materialize has written, in order.
WRITTEN: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kgraph_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove what materialize wrote for df, when nothing will read it again."""
    path = getattr(df, "kgraph_path", None)
    if path in WRITTEN:
        WRITTEN.remove(path)
        delete(df.sparkSession, path)


def release_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Remove all that was written from WRITTEN[mark] on, but for keep."""
    for path in WRITTEN[mark:]:
        if path != keep.kgraph_path:
            WRITTEN.remove(path)
            delete(spark, path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smaller_batches(spark: SparkSession, rows: int = 4000) -> None:
    """Rows with whole texts go to Python so many at a time, where the session has not set a number of its own: a worker holds a
    batch as Arrow, as strings and as bytes, and two workers share an executor's memory with the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
