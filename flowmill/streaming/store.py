"""What a stream keeps between runs: its checkpoint, keyed state and results below one shared path.

Nothing lives in driver memory. A query started again with the same path, by the same or by another process, goes on
after the last finished batch: the checkpoint names the next batch, and the state of the batch before is found in
storage. A batch that is repeated after a failure writes the same things over what its first try left.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from flowmill.session import new_path


def _read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``; None before anything has been written there."""
    try:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class StateTable:
    """Keyed state, one version a batch. Versions take turns in ``SLOTS`` folders, so older ones expire by themselves.

    A version counts once its mark is written, after its rows; the mark names the batch, so that a state that does not
    belong to the checkpoint is an error and not a wrong result. While a batch writes its slot, the versions of the two
    batches before stay whole for readers.
    """

    SLOTS = 3

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, batch: int) -> None:
        slot = batch % self.SLOTS
        df.write.mode("overwrite").parquet(f"{self.path}/rows/slot={slot}")
        self.spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.path}/marks/slot={slot}")

    def version(self, batch: int) -> DataFrame | None:
        """State as of ``batch``; None before the first one."""
        if batch < 0:
            return None
        mark = _read(self.spark, f"{self.path}/marks/slot={batch % self.SLOTS}", "batch long")
        found = mark.first() if mark is not None else None
        if found is None or found["batch"] != batch:
            raise RuntimeError(f"{self.path} holds no state of batch {batch}: it does not belong to this checkpoint")
        return self.spark.read.parquet(f"{self.path}/rows/slot={batch % self.SLOTS}")

    def last(self) -> int:
        """The newest batch with a whole state, or -1."""
        marks = _read(self.spark, f"{self.path}/marks", "batch long")
        newest = marks.agg(F.max("batch").alias("batch")).first()["batch"] if marks is not None else None
        return -1 if newest is None else newest

    def latest(self) -> DataFrame | None:
        return self.version(self.last())


class BatchLog:
    """Result rows by batch, all of them kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def all(self) -> DataFrame | None:
        return _read(self.spark, self.path)


class StreamStore:
    """The folder of one stream; without a ``path`` a fresh one, for streams that end with their session."""

    def __init__(self, spark: SparkSession, path: str | None = None, name: str = "stream"):
        self.spark = spark
        self.path = path or new_path(spark, name)

    @property
    def checkpoint(self) -> str:
        return os.path.join(self.path, "checkpoint")

    def state(self, name: str = "state") -> StateTable:
        return StateTable(self.spark, os.path.join(self.path, name))

    def log(self, name: str = "log") -> BatchLog:
        return BatchLog(self.spark, os.path.join(self.path, name))

    def rows(self, name: str, schema: StructType) -> DataFrame | None:
        """A table that the stream has written below its folder, or None."""
        return _read(self.spark, os.path.join(self.path, name), schema)
