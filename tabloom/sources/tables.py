"""Append-only Parquet tables under one root folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.sources.readers import path_exists


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class TableStore:
    """Small catalogue tables with fixed schemas; rows are only ever appended."""

    SCHEMAS: dict[str, str] = {}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        """The table, empty when nothing was appended yet."""
        if path_exists(self.spark, self.path(table)):
            return self.spark.read.schema(self.SCHEMAS[table]).option("recursiveFileLookup", True).parquet(self.path(table))
        return self.spark.createDataFrame([], self.SCHEMAS[table])

    def append(self, table: str, rows: Iterable[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), self.SCHEMAS[table]).coalesce(1)
        # A folder of its own: jobs that commit into one folder at the same time clear each other's temporary files.
        df.write.parquet(f"{self.path(table)}/write-{uuid.uuid4().hex}")

    def next_id(self, table: str, count: int = 1) -> int:
        """The first of ``count`` ids in a row that no other writer gets, from the largest id on.

        An id is claimed by creating a marker file, which only one writer of a file system with atomic creation can.
        """
        first = (self.read(table).agg(F.max("id")).first()[0] or 0) + 1
        claimed = 0
        while claimed < count:
            if self._claim(table, first + claimed):
                claimed += 1
            else:
                first, claimed = first + claimed + 1, 0
        return first

    def _claim(self, table: str, number: int) -> bool:
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/{table}/{number}")
        files = marker.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(marker.getParent())
        if files.getUri().getScheme() != "file":
            return files.createNewFile(marker)
        # Hadoop's view of a local disk looks and creates in two steps.
        try:
            os.close(os.open(marker.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
