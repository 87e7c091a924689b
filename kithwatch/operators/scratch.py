"""Intermediate tables in the shared checkpoint folder.

Iterative operators cut their lineage by writing a round as Parquet and reading it back.
The files survive the loss of any executor, and carry the statistics the planner needs.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master, whose executors all see the driver's disk, may go without the
    setting; it then gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="kithwatch-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folder that the tables of the running call belong to, if a caller owns them.
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


class Scratch:
    """Writes tables of one operator call under a folder of their own.

    As a context it owns all scratch tables that are made inside it, by whatever operator, and
    deletes them at the end: results must have been written elsewhere by then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = _owner.get() or f"{scratch_root(spark)}/kithwatch/{spark.sparkContext.applicationId}"
        self.base = f"{root}/{label}-{uuid.uuid4().hex}"
        self.schemas: dict[str, StructType] = {}

    @contextmanager
    def owning(self) -> Iterator[Scratch]:
        """Own what is made inside, and keep it."""
        token = _owner.set(self.base)
        try:
            yield self
        finally:
            _owner.reset(token)

    def __enter__(self) -> Scratch:
        self._open = self.owning()
        return self._open.__enter__()

    def __exit__(self, *problem) -> None:
        self._open.__exit__(None, None, None)
        self.drop()

    def save(self, table: DataFrame, name: str) -> DataFrame:
        """Write a table in place of what has this name, and read it back."""
        return self._write(table, name, "overwrite")

    def add(self, table: DataFrame, name: str) -> DataFrame:
        """The same beside what has this name already."""
        return self._write(table, name, "append")

    def _write(self, table: DataFrame, name: str, mode: str) -> DataFrame:
        table.write.mode(mode).parquet(f"{self.base}/{name}")
        self.schemas[name] = table.schema
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.base}/{name}")

    def every(self, folder: str) -> DataFrame:
        """All tables saved below a folder, which have the same columns, as one."""
        schema = next(kind for name, kind in self.schemas.items() if name.startswith(f"{folder}/"))
        return self.spark.read.schema(schema).parquet(f"{self.base}/{folder}/*")

    def drop(self, name: str = "") -> None:
        """Delete a table (or folder, or all) that no live plan reads any more."""
        _delete(self.spark, f"{self.base}/{name}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote; results not yet written out become unreadable."""
    _delete(spark, f"{scratch_root(spark)}/kithwatch/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
