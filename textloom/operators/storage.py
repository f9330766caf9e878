"""Intermediate tables in the folder that all executors share, and their removal."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_stacks: ContextVar[list[list[str]]] = ContextVar("workspaces")


def _spaces() -> list[list[str]]:
    """Folders by workspace, the innermost last; the first holds what results still read. Every thread has its own."""
    if (stack := _stacks.get(None)) is None:
        _stacks.set(stack := [[]])
    return stack


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-kept-")
        folder = _folders[app]
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes with the workspace that asked for it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _spaces()[-1].append(path)
    return path


def kept(df: DataFrame, **options: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs a task,
    not the steps before. options are those of the Parquet writer."""
    path = scratch(df.sparkSession, "kept")
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._kept_path = path
    return table


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that kept() writes inside are deleted at its end, but for those handed to the function it gives: these
    belong to the workspace around it. What is read lazily after the end has to be handed over."""
    own: list[str] = []
    _spaces().append(own)
    passed: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        passed.add(table._kept_path)
        return table

    try:
        yield keep
    finally:
        _spaces().pop()
        _spaces()[-1].extend(p for p in own if p in passed)
        _delete(spark, [p for p in own if p not in passed])


def release(spark: SparkSession) -> None:
    """Delete every table that kept() wrote in this thread and no workspace deleted. Results that were not saved cannot be read
    after it."""
    _delete(spark, _spaces()[0])
    _spaces()[0].clear()
