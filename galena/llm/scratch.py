"""Shared working tables: how long lineages are cut.

Every intermediate table goes to the folder the cluster names in
``spark.checkpoint.dir`` (all executors see it), so a lost executor never
invalidates it.  Where that setting is absent, a folder of this machine serves
a session that runs on this machine alone; on a cluster that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that a JVM and a Python worker hold at once for a task, besides what the task makes of them.
BATCH_BYTES = 12 << 20
#: Spark's setting that an execution's shuffle files are deleted when it has ended.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in Arrow batches of BATCH_BYTES, however long its texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='galena-')}")
    return spark.conf.get("spark.checkpoint.dir")


#: Folders of this process's runs, with the application that made them.
_ROOTS: list[tuple[str, str]] = []


def release(spark: SparkSession) -> int:
    """Deletes the working tables of all runs of this application so far, and returns how many runs there were.

    For the caller, once results have been read or written elsewhere: a result that was returned and not
    read yet may still need its tables.
    """
    own = [root for app, root in _ROOTS if app == spark.sparkContext.applicationId]
    for root in own:
        target = spark._jvm.org.apache.hadoop.fs.Path(root)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _ROOTS[:] = [(app, root) for app, root in _ROOTS if root not in own]
    return len(own)


class Scratch:
    """A folder of Parquet tables that belong to one run of one operator; ``release`` deletes them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        _ROOTS.append((spark.sparkContext.applicationId, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, name: str, df: DataFrame, free: bool = False) -> DataFrame:
        """Write ``df`` once and return the written rows; ``free``: what the write has shuffled is deleted when it has ended."""
        path = self.path(name)
        with self._freed() if free else nullcontext():
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_dealt(self, name: str, parts: list[DataFrame], key: str, buckets: int) -> DataFrame:
        """Write the rows of ``parts``, one after the other, in buckets by ``key`` and return them: what groups by it reads the files without a shuffle.

        What a write has shuffled is deleted when it has ended. The table is in the catalog only while it is written.
        """
        table = "_".join(re.findall(r"\w+", f"{self.root.rpartition('/')[2]}-{name}"))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts[0].schema)
        self.spark.sql(f"CREATE TABLE `{table}` ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{self.path(name)}'")
        try:
            for part in parts:
                with self._freed():
                    part.write.insertInto(table)
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE `{table}`")  # its files stay, as they have a place of their own

    @contextmanager
    def _freed(self) -> Iterator[None]:
        """What runs meanwhile leaves no shuffle files."""
        before = self.spark.conf.get(FREE, None)
        self.spark.conf.set(FREE, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(FREE)
            else:
                self.spark.conf.set(FREE, before)

    def drop(self, *names: str) -> None:
        """Delete tables nothing reads any more; those that were never written are passed over."""
        jvm = self.spark._jvm
        for name in names:
            target = jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
