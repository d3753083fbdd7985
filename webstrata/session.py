"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings a job wants on top of the cluster's own. Shuffle width is left to AQE,
# which merges small partitions and splits the large ones of skewed joins.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "webstrata", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of the session; a local one only where none is configured."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or "cluster" in context.master:
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="webstrata-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/webstrata/{label}-{uuid.uuid4().hex}"


# Paths of the tables written in each open `temporary_tables` block, the innermost last.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def cut_lineage(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is never recomputed.

    A written table costs one evaluation, where a checkpoint of a plan costs two. It stays unless it
    was written within `temporary_tables`; ``outlive`` leaves it to the block around the innermost.
    """
    path = work_path(df.sparkSession, "table")
    blocks = _written.get()[:-1] if outlive else _written.get()
    if blocks:
        blocks[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that `cut_lineage` writes within the block when it ends.

    Write results that read them before it ends; frames made within it cannot be read after it.
    Blocks may be nested, each deletes its own tables.
    """
    own: list[str] = []
    token = _written.set((*_written.get(), own))
    try:
        yield
    finally:
        _written.reset(token)
        for path in own:
            delete_path(spark, path)
