"""Session set-up and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Paths handed out by the scopes that are open, innermost last.
_scopes: list[list[str]] = []
# Applications that have the package.
_shipped: set[str] = set()
# With it Spark removes the shuffle files of a query when that is over.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "codeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting switched on, whose executors have this package.

    ``spark.checkpoint.dir`` must name a folder all executors share, here or in the
    cluster's configuration.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, wherever they were started.

    They fetch it from the driver, which keeps the archive as long as it runs.
    """
    if spark.sparkContext.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    folder = tempfile.mkdtemp(prefix=f"{name}-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, files in os.walk(package):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(top, file)
                    out.write(path, os.path.join(name, os.path.relpath(path, package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session, which must be set."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if not configured and not current:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if current is None:
        context.setCheckpointDir(configured)
    folder = (configured or current).rstrip("/")
    # Spark writes local paths with one slash, which other readers of URIs do not take.
    return f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed at the end of the scope it was asked for in, if there is one."""
    path = f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are removed at the end; write results before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_path(spark, path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries run inside remove their shuffle files when each is over, not when the driver happens to collect its garbage."""
    was = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if was is None else spark.conf.set(_CLEAN_UP, was)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The form to cut lineage with inside loops: later plans start from plain
    files, without constraints and estimates inherited from earlier rounds.
    What was shuffled for the table goes once it is written.
    """
    path = scratch_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table ``stored`` wrote for ``df``; nothing may read it any more."""
    remove_path(df.sparkSession, df.scratch_path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder with its partitions and their row order as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
