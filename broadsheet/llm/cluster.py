"""Shared storage and code shipping for operators that run in several Spark jobs.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which the driver and every executor can reach, so a
lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The run's folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='broadsheet-')}")
    root = f"{base.rstrip('/')}/broadsheet-{app}"
    if root not in _own:
        _own[root] = root
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder's retention rule then applies
        pass


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished job go at once: its written table holds all that later jobs read."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The DataFrame as a Parquet table in the shared folder, read back: lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    with shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="broadsheet-code-")
    path = os.path.join(folder, "broadsheet_code.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def hadoop_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder on any file system that Spark can read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
