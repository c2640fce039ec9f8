"""Tables that end a lineage: written to the folder that all executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: With it Spark drops what an action has shuffled as soon as it has ended, not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: ContextVar[list | None] = ContextVar("open", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in a session of one machine (removed at its end), and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """Where this application's tables are; it can be dropped as a whole when the application's results are written."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, on storage every executor reaches."""
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    tables, was = _open.get(), spark.conf.get(TIDY)
    spark.conf.set(TIDY, was if tables is None else "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, was)
    table = spark.read.schema(df.schema).parquet(path)
    if tables is not None:
        tables.append((table, path))
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside are removed at the end, but for those given to the function it yields, and shuffles when their table is written.
    What leaves must not read the tables removed."""
    mine: list = []
    kept: list[DataFrame] = []
    outer, token = _open.get(), _open.set(mine)
    try:
        yield lambda table: kept.append(table) or table
    finally:
        _open.reset(token)
        for table, path in mine:
            if any(table is k for k in kept):
                if outer is not None:
                    outer.append((table, path))
            else:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
