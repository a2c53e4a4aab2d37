"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of texts.
TEXT_BATCH = 1 << 20
#: Folder below that of the application; see ``scratch``.
_FOLDER: ContextVar[str] = ContextVar("folder", default="")


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir`` of the session.

    Where none is named, a session on one machine gets a temporary folder of its own; on a
    cluster that is an error, since executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="run-")
    return _OWN_DIR[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table under the work folder and read it back.

    The lineage ends at files in shared storage, so a lost executor costs only
    its running tasks, and every reader prunes columns and pushes filters.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{_FOLDER.get()}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = TEXT_BATCH) -> Iterator[None]:
    """Queries planned inside hand rows to Python in Arrow batches of about ``size`` bytes, one row at least.

    A batch is held by the executor, outside its heap, and by the Python worker at once, for
    every task; 10,000 rows of text are tens of MB. A smaller limit of the session stays.
    """
    asked = spark.conf.get(_BATCH_BYTES)
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(asked)
    spark.conf.set(_BATCH_BYTES, str(size if limit <= 0 else min(size, limit)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, asked)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are removed at the end; results must be written elsewhere."""
    folder = f"scratch-{uuid.uuid4().hex}"
    outer = _FOLDER.set(f"{folder}/")
    try:
        yield
    finally:
        _FOLDER.reset(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(
            f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{folder}"
        )
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
