"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only where that is unset in local mode, as in tests, a temporary one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Workspace:
    """Writes frames as Parquet below :func:`shared_dir` and reads them back.

    A written table cuts the lineage and survives the loss of any executor, unlike a cache or a
    local checkpoint.  ``drop`` deletes tables that nothing will read again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tesserae-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def put(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", compression).parquet(path)
        self.release()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tesserae_path = path
        return out

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished jobs: its cleaner acts once the driver has collected its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._tesserae_path)
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While jobs run inside, Arrow batches to Python hold few rows, so long texts do not pile up in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


BATCH_ROWS = 2000


def lean(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold few rows: whole texts are long, and a batch is held several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def over_rows(docs: DataFrame, run: Callable[[Iterator], Iterator], *added: T.StructField) -> DataFrame:
    """``docs`` through an Arrow function that keeps all columns in place and appends ``added``; odd column names survive."""
    lean(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"__column_{i}" if "." in n or "`" in n else n for i, n in enumerate(names)])
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *added])).toDF(*names, *(a.name for a in added))
