"""Session building and the handling of intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import logging
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("convolens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local session (tests) may go without and gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="convolens-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Stages whose tables haven't been deleted.
_open: list[Stage] = []


class Stage:
    """Tables written to the shared folder: lineage is cut, and a lost executor costs nothing that was written.

    ``keep`` writes a frame and reads it back; ``drop`` deletes a table no later plan reads. A query's result may read
    its stage's tables, so they stay until ``release`` is called, ``releasing`` is left, or the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _open.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._convolens_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_convolens_path", None)
        if path:
            _delete(self.spark, path)

    def close(self) -> None:
        """Deletes all of the stage's tables."""
        _delete(self.spark, self.root)


def release(since: int = 0) -> None:
    """Deletes the tables of all stages (made since so many); results that read them can no longer be computed."""
    while len(_open) > since:
        stage = _open.pop()
        try:
            stage.close()
        except Exception as e:  # noqa: BLE001  the session may have ended already
            logging.getLogger(__name__).debug("stage %s not deleted: %s", stage.root, e)


@contextlib.contextmanager
def releasing() -> Iterator[None]:
    """Deletes the tables of the stages made inside when left: for a query and the use of its result."""
    before = len(_open)
    try:
        yield
    finally:
        release(before)


atexit.register(release)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
