"""Session builder, the shared work folder and cuts of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TEST_DIR: str | None = None


def build_session(app: str = "morphoquarry", cores: int | None = None, memory: str = "12g", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one where that is unset (one machine, tests)."""
    global _TEST_DIR
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _TEST_DIR is None:
        _TEST_DIR = tempfile.mkdtemp(prefix="morphoquarry-")
        atexit.register(shutil.rmtree, _TEST_DIR, True)
    return f"file://{_TEST_DIR}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_KEPT: set[str] = set()


class Cut:
    """Writes tables to the shared folder and reads them back, so that lineage ends there and a lost executor costs no recomputation.

    ``Cut(spark).table(df)`` returns the table as read; ``drop(df)`` removes one that no later step reads. All others
    are removed when the application's driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = (back, path)
        return back

    def path(self) -> str:
        """A fresh path in the application's own part of the shared folder."""
        own = f"{work_dir(self.spark)}/mq-{self.spark.sparkContext.applicationId}"
        if own not in _KEPT:
            _KEPT.add(own)
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(own)
            files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            files.mkdirs(target)
            files.deleteOnExit(target)
        return f"{own}/{uuid.uuid4().hex}"

    def drop(self, df: DataFrame) -> None:
        entry = self._paths.pop(id(df), None)
        if entry:
            _remove(self.spark, entry[1])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application; they may not share the driver's path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="morphoquarry-zip-")
    atexit.register(shutil.rmtree, folder, True)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/morphoquarry", "zip", root, "morphoquarry"))
