"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("codesift")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder of the cluster for intermediate tables. On a cluster it must be
    set; only a local session gets a folder of its own."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "unknown").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="codesift-")


def written(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``rows`` once and go on from the files: the plan above is not run again
    for each consumer, and a lost executor costs a file read, not a rescan."""
    spark = rows.sparkSession
    target = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(target)
    return spark.read.schema(rows.schema).parquet(target)


def run_folder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """The name of a new folder for the tables of one run."""
    return f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def must_be_new(spark: SparkSession, folder: str) -> None:
    """Raise if there is a folder or file of that name, unless it is an empty folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(path) and (system.getFileStatus(path).isFile() or len(system.listStatus(path))):
        raise FileExistsError(f"{folder} exists")


def published(spark: SparkSession, made: str, folder: str) -> None:
    """Give a finished folder its name, by one rename. A folder that came to be in the meantime is not touched."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(made), hadoop.Path(folder)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    must_be_new(spark, folder)
    if system.exists(target):
        system.delete(target, False)
    system.mkdirs(target.getParent())
    if not system.rename(source, target):
        raise OSError(f"{made} could not be renamed to {folder}")


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by ``run_folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
