"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Semantics (not speed): UTC dates, exact decimal products, AQE for skew.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's session settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and single-node runs."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voltide")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is unset and the master is local, a temporary folder is
    made and removed at exit. On a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voltide-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def _own_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    return f"{shared_dir(spark)}/voltide/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of the application. To be called when its
    results are written: plans that were returned read some of them."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target.getParent(), True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input to all cores before a costly map.

    A table of few row groups is read by few tasks, however the file is split.
    Only an input that could not fill all cores with full partitions is dealt
    out; a larger one stays where it is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    full = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * full else df


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is always sorted and merged, never broadcast.

    Spark estimates a table made by ``explode`` at the size of what it was made
    from, and so broadcasts through the driver what may be many times larger."""
    return df.hint("merge")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor, which a local
    checkpoint does not. ``free`` drops tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._voltide_path = path
        return out

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                delete_path(self.spark, path)
