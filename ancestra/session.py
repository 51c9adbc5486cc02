"""Session set-up and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ancestra")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the session names in ``spark.checkpoint.dir`` or has set
    on its context. Only a local master, where the driver is the executor,
    gets a folder of its own when neither is set.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named:
        return named
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="ancestra-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


#: How often tables were cleared; what is kept by reference to them goes with it.
cleared = 0


def clear(spark: SparkSession) -> None:
    """Delete all tables this application has written in the shared folder: results that weren't computed to the end can't be any more."""
    global cleared
    cleared += 1
    at = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably, so later plans start from its rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: columnar, prunable, survives executors."""
    path = f"{run_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession) -> int:
    """How many shuffle tasks the session plans for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Pile:
    """A table in the shared folder that grows by whole pieces: what is there isn't written again."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema = first.sparkSession, first.schema
        self.base = f"{run_dir(self.spark)}/p-{uuid.uuid4().hex}"
        self.pieces: list[str] = []
        self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """Write a piece and give it back as read."""
        at = f"{self.base}/{len(self.pieces)}"
        df.select(*self.schema.fieldNames()).write.parquet(at)
        self.pieces.append(at)
        return self.spark.read.schema(self.schema).parquet(at)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.pieces)
