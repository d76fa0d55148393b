"""Session helpers: one place that knows where shared scratch space lives."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidewell", cpus: int | str = "*") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder; anywhere else that folder would vanish with a node.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if shared is None and current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="tidewell-")
    if current is None:
        spark.sparkContext.setCheckpointDir(shared)
    return (shared or current).rstrip("/")


# Scratch folder of every application of this process.
_scratch: dict[str, str] = {}


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses; it goes when the session ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        folder = f"{work_dir(spark)}/tidewell-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _scratch[app] = folder
    return f"{_scratch[app]}/{label}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession, least: int) -> int:
    """A number of partitions that grows with the cluster."""
    return max(least, spark.sparkContext.defaultParallelism)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result outlives the executors that computed it."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
