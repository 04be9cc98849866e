"""Session set-up and the shared staging folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_local_folders: dict[str, str] = {}
_removed_on_exit: set[str] = set()


def local_session(app: str = "wagelens", cores: int | str = "*", **conf: str) -> SparkSession:
    """A ``local[cores]`` session for tests and the benchmark; clusters bring their own."""
    partitions = str(os.cpu_count() if cores == "*" else cores)
    settings = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        # Recording the Python call site of every column expression costs more than
        # planning does; switch it on again to debug.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Small local data: let a stage of a few megabytes use all the cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """The folder every executor can reach for written intermediate tables of this application.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall
    back to a folder of this machine.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return _until_exit(spark, f"{configured.rstrip('/')}/{app}")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            f"{CHECKPOINT_KEY} is not set; intermediate tables need a folder shared by all executors"
        )
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="wagelens-")
    return _until_exit(spark, _local_folders[app])


def _until_exit(spark: SparkSession, folder: str) -> str:
    """The folder, made if need be; the driver removes it with its staged tables when it exits."""
    if folder not in _removed_on_exit:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _removed_on_exit.add(folder)
    return folder


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the staging folder."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the staging folder and read back.

    For a frame that several passes read: its plan runs once, and a lost executor costs
    a file read, not the lineage.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
