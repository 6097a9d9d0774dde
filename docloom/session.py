"""Sessions, and shipping this package to Python workers that can't import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cpus: str = "*", name: str = "docloom", **conf: str) -> SparkSession:
    """A single-machine session with adaptive execution; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that all executors share. Where none is set, a local master gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of the shared folder and read back: its plan ends there, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Delete the table that materialize() wrote for df, once nothing reads it any more."""
    if df is None:
        return
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = hadoop.Path(folder)
        if path.getParent().getName() == "docloom":
            path.getFileSystem(conf).delete(path, True)


#: Rows of an Arrow batch that a Python worker gets, where the session doesn't set it: long texts add up.
ARROW_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for the whole session, unless it has a bound of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_ROWS)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's source as an archive, once per application, unless PYTHONPATH already has it.

    Every registered query starts here, so the bound on Arrow batches holds for all of a session's steps.
    """
    bound_batches(spark)
    context = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.applicationId in _shipped or str(ROOT.parent) in paths:
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="docloom-src-")) / "docloom-src.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
