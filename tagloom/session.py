"""Session settings the operators count on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # every date in the data model is a calendar day in one zone
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed joins even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows handed to Python carry arrays, so few at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # keyed streaming state lives on local disk of the executors plus the checkpoint, not on the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # and takes so much memory of an executor together, whatever the number of its partitions
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
}


# shuffle files go when the job is done, not when the driver happens to collect its garbage
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for the time of a job; a stream keeps those that it was started with."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built, and send it this package."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return ship(spark)


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tagloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack capture per column
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@cache
def _shipped(application_id: str) -> None:
    spark = SparkSession.active()
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tagloom-code-")) / "tagloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))  # Spark hands it to every executor


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application; needed where they cannot import it."""
    _shipped(spark.sparkContext.applicationId)
    return spark


@cache
def _local_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="tagloom-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may go without; it gets a
    folder of its own, once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _local_dir(spark.sparkContext.applicationId)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[str] = []


def written_tables() -> int:
    """How many intermediate tables there are: a mark for ``discard``."""
    return len(_made)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the written intermediate tables of this session, or those since a mark but the last ``keep``; call it when
    nothing that reads them is in use."""
    gone = 0
    for name in _made[since:len(_made) - keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since:len(_made) - keep]
    return gone


def stable(frame: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, the loss of executors costs
    nothing that was done before, and readers prune its columns."""
    spark = frame.sparkSession
    path = fresh_dir(spark, name)
    _made.append(path)
    with settings(spark, {FREED: "true"}):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
