"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "runloom") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter configures Spark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without one is a
    configuration error, because a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            current = tempfile.mkdtemp(prefix="runloom-shared-")
        context.setCheckpointDir(current)
        current = context.getCheckpointDir()
    return current


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Parts:
    """A table of the shared folder that is written as Parquet, in one part or several.

    A lost executor costs nothing that was written. The shuffle files behind a part are freed as soon as it is written, so that
    the disk holds those of one part at a time; a later join deals the rows out anew, so that Spark can split a hot key.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._schema = spark, None
        self._path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> Parts:
        conf = self._spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(self._path)
        finally:
            if before is None:
                conf.unset(_CLEANUP)
            else:
                conf.set(_CLEANUP, before)
        self._schema = df.schema
        return self

    def read(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._path)

    def drop(self) -> None:
        """Delete the table once nothing reads it any more."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; see :class:`Parts`."""
    return Parts(df.sparkSession, name).add(df).read()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_runloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="runloom-package-")) / "runloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._runloom_shipped = True
