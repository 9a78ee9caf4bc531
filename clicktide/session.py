"""Session helpers: local sessions for tests and bench, and reliable materialisation."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "clicktide", **conf: str) -> SparkSession:
    """A `local[cpus]` session for tests and bench. On a cluster, pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at the shared folder named in `spark.checkpoint.dir`.

    Only a master of one process may fall back to a temporary folder; on a cluster, be it one
    started locally, other executors would not find such a folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="clicktide-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and return it with its lineage cut.

    Needed where later steps must see exactly the rows of one execution, and where an iteration would
    otherwise grow its plan every round. Compressed and read by column; survives executor loss. The
    file goes with the folder, or is dropped by whoever uses `Written` instead.
    """
    return Written(df).rows


# Paths written since each open `scratch` began.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Drops the tables written to the checkpoint folder inside the block when it ends.

    For steps whose result is written inside the block too, as `Written(.., kept=True)` or elsewhere.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_path(spark, path)


def scratch_path(spark: SparkSession, prefix: str) -> str:
    """A new place in the checkpoint folder, dropped by the `scratch` that is open, if one is."""
    path = f"{ensure_checkpoint_dir(spark)}/{prefix}-{uuid.uuid4()}"
    if _scratch:
        _scratch[-1].append(path)
    return path


class Written:
    """A table written once to the checkpoint folder, which can be dropped when it is superseded."""

    def __init__(self, df: DataFrame, kept: bool = False):
        self._spark = df.sparkSession
        if kept:
            self.path = f"{ensure_checkpoint_dir(self._spark)}/table-{uuid.uuid4()}"
        else:
            self.path = scratch_path(self._spark, "table")
        df.write.parquet(self.path)
        self.rows = self._spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self._spark, self.path)


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes what a finished step has written, in whatever file system it lies."""
    place, files = _place(spark, path)
    files.delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none if it is not there."""
    place, files = _place(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Persist `df` for the body of a `with` block and always release it."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
