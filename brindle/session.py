"""Session settings and shared-storage helpers that every part of the library uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The directory that holds the package; Python workers get it on their path.
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


BATCH = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"))


def session(app: str = "brindle", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is tuned for. An existing session is reused."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return ready(b.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever the driver was started.

    Rows hold whole texts, so batches to Python get a bound in bytes, unless the session has set its own."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in path:
        env["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, path)])
    for key, default, value in BATCH:
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where none is named, a temporary one is made if all executors are on this machine (local tests); on a cluster
    that is an error, since each machine would write to a disk of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_before = spark.sparkContext.getCheckpointDir()
        if set_before:
            return set_before
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def files_of(root: str):
    """The file system (of any kind that Arrow knows) of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")


#: Tables that ``stored`` has written, oldest first.
_STORED: list[str] = []


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage at a table that outlives any executor; later plans get its statistics. The table stays until
    ``dropped`` takes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the sequence of stored tables, for ``dropped``."""
    return len(_STORED)


def dropped(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Deletes the tables stored since a mark, but for the last ones; gives how many. Nothing that reads them may be left to run."""
    paths = _STORED[since : len(_STORED) - but_last]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _STORED.remove(path)
    return len(paths)
