"""Session settings and the shared folder used for cut lineage and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# Whether the shuffle files of a write are removed as soon as it has ended, not when the driver's garbage is collected.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "postlens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators rely on; the cluster's own settings win elsewhere."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local path would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"{folder} has to be a mount that every executor shares", stacklevel=2)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postlens-"))
    return spark.sparkContext.getCheckpointDir()


_MADE: list[str] = []


def remove_stored(spark: SparkSession) -> int:
    """Deletes what ``scratch_path`` named in this driver so far; call it once no result that reads it is needed."""
    hadoop, count = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, 0
    while _MADE:
        path = hadoop(_MADE.pop())
        count += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing existing is ever overwritten."""
    _MADE.append(f"{shared_folder(spark).rstrip('/')}/postlens-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df written once under the shared folder and read back: for results that are used several times.

    The shuffle files of the write are of no use once it has ended, and are removed then.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(FREED, "false")
    conf.set(FREED, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the tables that ``stored`` wrote; call it once no result that is still to be made reads them."""
    for table in tables:
        spark = table.sparkSession
        for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
            mine = [m for m in _MADE if path.endswith(m.rpartition("/")[2])]
            if mine:
                _MADE.remove(mine[0])
                hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mine[0])
                hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
