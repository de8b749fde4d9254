"""Session settings and the staging area that cuts lineage between iterative rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "leafwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; `conf` keys use `_` for `.`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # recording the call site of every expression doubles the time large plans take to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on, on a session somebody else may have built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # a hot key is found by what its partition holds at run time, also where the result is used by key again
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    staging_root(spark)
    return spark


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: `spark.checkpoint.dir` as the session names it.

    Only a local-mode session that names none gets a temporary folder of its own; on a cluster
    a machine-local folder would be lost with the machine, so that is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="leafwork-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


_STAGED: list[str] = []


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back; `by` splits it into partitions.

    Used wherever a frame is read more than once or feeds the next round of a loop. Compared with
    `checkpoint()` the plan runs once instead of twice, later reads prune columns and push
    filters, and the scan has a size that join planning can use.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "lz4")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, for a job that writes several tables; `drop_staged` deletes it as well."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def staged_so_far() -> int:
    """A mark for `drop_staged`: what is staged from now on comes after it."""
    return len(_STAGED)


def drop_staged(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables this process staged (after the mark `since`); call it when results have been written.

    Frames built on them cannot be used any more. Returns the number of tables.
    """
    context = spark.sparkContext
    dropped = 0
    while len(_STAGED) > since:
        path = context._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        dropped += 1
    return dropped
