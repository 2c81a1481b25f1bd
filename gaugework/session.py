"""Session settings, lineage cuts and small-table guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "gaugework", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings this library expects; cluster settings win elsewhere."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the one set on the context.

    Only a local master, where driver and executors are one process, may go without:
    it gets a temporary folder, which is then set for the session.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Unlike a checkpoint it is read by column, so later steps can leave texts where they are.
    """
    path = f"{shared_folder(df.sparkSession)}/gaugework-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows whose texts a task may make and sort by document: enough tasks at any size, none that must spill.
ROWS_A_TASK = 200_000


def gathered(table: DataFrame, key: str, per_core: int = 4) -> DataFrame:
    """Deal the rows of a scanned table to tasks by ``key``, before anything dear is made of them.

    What follows finds the rows of a key together and moves them no more.  For tables
    without a key of so many rows that one task should not take them (``groups.long_groups``).
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(per_core * cores, table.count() // ROWS_A_TASK + 1), key)


def spread(table: DataFrame, per_core: int = 4) -> DataFrame:
    """Deal the rows of a scanned table evenly to all cores when it has too few splits for them.

    Splits follow bytes; rows that are dear to work on keep a few cores busy for long while
    the others wait.  ``table`` is a plain scan, so that counting its splits runs nothing.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= 2 * cores:
        return table
    return table.repartition(per_core * cores)


def small_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a rule table for use on the driver; refuses tables above ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it is not a rule table")
    return rows
