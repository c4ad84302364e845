"""Session defaults and the two places where the driver touches data: bounded sides and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows.
BOUNDED_ROWS = 200_000


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tarnfold") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def settle(df: DataFrame, max_rows: int = BOUNDED_ROWS) -> DataFrame:
    """Run an aggregated side once and keep it as a one-partition local table if it has at most ``max_rows`` rows.

    At most ``max_rows + 1`` rows are fetched, so the cost is bounded whatever the size. Windows and joins over the
    result need no shuffle. Past the bound it stays distributed and is kept in the checkpoint folder, so that it is not
    computed again at every use.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return cut_lineage(df)
    return _local(df, rows)


def _local(df: DataFrame, rows) -> DataFrame:
    if rows.num_rows == 0:
        return df.sparkSession.createDataFrame([], df.schema).coalesce(1)
    return df.sparkSession.createDataFrame(rows, schema=df.schema).coalesce(1)


def bounded(df: DataFrame, max_rows: int = BOUNDED_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows, else leave it to a shuffle join, where adaptive
    execution splits hot keys."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(_local(df, rows))


def parts_of(spark: SparkSession) -> int:
    """Number of range buckets for global orders: follows the session's shuffle width, 64 at least."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    A folder is chosen here only when the session names none, which is the case in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
            folder = tempfile.mkdtemp(prefix="tarnfold-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
