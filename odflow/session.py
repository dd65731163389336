"""Session set-up and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app: str = "odflow",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC time.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    configuration decides, and adaptive execution merges small partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Naive timestamps are UTC throughout; pin the session zone to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="odflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    For tables that several jobs read (model fits, multi-branch reports): the
    lineage is cut, a lost executor costs a re-read and not a recomputation, and
    each reader takes only the columns and row groups it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Largest table sent to every executor by choice, in rows.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, weight: str | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a derived lookup table and mark it for broadcast if it is small.

    The planner cannot know the size of an aggregate before running it, and by
    then the other side has been shuffled. Here the size is counted first (rows,
    or the sum of ``weight``); above ``limit`` the join is left to the planner.
    """
    table = materialise(df, "lookup")
    size = table.agg(F.coalesce(F.sum(F.expr(weight or "1")), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= limit else table
