"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: The fallback folder of each local application.
_LOCAL_DIRS: dict[str, str] = {}


def get_spark(app: str = "memspark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator here is written against.

    UTC (timestamps compare across engines), AQE with skew-join splitting, and
    broadcast left to the planner's own size check. Cluster sizing is the
    caller's: anything in ``conf`` (dots written as ``__``) wins.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session (tests, the bench) may fall back to a folder of
    its own; on a cluster a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if spark.sparkContext.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="memspark-")
    return _LOCAL_DIRS[spark.sparkContext.applicationId]


def run_dir(spark: SparkSession, label: str) -> str:
    """A new folder under :func:`shared_dir` for one run's written tables."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    Used between the rounds of iterative jobs and under results that feed
    several branches. A written table survives the loss of any executor.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a scan that arrives in fewer partitions than there are cores.

    A file with one row group is one task however heavy the expressions on top
    are. On a large table the scan already has more splits than cores and this
    returns ``df`` unchanged, so no shuffle is added there.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)


def local_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table as a local relation, so the planner knows its size."""
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, zip(*rows))}))
