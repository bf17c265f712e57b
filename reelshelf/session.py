"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "reelshelf", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew handling and a UTC clock.

    Cluster sizing (executors, shuffle partitions, memory) is left to
    ``spark-submit`` or to ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Larger methods are never compiled by the JVM; wide projections run
        # faster as several small ones.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder, because other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    The copy outlives lost executors, cuts lineage, and gives Catalyst the true
    size of the data, so the broadcast threshold is applied to facts.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/reelshelf/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies; a missing one is fine."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


# Rows a lookup may have before we stop asking for a broadcast.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` stays under ``rows``.

    The probe stops at ``rows + 1`` records. A larger side is returned without a
    hint and joins by shuffle.
    """
    probe = df.select(df.columns[0]).limit(rows + 1).count()
    return df.hint("broadcast") if probe <= rows else df
