"""Session settings that the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "catalogkit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time.

    Size ``spark.sql.shuffle.partitions`` for the cluster; adaptive execution
    merges small partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this name that driver and executors share.

    It lies in ``spark.checkpoint.dir``, or below the warehouse where that is not set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{base.rstrip('/')}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder of the cluster."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Rows written once into the shared folder of the cluster, as Parquet: later reads take the columns they need.

    For rows that several branches of a query read, with columns that Parquet can hold.
    """
    folder = shared_folder(df.sparkSession, f"written-{uuid.uuid4()}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written_by(df: DataFrame, *keys: str) -> DataFrame:
    """``written`` in buckets by keys, so that joins and groupings on them move none of these rows."""
    spark, name = df.sparkSession, f"written_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
    writer.option("path", shared_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions run once per row.

    Filters, joins and groupings on a projected column are pushed below it and
    compute it again each time. They cannot pass a generator, so the columns come
    out of one that yields a single row.
    """
    made = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(made)).alias("_once")).select(
        *kept, *[F.col(f"_once.{name}").alias(name) for name in columns]
    )
