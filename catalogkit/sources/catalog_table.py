"""The catalog as a stored table: creation, full refresh and upsert.

A refresh writes a snapshot of its own, in parts by the hash of the key, and then points readers
at it; until that row is there they see the one before, whole. An upsert replaces those parts
of the current snapshot that its keys fall into. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.catalog import KEY, upsert_tracks
from ..session import written

TEXT_DEFAULT, NUMBER_DEFAULT = "", 0
#: Parts of a snapshot unless a refresh says otherwise.
PARTS = 64


def _current(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of the snapshot that readers see (0: none yet) and its parts."""
    rows = spark.read.schema("snapshot long, parts int").parquet(f"{path}/current")
    last = rows.agg(F.max(F.struct("snapshot", "parts")).alias("last")).first()["last"]
    return (last["snapshot"], last["parts"]) if last else (0, PARTS)


def _point(spark: SparkSession, path: str, snapshot: int, parts: int, mode: str) -> None:
    rows = spark.createDataFrame([(snapshot, parts)], "snapshot long, parts int").coalesce(1)
    rows.write.mode(mode).parquet(f"{path}/current")


def _snapshot(path: str, number: int) -> str:
    return f"{path}/snapshots/{number}"


def _parts_of(spark: SparkSession, path: str) -> DataFrame:
    number, _ = _current(spark, path)
    if not number:
        return spark.createDataFrame([], f"{schemas.TRACKS}, part int")
    return spark.read.schema(f"{schemas.TRACKS}, part int").parquet(_snapshot(path, number))


def init_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog at a path; an empty one is made where there is none."""
    _point(spark, path, 0, PARTS, "ignore")
    return read_catalog(spark, path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Stored catalog rows."""
    return _parts_of(spark, path).drop("part")


def _stored_columns(rows: DataFrame) -> list[Column]:
    """All stored columns but the id, with defaults for what the rows lack."""
    columns = []
    for name, kind in schemas.TRACK_COLUMNS.items():
        if name == "id":
            continue
        default = TEXT_DEFAULT if kind == "STRING" else NUMBER_DEFAULT
        value = F.col(name) if name in rows.columns else F.lit(None)
        columns.append(F.coalesce(value.cast(kind.lower()), F.lit(default).cast(kind.lower())).alias(name))
    return columns


def _by_part(placed: DataFrame) -> DataFrame:
    """Rows of a part together, a large part over several tasks."""
    return placed.hint("rebalance", "part")


def _placed(rows: DataFrame, parts: int, *others: Column) -> DataFrame:
    """Rows as they are stored. ``id`` is a signed hash of the key, for joins; the key itself is what is unique."""
    stored = rows.select(F.xxhash64(*KEY).alias("id"), *_stored_columns(rows), *others)
    return stored.withColumn("part", F.pmod("id", F.lit(parts)).cast("int"))


def refresh_catalog(rows: DataFrame, path: str, parts: int = PARTS) -> None:
    """Replace the stored catalog by these rows, which may come from it.

    Readers see the old rows until all new ones are written. Set ``parts`` so that one fits a task.
    """
    spark = rows.sparkSession
    _point(spark, path, 0, parts, "ignore")
    number = _current(spark, path)[0] + 1
    # What a refresh that was cut short has left under this number goes.
    _by_part(_placed(rows, parts)).write.mode("overwrite").partitionBy("part").parquet(_snapshot(path, number))
    _point(spark, path, number, parts, "append")


def merge_into_catalog(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Upsert a batch (ordered by ``seq``) into the catalog at ``path`` and return it.

    Parts without a key of the batch are neither read nor written.
    """
    number, parts = _current(spark, path)
    if not number:
        refresh_catalog(spark.createDataFrame([], schemas.TRACKS), path, parts)
        number, parts = _current(spark, path)
    order = F.col("seq").cast("bigint").alias("seq")
    # Worked out once, for its parts and for its rows.
    batch = written(_placed(batch, parts, order))
    touched = [row["part"] for row in batch.select("part").distinct().collect()]  # at most ``parts``
    stored = _parts_of(spark, path).filter(F.col("part").isin(touched)).drop("id", "part").withColumn("seq", F.lit(0).cast("bigint"))
    merged = upsert_tracks(stored, batch.drop("id", "part"))
    # Written before the parts that it was read from are replaced.
    made = written(_placed(merged, parts))
    _by_part(made).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(
        _snapshot(path, number))
    return read_catalog(spark, path)
