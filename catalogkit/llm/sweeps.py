"""Tables in one global order: places of rows within their group, and runs of sorted rows inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogkit.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id() holds the partition above these bits


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``place`` (from 0) in the order of their group, and ``size``, the rows of the group.

    The table is sorted as a whole by ranges, so a group spreads over as many tasks as it
    fills; what a partition holds of each group is counted, and counts before it are added. Nulls
    come first, equal rows in any order. Columns of ``group`` must not be null.
    """
    rows = cut_lineage(df).withColumn("_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "_tie"]
    laid = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie"))
    laid = laid.withColumn("_row", F.monotonically_increasing_id())
    laid = laid.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    held = laid.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    own = Window.partitionBy(*group)
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = cut_lineage(held.withColumns({"_before": F.coalesce(before, F.lit(0)), "size": F.sum("_n").over(own)}))
    placed = laid.join(held, ["_part", *group]).withColumn("place", F.col("_row") - F.col("_first") + F.col("_before"))
    return placed.drop("_row", "_part", "_n", "_first", "_before")


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows that agree in their first ``keys`` columns, as they stream by."""
    rows = (row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns]))
    return groupby(rows, key=lambda row: row[:keys])


def batched(rows: Iterable[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key in one partition, sorted by key and order; the columns begin with ``keys``."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
