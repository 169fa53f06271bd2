"""Output of the fingerprint tool as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrName, col, filled


def _line_value(output: Column, name: str) -> Column:
    return F.regexp_extract(output, rf"(?m)^{name}=(.*)$", 1)


def _duration(output: Column) -> Column:
    number = F.regexp_extract(_line_value(output, "DURATION"), r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1)
    return F.coalesce(filled(number).try_cast("double"), F.lit(0.0))


def parse_fingerprint(raw_output: ColumnOrName, base64_output: ColumnOrName | None = None) -> Column:
    """STRUCT<duration, frames, fp_b64> of the tool's raw and base64 outputs.

    Frames are unsigned 32-bit values held as BIGINT; what is no number is
    skipped. The base64 run gives the duration only where the raw run has none.
    """
    raw = F.coalesce(col(raw_output), F.lit(""))
    coded = F.coalesce(col(base64_output), F.lit("")) if base64_output is not None else F.lit("")
    numbers = F.transform(
        F.split(_line_value(raw, "FINGERPRINT"), ","),
        lambda v: filled(F.regexp_extract(v, r"^\s*\+?([0-9]+)", 1)).try_cast("bigint"),
    )
    return F.struct(
        F.coalesce(F.nullif(_duration(raw), F.lit(0.0)), _duration(coded)).alias("duration"),
        F.filter(numbers, lambda v: v.isNotNull()).alias("frames"),
        F.rtrim(_line_value(coded, "FINGERPRINT"), F.lit("\r\n ")).alias("fp_b64"),
    )


def read_fingerprints(spark: SparkSession, raw_path: str, base64_path: str | None = None) -> DataFrame:
    """One row per output file; the two runs are paired by file name."""

    def outputs(path: str, name: str) -> DataFrame:
        files = spark.read.text(path, wholetext=True)
        stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
        return files.select(stem.alias("path"), F.col("value").alias(name))

    rows = outputs(raw_path, "raw")
    if base64_path:
        rows = rows.join(outputs(base64_path, "coded"), "path", "full_outer")
        parsed = parse_fingerprint("raw", "coded")
    else:
        parsed = parse_fingerprint("raw")
    return rows.select("path", parsed.alias("f")).select("path", "f.*")
