"""Run logs as tables, and how many lines fall in each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrName, col
from .tracklist import read_lines

# Markers that put a log line in a class, tried in this order.
LOG_CLASSES = {
    "matched": [
        "[MUSICBRAINZ MATCHED]", "[ACOUSTID MATCHED]", "[MUSICBRAINZ TIER A SUCCESS]",
        "[MUSICBRAINZ TIER B SUCCESS]", "[MUSICBRAINZ TIER C SUCCESS]", "[TAGS EMBEDDED]",
    ],
    "cover": ["[COVER ART DOWNLOADED]", "[COVER SAVED]"],
    "lookup": ["[MUSICBRAINZ FETCH", "[MUSICBRAINZ TIER", "[ACOUSTID FINGERPRINT]"],
    "problem": [
        "[AUTO-DELETE]", "[DECISION]", "[HTTP 429", "[HTTP 503", "[HTTP ERROR",
        "[COVER ART MISSING]", "[SKIPPED]",
    ],
    "lyrics": ["[LRC LYRICS FETCHED]"],
    "action": ["[TAGS APPLIED", "[CLIPBOARD]", "[ALBUM CACHE HIT]"],
}


def log_class(line: ColumnOrName) -> Column:
    """Class of a log line by its marker, else 'plain'."""
    out = None
    for name, markers in LOG_CLASSES.items():
        test = F.lit(False)
        for marker in markers:
            test = test | F.contains(col(line), F.lit(marker))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("plain")


def parse_log_line(line: ColumnOrName) -> Column:
    """STRUCT<time, level, message, class> of '[HH:MM:SS] [LEVEL] message'."""
    pattern = r"(?s)^\[([0-9]{2}:[0-9]{2}:[0-9]{2})\] \[([A-Z]+)\] (.*)$"
    return F.struct(
        F.regexp_extract(col(line), pattern, 1).alias("time"),
        F.regexp_extract(col(line), pattern, 2).alias("level"),
        F.regexp_extract(col(line), pattern, 3).alias("message"),
        log_class(line).alias("class"),
    )


def log_date(file: ColumnOrName) -> Column:
    """Start of the run from the name of a saved log, as a timestamp."""
    stamp = F.regexp_extract(col(file), "logs_([0-9]{8}_[0-9]{6})", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Saved run logs, one row per line."""
    lines = read_lines(spark, path)
    return lines.select("file", "line_no", log_date("file").alias("run"), parse_log_line("line").alias("p")).select(
        "file", "line_no", "run", "p.*"
    )


def log_rollup(log: DataFrame) -> DataFrame:
    """Lines per class."""
    return log.groupBy("class").agg(F.count("*").alias("lines"))
