"""Durations, positions, dates and cover scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ColumnOrName, col, filled, leading_int, let


def parse_duration_ms(value: ColumnOrName) -> Column:
    """Milliseconds of s, m:s or h:m:s; other shapes give 0."""

    def seconds(parts: Column) -> Column:
        n = F.size(parts)
        total = (
            F.when(n == 1, F.get(parts, 0))
            .when(n == 2, F.get(parts, 0) * 60 + F.get(parts, 1))
            .when(n == 3, F.get(parts, 0) * 3600 + F.get(parts, 1) * 60 + F.get(parts, 2))
            .otherwise(0)
        )
        return F.coalesce(total, F.lit(0)) * 1000

    numbers = F.transform(F.split(col(value), ":"), leading_int)
    return let(F.filter(numbers, lambda p: p.isNotNull()), seconds)


def parse_position(value: ColumnOrName, default: ColumnOrName) -> Column:
    """All digits of a position read as one number, else the default."""
    digits = filled(F.regexp_replace(col(value), "[^0-9]", "")).try_cast("int")
    return F.coalesce(F.when(digits > 0, digits), col(default))


def format_release_date(year: ColumnOrName, month: ColumnOrName, day: ColumnOrName) -> Column:
    """YYYY.MM.DD when all parts are known, the year alone, or empty."""
    y, m, d = (F.coalesce(col(v).cast("int"), F.lit(0)) for v in (year, month, day))
    return (
        F.when((y > 0) & (m > 0) & (d > 0), F.format_string("%04d.%02d.%02d", y, m, d))
        .when(y > 0, y.cast("string"))
        .otherwise("")
    )


def format_elapsed(seconds: ColumnOrName) -> Column:
    """MM:SS; minutes run on past the hour."""
    s = F.floor(col(seconds)).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), s % 60)


def format_eta(seconds: ColumnOrName) -> Column:
    """MM:SS, or HH:MM:SS from one hour on."""
    s = F.floor(col(seconds)).cast("int")
    long_form = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, s % 60)
    return F.when(s >= 3600, long_form).otherwise(format_elapsed(s))


def cover_quality_score(width: ColumnOrName, height: ColumnOrName, sharpness: ColumnOrName) -> Column:
    """Score of a cover by size, area, squareness and sharpness; 0 without pixels."""
    w, h = col(width).cast("bigint"), col(height).cast("bigint")
    longest, shortest = F.greatest(w, h), F.least(w, h)
    aspect = shortest.cast("double") / F.nullif(longest, F.lit(0)).cast("double")
    size_points = (
        F.when(longest >= 1400, 500_000_000)
        .when(longest >= 900, 400_000_000)
        .when(longest >= 600, 300_000_000)
        .when(longest >= 400, 200_000_000)
        .otherwise(longest * 300_000)
    ).cast("bigint")
    shape_points = F.when(aspect >= 0.95, 50_000_000).when(aspect >= 0.85, 20_000_000).otherwise(0)
    sharp_points = F.least((F.coalesce(col(sharpness), F.lit(0.0)) * 1000.0).cast("bigint"), F.lit(100_000_000))
    return F.when((w > 0) & (h > 0), size_points + w * h * 50 + shape_points + sharp_points).otherwise(
        F.lit(0)
    ).cast("bigint")


def fake_upscale(width: ColumnOrName, score: ColumnOrName, other_score: ColumnOrName) -> Column:
    """A wide cover whose score stays under a third of the other one's."""
    third = F.floor(col(other_score) / 3).cast("bigint")
    return (col(width) >= 1000) & (col(score) < third)


def choose_cover(online_score: ColumnOrName, local_score: ColumnOrName) -> Column:
    """'online' when it scores strictly higher, else 'local'."""
    return F.when(col(online_score) > col(local_score), "online").otherwise("local")


def _laplacian_variance(data: bytes, height: int, width: int, channels: int) -> float:
    """Variance of the absolute 4-neighbour Laplacian at every second pixel."""
    if data is None or height < 4 or width < 4:
        return 0.0
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        grey = pixels[:, :, 0].astype(np.int64)
    else:
        blue, green, red = (pixels[:, :, i].astype(np.int64) for i in range(3))
        grey = (red * 77 + green * 150 + blue * 29) >> 8
    edge = np.abs(4 * grey[1:-1, 1:-1] - grey[:-2, 1:-1] - grey[2:, 1:-1] - grey[1:-1, :-2] - grey[1:-1, 2:])
    return float(np.var(edge[::2, ::2]))


@F.pandas_udf(T.DoubleType())
def _sharpness(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    rows = zip(data, height, width, channels)
    return pd.Series([_laplacian_variance(*row) for row in rows], dtype="float64")


def sharpness(image: ColumnOrName) -> Column:
    """Sharpness of an image struct as Spark's image source gives it (BGR bytes).

    Grey is (77 R + 150 G + 29 B) >> 8.
    """
    i = col(image)
    return _sharpness(i["data"], i["height"], i["width"], i["nChannels"])
