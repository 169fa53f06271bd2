"""The track catalog: queries, counts, de-duplication, upsert and full sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import extract, text
from ..functions.columns import ColumnOrName, col
from ..session import once

KEY = ["artist", "album", "title"]
COLUMNS = list(schemas.TRACK_COLUMNS)
CATALOG_ORDER = ["artist", "album", "track_no", "title"]
STATUS_FILTERS = {1: 1, 2: 0}
FORMAT_FILTERS = {1: "FLAC", 2: "MP3"}


def like_ascii(value: ColumnOrName, pattern: str) -> Column:
    """LIKE that folds A-Z only and knows no escape character."""
    safe = pattern.translate(str.maketrans(text.UPPER, text.LOWER)).replace("\\", "\\\\")
    return text.ascii_lower(value).like(safe)


def query_tracks(tracks: DataFrame, status: int = 0, format: int = 0, search: str = "") -> DataFrame:
    """Catalog rows by status, format and a search text; 0 and '' mean all.

    ``%`` and ``_`` in the search text act as wildcards.
    """
    if status in STATUS_FILTERS:
        tracks = tracks.filter(F.col("status") == STATUS_FILTERS[status])
    if format in FORMAT_FILTERS:
        tracks = tracks.filter(F.col("format") == FORMAT_FILTERS[format])
    if search:
        pattern = f"%{search}%"
        tracks = tracks.filter(
            like_ascii("artist", pattern) | like_ascii("album", pattern) | like_ascii("title", pattern)
        )
    return tracks.select(*[c for c in COLUMNS if c in tracks.columns])


def catalog_sorted(tracks: DataFrame) -> DataFrame:
    """Catalog order: artist, album, track number as text, title."""
    return tracks.orderBy(*CATALOG_ORDER)


def catalog_counts(tracks: DataFrame) -> DataFrame:
    """One row: all, downloaded and missing tracks."""
    return tracks.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == 1).alias("downloaded"),
        F.count_if(F.col("status") == 0).alias("missing"),
    )


def dedup_prefer_lossless(tracks: DataFrame, order: str = "seq") -> DataFrame:
    """One row per key, letter case aside: the first FLAC, else the first row."""
    rank = F.struct((F.col("format") != "FLAC").alias("lossy"), F.col(order))
    keys = [text.ascii_lower(k).alias(f"_{k}") for k in KEY]
    kept = tracks.groupBy(*keys).agg(F.min_by(F.struct(*tracks.columns), rank).alias("row"))
    return kept.select("row.*")


def upsert_tracks(tracks: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Merge a batch: new keys are added, known keys take only status and format.

    A key repeated in the batch takes its other columns from its first row and
    status and format from its last one. One aggregation, no join.
    """
    others = [c for c in tracks.columns if c not in {*KEY, "status", "format", order}]
    arrival = F.struct("_source", order)
    merged = (
        tracks.withColumn("_source", F.lit(0))
        .unionByName(batch.withColumn("_source", F.lit(1)))
        .groupBy(*KEY)
        .agg(
            F.min_by(F.struct(order, *others), arrival).alias("first"),
            F.max_by(F.struct("status", "format"), arrival).alias("last"),
        )
    )
    return merged.select(*KEY, "first.*", "last.*").select(*tracks.columns)


def sync_catalog(inventory: DataFrame) -> DataFrame:
    """Catalog rows of the audio files on disk, lossless copies preferred.

    ``inventory`` has ``rel_path`` (from the scanned root) and ``ext``.
    """
    audio = inventory.filter(F.col("ext").isin(".flac", ".mp3"))
    tags = extract.parse_catalog_path("rel_path")
    rows = once(audio.select("rel_path"), {"t": tags}).select(
        "t.*",
        F.lit("").alias("year"),
        F.lit(0).alias("duration_sec"),
        F.lit(1).alias("status"),
        "rel_path",
    )
    return dedup_prefer_lossless(rows, order="rel_path")


def scan_root(exists_flac: bool, exists_mp3: bool, flac_dir: str, mp3_dir: str, base_dir: str) -> str:
    """Folder that the catalog follows: the FLAC tree, else the MP3 tree, else the base."""
    if exists_flac:
        return flac_dir
    return mp3_dir if exists_mp3 else base_dir


def union_inventories(*inventories: DataFrame) -> DataFrame:
    """Files of several roots as one inventory."""
    first, *rest = inventories
    for other in rest:
        first = first.unionByName(other)
    return first
