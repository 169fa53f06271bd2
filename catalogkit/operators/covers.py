"""Cover art: scores, choice of source, and the choice for a batch."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, values
from ..functions.columns import first_filled


def read_covers(spark: SparkSession, path: str) -> DataFrame:
    """Images with size and sharpness, decoded by Spark's image source."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    i = F.col("image")
    return images.select(
        i["origin"].alias("path"),
        i["width"].alias("width"),
        i["height"].alias("height"),
        values.sharpness("image").alias("sharpness"),
    ).withColumn("score", values.cover_quality_score("width", "height", "sharpness"))


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Write image files (name, content) into a folder that all executors reach; returns the paths.

    A file is written whole under its name, so a task that runs again writes the same.
    """

    def run(batches):
        from pyarrow import fs

        local = re.sub("^(file:)?/+", "file:///", folder)
        store, base = fs.FileSystem.from_uri(local)
        store.create_dir(base)
        for batch in batches:
            paths = [f"{base}/{name}" for name in batch.column("name").to_pylist()]
            for path, content in zip(paths, batch.column("content").to_pylist()):
                with store.open_output_stream(path) as out:
                    out.write(content)
            yield pa.record_batch([pa.array(paths, pa.string())], ["path"])

    return images.select("name", "content").mapInArrow(run, "path string")


def compare_covers(pairs: DataFrame) -> DataFrame:
    """Local and online covers with scores, the choice and doubts about upscaled images.

    ``pairs`` has width, height and sharpness of both, prefixed local_ and online_.
    """
    scored = pairs.withColumns(
        {
            f"{side}_score": values.cover_quality_score(f"{side}_width", f"{side}_height", f"{side}_sharpness")
            for side in ("local", "online")
        }
    )
    return scored.withColumns(
        {
            "choice": values.choose_cover("online_score", "local_score"),
            "local_fake": values.fake_upscale("local_width", "local_score", "online_score"),
            "online_fake": values.fake_upscale("online_width", "online_score", "local_score"),
        }
    )


def cover_fetch_list(albums: DataFrame) -> DataFrame:
    """Addresses to try for albums known by a MusicBrainz id, in order."""
    urls = extract.cover_candidate_urls("release_id")
    bare = ~F.col("release_id").rlike("^(discogs|touhoudb|thwiki|vocadb|utaitedb)_") & (F.col("release_id") != "")
    return albums.filter(bare).select("album_key", F.posexplode(urls).alias("rank", "url"))


def archive_covers(albums: DataFrame, fetched: DataFrame) -> DataFrame:
    """``(album_key, archive_url)``: the first archive address of each MusicBrainz album that was fetched."""
    present = fetched.filter(F.col("length") > 0).select("url").distinct()
    tried = cover_fetch_list(albums).join(present, "url", "left_semi")
    return tried.groupBy("album_key").agg(F.min_by("url", "rank").alias("archive_url"))


def without_archive_cover(albums: DataFrame, fetched: DataFrame) -> DataFrame:
    """MusicBrainz albums for which no archive address gave an image, to ask elsewhere."""
    asked = cover_fetch_list(albums).select("album_key").distinct()
    return albums.join(asked, "album_key", "left_semi").join(archive_covers(albums, fetched), "album_key", "left_anti")


def choose_cover_source(albums: DataFrame, fetched: DataFrame) -> DataFrame:
    """Where each album's cover comes from.

    A catalogue's own cover first; for MusicBrainz albums the first archive
    address that was fetched, then Discogs, then the wiki. ``albums`` has
    release_id, own_cover_url, discogs_cover_url (see ``resolve.with_discogs_covers``)
    and thwiki_cover_url; ``fetched`` has url and length.
    """
    archive = archive_covers(albums, fetched)
    joined = albums.join(archive, "album_key", "left")
    url = first_filled("own_cover_url", "archive_url", "discogs_cover_url", "thwiki_cover_url")
    source = (
        F.when(F.coalesce("own_cover_url", F.lit("")) != "", "catalogue")
        .when(F.col("archive_url").isNotNull(), "CoverArtArchive")
        .when(F.coalesce("discogs_cover_url", F.lit("")) != "", "Discogs")
        .when(F.coalesce("thwiki_cover_url", F.lit("")) != "", "THBWiki")
        .otherwise("")
    )
    return joined.select("album_key", url.alias("cover_url"), source.alias("cover_source"))


def batch_covers(items: DataFrame, batch: str = "batch") -> DataFrame:
    """Cover of each item in an approval batch.

    An item's own selected cover, else the batch's fallback, else online, else
    local. The fallback is the first item's selected cover, or before any item
    has one, the first cover seen. ``items`` has seq, choice ('online' or
    'local'), online_cover and local_cover, empty for none.
    """
    selected = F.when(F.col("choice") == "online", F.col("online_cover")).otherwise(F.col("local_cover"))
    own = F.nullif(selected, F.lit(""))
    any_cover = F.nullif(first_filled("online_cover", "local_cover"), F.lit(""))
    chosen = items.withColumns({"_own": own, "_any": any_cover})
    fallback = chosen.groupBy(batch).agg(
        F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col("seq"))).alias("_picked"),
        F.min_by("_any", F.when(F.col("_any").isNotNull(), F.col("seq"))).alias("_first"),
    )
    return chosen.join(fallback, batch, "left").select(
        *items.columns,
        F.coalesce("_own", "_picked", "_first", F.lit("")).alias("cover"),
    )
