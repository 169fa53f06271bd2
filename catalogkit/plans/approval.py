"""Plans for approved items: where files, tags and covers go, and what is left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, text
from ..functions.columns import ColumnOrName, col, first_filled
from ..operators.lyrics import batch_lookup
from ..sources.inventory import AUDIO_EXTENSIONS
from .files import COVER_FILE, ancestor_folders, join_path, union_plans

# Covers that give way to one already at the target.
COVER_NAMES = ("cover.jpg", "cover.jpeg", "cover.png")


def approval_targets(items: DataFrame, flac_root: str = "flac", mp3_root: str = "mp3") -> DataFrame:
    """Items with their extension, target folders and target file name."""
    # In steps of several columns each, so that no name is cleaned twice.
    named = {f"_{c}": text.sanitize_filename(c) for c in ("artist", "album", "title")}
    inner = items.withColumns(named).withColumn("_inner", join_path("_artist", "_album"))
    return inner.withColumns(
        {
            "ext": text.file_extension("path"),
            "flac_dir": join_path(F.lit(flac_root), "_inner"),
            "mp3_dir": join_path(F.lit(mp3_root), "_inner"),
            "base_name": F.concat("track_no", F.lit(". "), "_title"),
        }
    ).drop("_inner", *named)


def plan_approval(
    items: DataFrame, existing: DataFrame | None = None, flac_root: str = "flac", mp3_root: str = "mp3"
) -> DataFrame:
    """Tag, move, convert and copy rows of approved items, and covers of their target folders.

    A FLAC moves to the FLAC tree and is converted into the MP3 tree; an MP3 moves
    to the MP3 tree and is copied into the FLAC tree. A folder's cover is written
    when missing or of another size. ``items`` has seq, path, artist, album,
    title, track_no, is_processed, cover and cover_length; ``existing`` has path
    and length of files in the target trees.
    """
    placed = approval_targets(items.filter(~F.col("is_processed")), flac_root, mp3_root)
    # Made below the explode, whose steps name each of them several times.
    aimed = placed.filter(F.col("ext").isin(".flac", ".mp3")).withColumns(
        {
            "flac_file": join_path("flac_dir", F.concat("base_name", F.lit(".flac"))),
            "mp3_file": join_path("mp3_dir", F.concat("base_name", F.lit(".mp3"))),
            "mp3_in_flac": join_path("flac_dir", F.concat("base_name", F.lit(".mp3"))),
        }
    )
    flac_file, mp3_file, mp3_in_flac = F.col("flac_file"), F.col("mp3_file"), F.col("mp3_in_flac")
    src = F.col("path")

    def step(action: str, source: Column, target: Column, reason: str) -> Column:
        return F.struct(
            F.lit(action).alias("action"), source.alias("src"), target.alias("dst"), F.lit(reason).alias("reason")
        )

    flac_steps = F.array(
        step("tag", src, src, "vorbis"),
        step("move", src, flac_file, "approved_flac"),
        step("convert", flac_file, mp3_file, "mp3_mirror"),
        step("tag", mp3_file, mp3_file, "id3"),
    )
    mp3_steps = F.array(
        step("tag", src, src, "id3"),
        step("move", src, mp3_file, "approved_mp3"),
        step("copy", mp3_file, mp3_in_flac, "mp3_fallback"),
    )
    steps = aimed.select(
        F.explode(F.when(F.col("ext") == ".flac", flac_steps).otherwise(mp3_steps)).alias("s")
    ).select("s.*")

    covers = (
        placed.filter((F.col("cover") != "") & F.col("ext").isin(".flac", ".mp3"))
        .select("seq", "cover", "cover_length", F.explode(F.array("flac_dir", "mp3_dir")).alias("dir"))
        .groupBy("dir")
        .agg(F.max_by(F.struct("cover", "cover_length"), "seq").alias("c"))
        .select(F.col("c.cover").alias("src"), join_path("dir", F.lit(COVER_FILE)).alias("dst"), "c.cover_length")
    )
    if existing is not None:
        present = existing.select(F.col("path").alias("dst"), F.col("length").alias("cover_length"))
        covers = covers.join(present, ["dst", "cover_length"], "left_anti")
    cover_rows = covers.select(F.lit("write_cover").alias("action"), "src", "dst", F.lit("cover").alias("reason"))
    return union_plans(steps, cover_rows)


def fill_lyrics(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Items whose empty ``lyrics_text`` is filled from captured LRCLIB replies before tags are written.

    A null artist, title or album is asked for as an empty one; other columns, ``lyrics`` among them, stay.
    """
    keys = {c: F.coalesce(F.col(c), F.lit("")) for c in ("artist", "title", "album")}
    asked = items.filter(F.coalesce("lyrics_text", F.lit("")) == "").select(*[v.alias(c) for c, v in keys.items()]).distinct()
    found = batch_lookup(asked, replies).filter("lyrics != ''")
    found = found.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("lyrics").alias("_found"))
    met = [F.col(f"_{c}") == v for c, v in keys.items()]
    return items.join(found, met, "left").select(
        *[first_filled("lyrics_text", "_found").alias(c) if c == "lyrics_text" else items[c] for c in items.columns]
    )


def collision_report(plan: DataFrame) -> DataFrame:
    """Targets that more than one moved or converted file would take."""
    return (
        plan.filter(F.col("action").isin("move", "copy", "convert"))
        .groupBy("dst")
        .agg(F.count("*").alias("sources"), F.min("src").alias("first_src"), F.max("src").alias("last_src"))
        .filter(F.col("sources") > 1)
    )


def plan_leftovers(files: DataFrame, approved: DataFrame, existing: DataFrame) -> DataFrame:
    """Where the other files of emptied source folders go.

    A source folder without audio left hands its files to its items' FLAC target
    and copies them to the MP3 target; a cover that the target has already is
    dropped. Of nested source folders the outermost takes the file. ``files`` is
    the inbox (rel_path, ext), ``approved`` has seq, rel_path and target folders,
    ``existing`` has path.
    """
    left = files.join(approved.select("rel_path"), "rel_path", "left_anti")
    targets = (
        approved.withColumn("dir", text.parent_folder("rel_path"))
        .groupBy("dir")
        .agg(F.max_by(F.struct("flac_dir", "mp3_dir"), "seq").alias("t"))
    )
    spread = left.select("rel_path", "ext", F.posexplode(ancestor_folders("rel_path")).alias("depth", "dir"))
    sounding = spread.filter(F.col("ext").isin(*AUDIO_EXTENSIONS)).select("dir").distinct()
    emptied = targets.join(sounding, "dir", "left_anti")
    owned = (
        spread.join(emptied, "dir")
        .groupBy("rel_path")
        .agg(F.min_by(F.struct("dir", "t"), "depth").alias("o"))
        .withColumn("inner", F.substring("rel_path", F.length("o.dir") + 2, F.length("rel_path")))
    )
    aimed = owned.select(
        F.col("rel_path").alias("src"),
        join_path("o.t.flac_dir", "inner").alias("flac_file"),
        join_path("o.t.mp3_dir", "inner").alias("mp3_file"),
        text.ascii_lower(text.file_name("rel_path")).isin(*COVER_NAMES).alias("is_cover"),
    )
    taken = existing.select(F.col("path").alias("flac_file")).distinct().withColumn("taken", F.lit(True))
    decided = aimed.join(taken, "flac_file", "left").withColumn(
        "drop", F.col("is_cover") & F.coalesce("taken", F.lit(False))
    )

    def step(action: str, source: ColumnOrName, target: Column, reason: str) -> Column:
        return F.struct(
            F.lit(action).alias("action"), col(source).alias("src"), target.alias("dst"), F.lit(reason).alias("reason")
        )

    rows = F.when(F.col("drop"), F.array(step("delete", "src", F.lit(""), "cover_present"))).otherwise(
        F.array(
            step("move", "src", F.col("flac_file"), "leftover"),
            step("copy", "flac_file", F.col("mp3_file"), "leftover"),
        )
    )
    return decided.select(F.explode(rows).alias("s")).select("s.*")


def tag_manifest(items: DataFrame, style: str) -> DataFrame:
    """Tags that would be written per file; empty ones are left out.

    ``style`` is 'vorbis' or 'id3'. The picture's type is read from its first
    bytes for ID3 and is always JPEG for Vorbis. ``items`` has path, artist,
    album, title, track_no, year, lyrics_text and cover_bytes.
    """
    year = extract.extract_year("year")
    has_cover = F.octet_length("cover_bytes") > 0
    png = F.substring("cover_bytes", 1, 4) == F.unhex(F.lit("89504E47"))
    names = {
        "vorbis": {
            "ARTIST": "artist", "ALBUM": "album", "TITLE": "title", "TRACKNUMBER": "track_no",
            "DATE": "year", "YEAR": year, "LYRICS": "lyrics_text",
            "PICTURE": F.when(has_cover, "image/jpeg"),
        },
        "id3": {
            "TPE1": "artist", "TALB": "album", "TIT2": "title", "TRCK": "track_no",
            "TDRC": "year", "TYER": year, "USLT": "lyrics_text",
            "APIC": F.when(has_cover & png, "image/png").when(has_cover, "image/jpeg"),
        },
    }[style]
    pairs = [part for name, value in names.items() for part in (F.lit(name), F.coalesce(col(value), F.lit("")))]
    return items.select("path", F.map_filter(F.create_map(*pairs), lambda _, v: v != "").alias("tags"))
