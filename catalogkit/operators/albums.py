"""Album clusters, membership, release summaries and review state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..functions.columns import ColumnOrName, col, first_filled
from ..functions.extract import UNKNOWN_ARTIST
from ..session import once

# Folder names that say nothing about an album.
EMPTY_ALBUM_KEYS = ("", "unknown", "tosort", "music", "media")


def album_key(album: ColumnOrName, folder: ColumnOrName) -> Column:
    """Key of the album title, or of the folder when the title says nothing."""
    key = text.normalize_key(album)
    return F.when(key.isin(*EMPTY_ALBUM_KEYS), text.normalize_key(folder)).otherwise(key)


def with_album_key(items: DataFrame) -> DataFrame:
    """Items with their album key."""
    return once(items, {"album_key": album_key("album", "folder")})


def cluster_albums(items: DataFrame) -> DataFrame:
    """One row per album key: size, first and last member and the lead item's tags.

    Members stay at item grain: they share the key.
    """
    lead = F.struct("path", "folder", "filename", "artist", "album", "title")
    return items.groupBy("album_key").agg(
        F.count("*").alias("tracks"),
        F.min("seq").alias("lead_seq"),
        F.max("seq").alias("last_seq"),
        F.min_by(lead, "seq").alias("lead"),
    )


def unprocessed(items: DataFrame) -> DataFrame:
    """Items still to review."""
    return items.filter(~F.col("is_processed"))


def next_unprocessed(items: DataFrame) -> DataFrame:
    """Position of the next item to review."""
    return unprocessed(items).agg(F.min("seq").alias("next_seq"))


def mark_processed(items: DataFrame, decided: DataFrame) -> DataFrame:
    """Set the flag of decided items (by seq)."""
    done = decided.select("seq").distinct().withColumn("_done", F.lit(True))
    return items.join(done, "seq", "left").withColumn(
        "is_processed", F.col("is_processed") | F.coalesce("_done", F.lit(False))
    ).drop("_done")


def tier_group(tier: ColumnOrName) -> Column:
    """Group a tier counts in."""
    groups = F.create_map(*[F.lit(v) for pair in schemas.TIER_GROUPS.items() for v in pair])
    return F.coalesce(F.element_at(groups, col(tier)), F.lit("Niche"))


def release_summary(items: DataFrame) -> DataFrame:
    """One row per album key over items to review.

    The artist is the first known one, else the last value; album, release id
    and date are the first filled ones; the tier is that of the row giving the
    release id, else of the first row.
    """

    def first(value: str, condition: Column) -> Column:
        return F.min_by(value, F.when(condition, F.col("seq")))

    def filled(name: str) -> Column:
        return F.col(name) != ""

    known = ~F.col("artist").isin("", UNKNOWN_ARTIST)
    return (
        unprocessed(items)
        .groupBy("album_key")
        .agg(
            F.count("*").alias("files"),
            F.min("seq").alias("first_seq"),
            F.coalesce(first("artist", known), F.max_by("artist", "seq")).alias("artist"),
            F.coalesce(first("album", filled("album")), F.lit("")).alias("album"),
            F.coalesce(first("release_id", filled("release_id")), F.lit("")).alias("release_id"),
            F.coalesce(first("tier", filled("release_id")), F.min_by("tier", "seq")).alias("tier"),
            F.coalesce(first("year", filled("year")), F.lit("")).alias("release_date"),
            F.bool_or("is_fetched").alias("fetched"),
        )
    )


def tier_rollup(summary: DataFrame) -> DataFrame:
    """Releases and files per tier group."""
    return summary.groupBy(tier_group("tier").alias("tier_group")).agg(
        F.count("*").alias("releases"), F.sum("files").alias("files")
    )


# Codes of the tier filter; code 4 takes only the local tier.
TIER_FILTERS = {
    1: ("AcoustId", "TierA"),
    2: ("TierB_Verified", "TierB_Fallback", "TierB_Katakana"),
    3: ("TierC_Loose",),
    4: ("Niche_Local",),
    5: ("Discogs",),
    6: ("TouhouDB",),
    7: ("VocaDB",),
    8: ("UtaiteDB",),
    9: ("THBWiki",),
}


def filter_summary(summary: DataFrame, tier: int = 0, search: str = "") -> DataFrame:
    """Releases of a tier code whose artist, album or release id holds the search text."""
    if tier in TIER_FILTERS:
        summary = summary.filter(F.col("tier").isin(*TIER_FILTERS[tier]))
    if search:
        needle = F.lit(search.translate(str.maketrans(text.UPPER, text.LOWER)))
        hits = [F.contains(text.ascii_lower(c), needle) for c in ("artist", "album", "release_id")]
        summary = summary.filter(hits[0] | hits[1] | hits[2])
    return summary


def _membership_keys(rows: DataFrame) -> DataFrame:
    """(kind, value) keys under which a row can belong to an album."""
    title_key = text.normalize_key("album")
    named = F.when(~title_key.isin(*EMPTY_ALBUM_KEYS), title_key)
    keys = F.array(
        F.struct(F.lit("folder").alias("kind"), F.nullif("folder", F.lit("")).alias("value")),
        F.struct(F.lit("release").alias("kind"), F.nullif("release_id", F.lit("")).alias("value")),
        F.struct(F.lit("album").alias("kind"), named.alias("value")),
    )
    return rows.select("seq", "is_processed", F.explode(keys).alias("k")).select(
        "seq", "is_processed", "k.kind", "k.value"
    ).filter(F.col("value").isNotNull())


def album_classes(items: DataFrame, references: DataFrame) -> DataFrame:
    """(role, kind, value, seq): what album each reference stands for, without pairs.

    A class is a folder, a release or an album title. 'reference' rows name the classes that make up a
    reference's album, at most three and, while it is to review, one of its own ('item'); 'member' rows are the items to
    review of each class that some reference has. Together they say as much as ``album_members``
    but grow with the rows, not with references times members.
    """
    wanted = _membership_keys(references).select("kind", "value", "seq")
    members = _membership_keys(unprocessed(items)).select("kind", "value", "seq")
    met = members.join(wanted.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    parts = [rows.select(F.lit(role).alias("role"), "kind", "value", "seq") for role, rows in (("reference", wanted), ("member", met))]
    # Both roles of a class of its own follow from one row.
    roles = F.explode(F.array(F.lit("reference"), F.lit("member"))).alias("role")
    own = unprocessed(references).select("seq").distinct().select(roles, F.lit("item").alias("kind"), F.col("seq").cast("string").alias("value"), "seq")
    return parts[0].unionAll(parts[1]).distinct().unionAll(own)


def members_of(classes: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(ref_seq, seq) from ``album_classes``, for all references or the given ones (seq)."""
    wanted = classes.filter("role = 'reference'").select("kind", "value", F.col("seq").alias("ref_seq"))
    if references is not None:
        wanted = wanted.join(references.select(F.col("seq").alias("ref_seq")).distinct(), "ref_seq", "left_semi")
    members = classes.filter("role = 'member'").select("kind", "value", "seq")
    return wanted.join(members, ["kind", "value"]).select("ref_seq", "seq").distinct()


def album_members(items: DataFrame, references: DataFrame) -> DataFrame:
    """(ref_seq, seq): the items to review that share folder, release or album with each reference.

    The three alternatives are one equality join on (kind, value). A reference
    always belongs to its own album while it is to review. Every pair is a row, so
    give the few references that are asked for; ``album_classes`` answers for all.
    """
    return members_of(album_classes(items, references))


def album_selection(items: DataFrame, references: DataFrame) -> DataFrame:
    """Items to review that belong to the album of any reference.

    Same rule as ``album_members`` but as semi joins on distinct keys, so large
    albums are not paired with their references.
    """
    wanted = _membership_keys(references).select("kind", "value").distinct()
    seqs = _membership_keys(unprocessed(items)).join(wanted, ["kind", "value"], "left_semi").select("seq")
    own = unprocessed(references).select("seq")
    return unprocessed(items).join(seqs.unionByName(own), "seq", "left_semi")


def folder_classes(items: DataFrame, references: DataFrame) -> DataFrame:
    """(role, value, seq): the folder of each reference, and all items of those folders, reviewed or not."""
    wanted = references.select(F.lit("reference").alias("role"), F.col("folder").alias("value"), "seq")
    members = items.select(F.lit("member").alias("role"), F.col("folder").alias("value"), "seq")
    return wanted.unionAll(members.join(wanted.select("value").distinct(), "value", "left_semi").select(wanted.columns))


def folder_members(items: DataFrame, references: DataFrame) -> DataFrame:
    """(ref_seq, seq): all items in each reference's folder, reviewed or not.

    For the few references that are asked for; ``folder_classes`` answers for all without pairs.
    """
    wanted = references.select("folder", F.col("seq").alias("ref_seq"))
    return wanted.join(items.select("folder", "seq"), "folder").select("ref_seq", "seq")


def approval_selection(items: DataFrame, summary: DataFrame) -> DataFrame:
    """Items of all releases in the most trusted tier group."""
    leads = summary.filter(tier_group("tier") == "A").select(F.col("first_seq").alias("seq"))
    return album_selection(items, items.join(leads, "seq", "left_semi"))


def apply_to_album(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Copy a chosen row's artist, album or year to its album's items to review.

    ``edits`` has ref_seq and the values to set, NULL for no change; the last
    reference wins. Membership follows ``album_members``, but edits are settled
    per folder, release and album first, so each item meets at most three of them.
    """
    fields = [c for c in ("artist", "album", "year") if c in edits.columns]

    def last(name: str, value: Column, ref: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(ref.alias("ref"), value.alias("value")))).alias(name)

    chosen = edits.select(F.col("ref_seq").alias("seq"), *[F.col(c).alias(f"_{c}") for c in fields])
    keys = _membership_keys(items.join(chosen.select("seq"), "seq", "left_semi"))
    settled = (
        keys.join(chosen, "seq")
        .groupBy("kind", "value")
        .agg(*[last(f"_{c}", F.col(f"_{c}"), F.col("seq")) for c in fields])
    )
    reached = _membership_keys(unprocessed(items)).join(settled, ["kind", "value"]).select(
        "seq", *[f"_{c}" for c in fields]
    )
    own = unprocessed(items).select("seq").join(chosen, "seq").select(
        "seq",
        *[
            F.when(F.col(f"_{c}").isNotNull(), F.struct(F.col("seq").alias("ref"), F.col(f"_{c}").alias("value"))).alias(f"_{c}")
            for c in fields
        ],
    )
    changes = reached.unionByName(own).groupBy("seq").agg(*[F.max(f"_{c}").alias(f"_{c}") for c in fields])
    return items.join(changes, "seq", "left").select(
        *[F.coalesce(F.col(f"_{c}.value"), F.col(c)).alias(c) if c in fields else F.col(c) for c in items.columns]
    )


def switch_language(items: DataFrame, members: DataFrame, language: str) -> DataFrame:
    """Names and lyrics of the members (by seq) in another language, with fallbacks.

    ``items`` has title, artist, album and lyrics_text with their variants
    title_i18n, artist_i18n, album_i18n and lyrics.
    """
    from ..functions import language as lang

    chosen = members.select("seq").distinct().withColumn("_switch", F.lit(True))
    joined = items.join(chosen, "seq", "left")
    switch = F.coalesce("_switch", F.lit(False))
    updates = {
        name: F.when(switch, lang.switched_name(name, f"{name}_i18n", language)).otherwise(F.col(name))
        for name in ("title", "artist", "album")
    }
    updates["lyrics_text"] = F.when(
        switch, lang.switched_lyrics("lyrics_text", "lyrics", language)
    ).otherwise(F.col("lyrics_text"))
    return joined.withColumns(updates).select(*items.columns)


def progress_summary(items: DataFrame, elapsed_seconds: ColumnOrName) -> DataFrame:
    """One row: items done of all, elapsed time and expected rest of a run.

    The rest is empty until something is done and half a second has passed.
    """
    from ..functions.values import format_elapsed, format_eta

    elapsed = col(elapsed_seconds)
    done, total = F.col("done"), F.col("total")
    counts = items.agg(F.count("*").alias("total"), F.count_if("is_fetched").alias("done"))
    speed = done / elapsed
    eta = (
        F.when((done == 0) | (elapsed < 0.5), "")
        .when(done >= total, "00:00")
        .otherwise(format_eta((total - done) / speed))
    )
    return counts.select("total", "done", format_elapsed(elapsed).alias("elapsed"), eta.alias("eta"))


def with_first_names(items: DataFrame) -> DataFrame:
    """Items with the best filled variant of each name in place of the current one."""
    return items.withColumns(
        {
            name: first_filled(
                F.col(f"{name}_i18n")["romaji"],
                F.col(f"{name}_i18n")["english"],
                F.col(f"{name}_i18n")["japanese"],
                name,
            )
            for name in ("title", "artist", "album")
        }
    )
