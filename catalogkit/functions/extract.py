"""Values drawn from paths, titles, links and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .columns import ColumnOrName, col, filled, first_filled, leading_int, let

UNKNOWN_ARTIST = "Unknown Artist"
UNKNOWN_ALBUM = "Unknown Album"


def extract_year(value: ColumnOrName) -> Column:
    """First four digits that read as a year from 1900 to 2099, else empty."""
    return F.regexp_extract(col(value), "((?:19|20)[0-9]{2})", 1)


def extract_catalog_no(value: ColumnOrName) -> Column:
    """First bracketed catalogue number, else empty."""
    return F.regexp_extract(
        col(value), r"[\[(]([A-Za-z0-9]{2,12}[-_][A-Za-z0-9~_\-.]{1,16})[\])]", 1
    )


def extract_artist_from_filename(value: ColumnOrName) -> Column:
    """First square-bracketed name that is no catalogue number and no event."""
    names = F.regexp_extract_all(col(value), F.lit(r"\[([^\]]+)\]"), F.lit(1))

    def is_artist(name: Column) -> Column:
        lower = T.ascii_lower(name)
        catalogue = F.contains(name, F.lit("-")) & (F.octet_length(name) <= 10) & name.rlike("[0-9]$")
        event = F.lit(False)
        # Event names, and prefixes of numbered events.
        for word in ["reitaisai", "comic market", "m3"]:
            event = event | F.contains(lower, F.lit(word))
        for prefix in ["c7", "c8", "c9", "c10"]:
            event = event | F.startswith(lower, F.lit(prefix))
        return ~catalogue & ~event

    return F.when(
        F.contains(col(value), F.lit("[")),
        F.coalesce(F.get(F.filter(names, is_artist), 0), F.lit("")),
    ).otherwise(F.when(col(value).isNotNull(), ""))


def extract_uuid(value: ColumnOrName) -> Column:
    """First UUID, else empty."""
    h = "[0-9a-fA-F]"
    return F.regexp_extract(col(value), f"({h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}})", 1)


def extract_discogs_id(value: ColumnOrName) -> Column:
    """STRUCT<id, is_master> of a release or master link."""
    link = col(value)
    return F.struct(
        F.regexp_extract(link, "([0-9]{4,10})", 1).alias("id"),
        (F.contains(link, F.lit("/master/")) | F.contains(link, F.lit("/masters/"))).alias("is_master"),
    )


def extract_discogs_input(value: ColumnOrName) -> Column:
    """STRUCT<id, is_master> of what a user typed, where short ids also count."""
    link = col(value)
    return F.struct(
        F.regexp_extract(link, "([0-9]{3,12})", 1).alias("id"),
        (F.contains(link, F.lit("/master")) | F.startswith(link, F.lit("m"))).alias("is_master"),
    )


def extract_vdb_id(value: ColumnOrName) -> Column:
    """First number of up to eight digits, else 0."""
    return F.coalesce(filled(F.regexp_extract(col(value), "([0-9]{1,8})", 1)).cast("int"), F.lit(0))


def extract_thwiki_id(value: ColumnOrName) -> Column:
    """Album id of a wiki link, a prefixed id or a bare number, else 0."""
    link = col(value)
    patterns = [
        "[?&][ai]=([0-9]{1,10})",
        "(?i)thwiki_([0-9]{1,10})",
        r"^\s*([0-9]{1,10})\s*$",
        "([0-9]{1,10})",
    ]
    found = [filled(F.regexp_extract(link, p, 1)).try_cast("int") for p in patterns]
    return F.coalesce(*found, F.lit(0))


def route_metadata_link(value: ColumnOrName) -> Column:
    """The service that a link or id belongs to."""
    link = T.ascii_lower(value)

    def has(*words: str) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(link, F.lit(word))
        return test

    def starts(*words: str) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.startswith(link, F.lit(word))
        return test

    return (
        F.when(has("touhoudb.com") | starts("touhoudb:", "tdb:"), "touhoudb")
        .when(has("thwiki.cc") | starts("thwiki:", "thbwiki:", "thwiki_"), "thwiki")
        .when(has("vocadb.net") | starts("vocadb:", "vdb:"), "vocadb")
        .when(has("utaitedb.net") | starts("utaitedb:", "udb:"), "utaitedb")
        .when(has("discogs.com") | starts("r", "m"), "discogs")
        .otherwise("musicbrainz")
    )


# Public pages of the catalogues.
WEB_PAGES = {
    "touhoudb_": "https://touhoudb.com/Al/",
    "vocadb_": "https://vocadb.net/Al/",
    "utaitedb_": "https://utaitedb.net/Al/",
    "discogs_": "https://www.discogs.com/release/",
}
DEFAULT_PAGE = "https://musicbrainz.org/release-group/"


def release_web_url(release_id: ColumnOrName) -> Column:
    """Public page of a prefixed release id."""
    rid = col(release_id)
    url = None
    for prefix, page in WEB_PAGES.items():
        hit = F.startswith(rid, F.lit(prefix))
        target = F.concat(F.lit(page), F.substr(rid, F.lit(len(prefix) + 1)))
        url = F.when(hit, target) if url is None else url.when(hit, target)
    return url.otherwise(F.concat(F.lit(DEFAULT_PAGE), rid))


def release_id(service: ColumnOrName, number: ColumnOrName) -> Column:
    """Prefixed release id; MusicBrainz ids stay bare."""
    name = T.ascii_lower(service)
    return F.when(name == "musicbrainz", col(number).cast("string")).otherwise(
        F.concat(name, F.lit("_"), col(number).cast("string"))
    )


def cover_candidate_urls(mbid: ColumnOrName) -> Column:
    """Cover-art addresses to try in turn: release group, then release, by size."""
    return F.array(
        *[
            F.concat(F.lit(f"https://coverartarchive.org/{kind}/"), col(mbid), F.lit(size))
            for size in ["/front", "/front-1200", "/front-500", "/front-250"]
            for kind in ["release-group", "release"]
        ]
    )


def _path_part(path: Column, from_end: int) -> Column:
    """A part counted from the end, empty where there is none."""
    deep = F.concat(F.lit("/" * from_end), T.slashed(path))
    return F.coalesce(F.substring_index(F.substring_index(deep, "/", -from_end), "/", 1), F.lit(""))


def parse_catalog_path(rel_path: ColumnOrName) -> Column:
    """Tags from artist/album/file, for the catalog table."""
    path = col(rel_path)
    is_flac = T.file_extension(path) == ".flac"
    artist, album = _path_part(path, 3), _path_part(path, 2)

    def tags(n: Column) -> Column:
        rest = F.substring(n["after"], F.lit(2), F.length(n["after"]))
        title = T.trim_markup(F.when(n["numbered"], rest).otherwise(n["stem"]))
        return F.struct(
            F.when(artist.isin("", "media", "music"), UNKNOWN_ARTIST).otherwise(artist).alias("artist"),
            F.when(album == "", UNKNOWN_ALBUM).otherwise(album).alias("album"),
            first_filled(title, n["stem"]).alias("title"),
            F.when(n["numbered"], n["before"]).otherwise("").alias("track_no"),
            F.when(is_flac, "FLAC").otherwise("MP3").alias("format"),
            F.when(is_flac, 1411).otherwise(320).alias("bitrate_kbps"),
        )

    return let(T.split_numbered(T.file_stem(path), [". ", "- "], need_digit=True), tags)


def parse_review_path(path: ColumnOrName) -> Column:
    """Tags from the folders and the file name, for review."""
    full = col(path)
    album_folder = _path_part(full, 2)

    def known_artist(name: Column) -> Column:
        from_file = first_filled(extract_artist_from_filename(T.file_name(full)), F.lit(UNKNOWN_ARTIST))
        return F.when(name.isin("", "TO SORT", "media", "music"), from_file).otherwise(name)

    def two_digits(number: Column) -> Column:
        return F.when(F.length(number) == 1, F.concat(F.lit("0"), number)).otherwise(number)

    def tags(n: Column) -> Column:
        number = let(F.regexp_replace(n["before"], "[^0-9]+$", ""), two_digits)
        title = first_filled(F.ltrim(n["after"], F.lit(" \t.-_")), n["after"])
        return F.struct(
            let(T.clean_metadata(_path_part(full, 3)), known_artist).alias("artist"),
            first_filled(T.clean_album_title(album_folder), T.clean_metadata(album_folder)).alias("album"),
            F.when(n["numbered"], title).otherwise(n["stem"]).alias("title"),
            F.when(n["numbered"], number).otherwise("01").alias("track_no"),
            extract_year(full).alias("year"),
        )

    return let(T.split_numbered(T.file_stem(full), [". ", "- ", "_"], need_digit=True), tags)


def parse_mirror_path(path: ColumnOrName) -> Column:
    """Tags from the folders as they stand, for retagging mirrored files."""
    full = col(path)

    def tags(n: Column) -> Column:
        rest = F.substring(n["after"], F.lit(2), F.length(n["after"]))
        return F.struct(
            _path_part(full, 3).alias("artist"),
            _path_part(full, 2).alias("album"),
            F.when(n["numbered"], rest).otherwise(n["stem"]).alias("title"),
            F.when(n["numbered"], n["before"]).otherwise("").alias("track_no"),
        )

    return let(T.split_numbered(T.file_stem(full), [". "], need_digit=False), tags)


def leading_track_no(filename: ColumnOrName) -> Column:
    """Number before the first separator of a file name, else 0."""
    head = F.regexp_extract(col(filename), r"(?s)^([^._ \-]+)[._ \-]", 1)
    return F.when(F.octet_length(head).between(1, 3), F.coalesce(leading_int(head), F.lit(0))).otherwise(0)


def match_stem(filename: ColumnOrName) -> Column:
    """Key of a file name for track matching, without number and extension."""
    bare = F.regexp_replace(col(filename), r"^[0-9. _\-]{1,5}([^0-9. _\-])", "$1")
    return T.normalize_key(F.regexp_replace(bare, r"\.[^.]*$", ""))
