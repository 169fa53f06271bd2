"""Captured replies of the metadata services, and what they say.

Each parser takes the body column and gives a typed column, so a table of
replies is parsed in one projection. Broken or foreign bodies give empty values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text, values
from ..functions.columns import ColumnOrName, col, first_filled, leading_int, let



def read_responses(spark: SparkSession, path: str, service: str | None = None) -> DataFrame:
    """Captured replies as JSON lines, optionally of one service."""
    rows = spark.read.schema(schemas.RESPONSES).json(path)
    return rows.filter(F.col("service") == service) if service else rows


def _first_of_each(replies: DataFrame) -> DataFrame:
    rank = F.struct("request_id", "body") if "request_id" in replies.columns else F.col("body")
    return replies.groupBy("url").agg(F.min_by("body", rank).alias("body"))


def store_replies(replies: DataFrame, table: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """The reply that counts for each address, written once as a table in buckets by address.

    Searches meet such a store without shuffling or sorting it again, however many rounds of them
    there are: pass it on with ``stored=True``. ``buckets`` is the session's number of shuffle partitions
    unless given; ``path`` keeps the files outside the warehouse.
    """
    spark = replies.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = _first_of_each(replies.filter(F.col("url").isNotNull())).repartition(n, "url")
    writer = picked.write.format("parquet").mode("overwrite").bucketBy(n, "url").sortBy("url")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def answers(
    asked: DataFrame, replies: DataFrame, parse: Callable[[str], Column] | None = None, stored: bool = False
) -> DataFrame:
    """One reply for each address in ``asked`` (url): url and ``body``, or what ``parse`` makes of it.

    Only replies to those addresses are compared and parsed. Of several to one address the
    first by request_id counts (by body where there is none). ``stored`` says that ``replies``
    comes from ``store_replies``.
    """
    wanted = asked.select("url").filter(F.col("url").isNotNull()).distinct()
    met = replies.select("url", "body") if stored else replies
    met = met.join(wanted, "url", "left_semi")
    picked = met if stored else _first_of_each(met)
    return picked if parse is None else picked.select("url", parse("body").alias("body"))


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: of several the one with the lowest hash of all its columns."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row"))
    return picked.select(key, "_row.*")


def empty_array(ddl: str) -> Column:
    """An empty array of the given type."""
    return F.array().cast(ddl)


def some(array: Column, ddl: str) -> Column:
    """The array, or an empty one for NULL."""
    return F.coalesce(array, empty_array(ddl))


def _nt(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _i18n(romaji: Column, english: Column, japanese: Column) -> Column:
    return F.struct(_nt(romaji).alias("romaji"), _nt(english).alias("english"), _nt(japanese).alias("japanese"))


def _lyrics(original: Column, romaji: Column, english: Column) -> Column:
    return F.struct(_nt(original).alias("original"), _nt(romaji).alias("romaji"), _nt(english).alias("english"))


def _nothing() -> Column:
    return F.lit("")


def _no_i18n() -> Column:
    return _i18n(_nothing(), _nothing(), _nothing())


def _track(position: Column, title: Column, artist: Column, length_ms: Column, **more: Column) -> Column:
    return F.struct(
        position.cast("int").alias("position"),
        _nt(title).alias("title"),
        more.get("title_i18n", _no_i18n()).alias("title_i18n"),
        _nt(artist).alias("artist"),
        more.get("artist_i18n", _no_i18n()).alias("artist_i18n"),
        F.coalesce(length_ms.cast("int"), F.lit(0)).alias("length_ms"),
        more.get("lyrics", _lyrics(_nothing(), _nothing(), _nothing())).alias("lyrics"),
    )


TRACKS_DDL = f"array<{schemas.TRACK}>"

_ACOUSTID = (
    "status STRING, results ARRAY<STRUCT<score: DOUBLE, recordings: ARRAY<STRUCT<id: STRING, title: STRING, "
    "artists: ARRAY<STRUCT<name: STRING>>, releasegroups: ARRAY<STRUCT<id: STRING>>>>>>"
)
ACOUSTID_ROWS = (
    "array<struct<recording_id: string, title: string, artists: array<string>, "
    "release_group_ids: array<string>, score: double>>"
)


def parse_acoustid(body: ColumnOrName) -> Column:
    """Recordings of a fingerprint lookup, in order."""

    def build(doc: Column) -> Column:
        def names(rec: Column, field: str, part: str) -> Column:
            return F.filter(
                some(F.transform(rec[field], lambda x: _nt(x[part])), "array<string>"), lambda v: v != ""
            )

        def recordings(result: Column) -> Column:
            found = F.transform(
                result["recordings"],
                lambda rec: F.struct(
                    _nt(rec["id"]).alias("recording_id"),
                    _nt(rec["title"]).alias("title"),
                    names(rec, "artists", "name").alias("artists"),
                    names(rec, "releasegroups", "id").alias("release_group_ids"),
                    F.coalesce(result["score"], F.lit(0.0)).alias("score"),
                ),
            )
            return some(found, ACOUSTID_ROWS)

        rows = F.flatten(F.transform(doc["results"], recordings))
        return F.when(doc["status"] == "ok", some(rows, ACOUSTID_ROWS)).otherwise(empty_array(ACOUSTID_ROWS))

    return let(F.from_json(col(body), _ACOUSTID), build)


_MB_GROUPS = (
    "`release-groups` ARRAY<STRUCT<id: STRING, score: INT, title: STRING, `first-release-date`: STRING, "
    "`artist-credit`: ARRAY<STRUCT<name: STRING>>>>"
)
GROUP_ROWS = "array<struct<id: string, title: string, date: string, artist: string, score: int>>"


def parse_musicbrainz_groups(body: ColumnOrName) -> Column:
    """Release groups of a search, in order; ids of another shape are left out."""
    groups = F.from_json(col(body), _MB_GROUPS)["release-groups"]

    def row(g: Column) -> Column:
        names = F.filter(F.transform(g["artist-credit"], lambda a: a["name"]), lambda n: n != "")
        return F.struct(
            _nt(g["id"]).alias("id"),
            _nt(g["title"]).alias("title"),
            _nt(g["first-release-date"]).alias("date"),
            _nt(F.array_join(names, ", ")).alias("artist"),
            F.coalesce(g["score"], F.lit(0)).alias("score"),
        )

    return some(F.filter(F.transform(groups, row), lambda g: F.length(g["id"]) == 36), GROUP_ROWS)


_MB_TRACK = (
    "STRUCT<position: INT, title: STRING, length: BIGINT, "
    "`artist-credit`: ARRAY<STRUCT<name: STRING, joinphrase: STRING>>, recording: STRUCT<id: STRING, "
    "title: STRING, length: BIGINT, `artist-credit`: ARRAY<STRUCT<name: STRING>>>>"
)
_MB_MEDIA = f"media: ARRAY<STRUCT<tracks: ARRAY<{_MB_TRACK}>>>"
_MB_RELEASES = f"releases ARRAY<STRUCT<id: STRING, status: STRING, date: STRING, {_MB_MEDIA}>>"


def parse_musicbrainz_releases(body: ColumnOrName) -> Column:
    """STRUCT<release_date, tracks> of a release group's releases.

    Tracks come from the first pseudo-release that has any, else the first
    official release that has any, else the first release.
    """

    def build(releases: Column) -> Column:
        def tracks_of(release: Column) -> Column:
            def row(t: Column) -> Column:
                rec = t["recording"]
                own, recorded = t["artist-credit"], rec["artist-credit"]
                return _track(
                    F.coalesce(t["position"], F.lit(0)),
                    first_filled(t["title"], rec["title"]),
                    F.when(F.size(own) > 0, F.get(own, 0)["name"]).otherwise(F.get(recorded, 0)["name"]),
                    F.coalesce(F.nullif(t["length"], F.lit(0)), rec["length"]),
                )

            media = F.filter(F.transform(release["media"], lambda m: m["tracks"]), lambda t: t.isNotNull())
            rows = F.transform(F.flatten(media), row)
            return some(F.filter(rows, lambda t: (t["position"] > 0) & (t["title"] != "")), TRACKS_DDL)

        def first_with_tracks(status: str) -> Column:
            lists = F.transform(F.filter(releases, lambda r: r["status"] == status), tracks_of)
            return F.get(F.filter(lists, lambda t: F.size(t) > 0), 0)

        dates = F.filter(F.transform(releases, lambda r: r["date"]), lambda d: d != "")
        return F.struct(
            _nt(F.array_min(dates)).alias("release_date"),
            some(
                F.coalesce(
                    first_with_tracks("Pseudo-Release"),
                    first_with_tracks("Official"),
                    tracks_of(F.get(releases, 0)),
                ),
                TRACKS_DDL,
            ).alias("tracks"),
        )

    return let(F.from_json(col(body), _MB_RELEASES)["releases"], build)


_MB_RELEASE = (
    "id STRING, title STRING, date STRING, `artist-credit` ARRAY<STRUCT<name: STRING, joinphrase: STRING>>, "
    f"`release-group` STRUCT<id: STRING>, {_MB_MEDIA.replace(':', ' ', 1)}"
)


def parse_musicbrainz_release(body: ColumnOrName, group_id: ColumnOrName | None = None) -> Column:
    """STRUCT<release_id, title, release_date, artist, tracks> of one release."""

    def build(doc: Column) -> Column:
        def credit(names: Column) -> Column:
            return _nt(F.array_join(F.transform(names, lambda c: F.concat(_nt(c["name"]), _nt(c["joinphrase"]))), ""))

        artist = first_filled(credit(doc["artist-credit"]), F.lit("Unknown Artist"))
        lists = F.filter(F.transform(doc["media"], lambda m: m["tracks"]), lambda t: t.isNotNull())
        tracks = F.transform(
            F.flatten(lists),
            lambda t, i: _track(
                F.when(t["position"] > 0, t["position"]).otherwise(i + 1),
                first_filled(t["title"], t["recording"]["title"]),
                first_filled(credit(t["artist-credit"]), artist),
                F.lit(0),
            ),
        )
        known = [col(group_id)] if group_id is not None else []
        return F.struct(
            first_filled(*known, doc["release-group"]["id"], doc["id"]).alias("release_id"),
            _nt(doc["title"]).alias("title"),
            _nt(doc["date"]).alias("release_date"),
            artist.alias("artist"),
            some(tracks, TRACKS_DDL).alias("tracks"),
        )

    return let(F.from_json(col(body), _MB_RELEASE), build)


def parse_recording_groups(body: ColumnOrName) -> Column:
    """First release-group id of a recording, or empty."""
    ids = F.transform(
        F.from_json(col(body), "`release-groups` ARRAY<STRUCT<id: STRING>>")["release-groups"], lambda g: g["id"]
    )
    return _nt(F.get(F.filter(ids, lambda i: F.length(i) == 36), 0))


_DISCOGS = (
    "id BIGINT, title STRING, released STRING, released_formatted STRING, year STRING, master_id BIGINT, "
    "artists ARRAY<STRUCT<name: STRING>>, images ARRAY<STRUCT<type: STRING, uri: STRING, resource_url: STRING>>, "
    "tracklist ARRAY<STRUCT<position: STRING, type_: STRING, title: STRING, duration: STRING, "
    "artists: ARRAY<STRUCT<name: STRING>>>>"
)


def parse_discogs_release(body: ColumnOrName) -> Column:
    """STRUCT<title, release_date, master_id, artist, cover_url, tracks> of a release or master."""

    def build(doc: Column) -> Column:
        names = F.transform(
            doc["artists"], lambda a: F.regexp_replace(_nt(a["name"]), r"(?s)^(.*) \([0-9]+\)$", "$1")
        )
        credited = _nt(F.array_join(names, ", "))
        addressed = F.filter(
            F.transform(
                doc["images"],
                lambda i: F.struct(
                    (i["type"] == "primary").alias("primary"), first_filled(i["uri"], i["resource_url"]).alias("uri")
                ),
            ),
            lambda i: i["uri"] != "",
        )
        cover = F.coalesce(
            F.get(F.filter(addressed, lambda i: i["primary"]), 0)["uri"], F.get(addressed, 0)["uri"], F.lit("")
        )
        counted = F.filter(doc["tracklist"], lambda t: F.coalesce(t["type_"], F.lit("")).isin("", "track"))

        def row(t: Column, i: Column, artist: Column) -> Column:
            guest = F.regexp_replace(_nt(F.get(t["artists"], 0)["name"]), r"(?s)^(.*) \((?:(?! \().)+\)$", "$1")
            return _track(
                values.parse_position(_nt(t["position"]), i + 1),
                t["title"],
                first_filled(guest, artist),
                values.parse_duration_ms(_nt(t["duration"])),
            )

        def tracks(artist: Column) -> Column:
            rows = F.transform(counted, lambda t, i: row(t, i, artist))
            return some(F.filter(rows, lambda t: t["title"] != ""), TRACKS_DDL)

        year = doc["year"].try_cast("int")
        return F.struct(
            _nt(doc["title"]).alias("title"),
            first_filled(
                doc["released"],
                doc["released_formatted"],
                F.when(year.isNull(), doc["year"]).when(year > 0, doc["year"]),
            ).alias("release_date"),
            F.coalesce(doc["master_id"], F.lit(0)).alias("master_id"),
            credited.alias("artist"),
            cover.alias("cover_url"),
            let(credited, tracks).alias("tracks"),
        )

    return let(F.from_json(col(body), _DISCOGS), build)


def with_master_year(releases: DataFrame, masters: DataFrame) -> DataFrame:
    """Releases without a date take the year of their master record.

    Both hold ``master_id``; ``masters`` also ``master_year`` as text.
    """
    known = masters.filter(F.col("master_year").try_cast("int") > 0).groupBy("master_id").agg(
        F.min("master_year").alias("master_year")
    )
    dated = releases.join(known, "master_id", "left")
    missing = F.col("release_date").isin("", "0") & F.col("master_year").isNotNull()
    return dated.withColumn(
        "release_date", F.when(missing, F.col("master_year")).otherwise(F.col("release_date"))
    ).drop("master_year")


_NAMES = "ARRAY<STRUCT<language: STRING, value: STRING>>"
_VDB_LYRICS = (
    "ARRAY<STRUCT<translationType: STRING, cultureCode: STRING, cultureCodes: ARRAY<STRING>, value: STRING>>"
)
_VDB_ALBUM = (
    "id INT, name STRING, defaultName STRING, catalogNumber STRING, "
    f"names {_NAMES}, releaseDate STRUCT<year: INT, month: INT, day: INT, isEmpty: BOOLEAN>, artistString STRING, "
    "artists ARRAY<STRUCT<categories: STRING, roles: STRING, name: STRING, "
    f"artist: STRUCT<name: STRING, artistType: STRING, names: {_NAMES}>>>, "
    "mainPicture STRUCT<urlOriginal: STRING, urlThumb: STRING, urlSmallThumb: STRING>, "
    "tracks ARRAY<STRUCT<trackNumber: INT, name: STRING, song: STRUCT<name: STRING, defaultName: STRING, "
    f"names: {_NAMES}, lengthSeconds: INT, artistString: STRING, lyrics: {_VDB_LYRICS}>>>"
)


def _named(names: Column, language: str) -> Column:
    hits = F.filter(names, lambda n: (n["language"] == language) & (n["value"] != ""))
    return _nt(F.get(hits, 0)["value"])


def _vdb_lyrics(entries: Column) -> Column:
    """STRUCT<original, romaji, english>; the last English or unmarked translation wins."""

    def first(kind: str) -> Column:
        hits = F.filter(entries, lambda e: (e["translationType"] == kind) & (e["value"] != ""))
        return _nt(F.get(hits, 0)["value"])

    translations = some(
        F.transform(
            F.filter(entries, lambda e: e["translationType"] == "Translation"),
            lambda e: F.struct(
                first_filled(e["cultureCode"], F.get(e["cultureCodes"], 0)).alias("culture"),
                _nt(e["value"]).alias("value"),
            ),
        ),
        "array<struct<culture: string, value: string>>",
    )
    english = F.aggregate(
        translations,
        F.lit(""),
        lambda kept, t: F.when(t["culture"].isin("en", "") | (kept == ""), t["value"]).otherwise(kept),
    )
    return _lyrics(first("Original"), first("Romanized"), english)


def _three_names(names: Column) -> Column:
    return F.struct(
        _named(names, "Romaji").alias("romaji"),
        _named(names, "English").alias("english"),
        _named(names, "Japanese").alias("japanese"),
    )


def _vdb_names(doc: Column) -> Column:
    """STRUCT<raw, title, title_i18n> of an album."""

    def build(raw: Column) -> Column:
        def whole(n: Column) -> Column:
            romaji, japanese = first_filled(n["romaji"], raw), first_filled(n["japanese"], doc["defaultName"])
            return F.struct(
                first_filled(romaji, n["english"], japanese, raw).alias("title"),
                _i18n(romaji, n["english"], japanese).alias("title_i18n"),
            )

        return let(_three_names(doc["names"]), whole)

    return let(first_filled(doc["name"], doc["defaultName"]), build)


def _vdb_artist(doc: Column) -> Column:
    """STRUCT<artist, artist_i18n>: a circle, else the credit unless it says various, else a producer."""
    rows = F.transform(
        doc["artists"],
        lambda a: F.struct(
            first_filled(a["name"], a["artist"]["name"]).alias("name"),
            (
                F.contains(_nt(a["categories"]), F.lit("Circle"))
                | F.contains(_nt(a["roles"]), F.lit("Circle"))
                | (_nt(a["artist"]["artistType"]) == "Circle")
            ).alias("circle"),
            (
                F.contains(_nt(a["categories"]), F.lit("Producer"))
                | (_nt(a["artist"]["artistType"]) == "Producer")
            ).alias("producer"),
        ),
    )
    all_names = F.flatten(
        F.filter(F.transform(doc["artists"], lambda a: a["artist"]["names"]), lambda n: n.isNotNull())
    )
    credited = _nt(doc["artistString"])
    various = credited.isin("Various artists", "Various Artists", "V.A.")

    def raw(artists: Column) -> Column:
        circle = F.get(F.filter(artists, lambda a: a["circle"] & (a["name"] != "")), 0)["name"]
        producer = F.get(F.filter(artists, lambda a: ~a["circle"] & a["producer"] & (a["name"] != "")), 0)["name"]
        return first_filled(circle, F.when(~various, credited), producer, credited)

    def whole(v: Column) -> Column:
        n = v["names"]
        romaji = first_filled(n["romaji"], v["raw"])
        return F.struct(
            first_filled(romaji, n["english"], n["japanese"], v["raw"]).alias("artist"),
            _i18n(romaji, n["english"], n["japanese"]).alias("artist_i18n"),
        )

    return let(F.struct(let(rows, raw).alias("raw"), _three_names(all_names).alias("names")), whole)


def _vdb_track(t: Column, i: Column, artist: Column) -> Column:
    song = t["song"]

    def whole(v: Column) -> Column:
        n = v["names"]
        romaji, japanese = first_filled(n["romaji"], v["plain"]), first_filled(n["japanese"], song["defaultName"])
        return _track(
            F.when(t["trackNumber"] > 0, t["trackNumber"]).otherwise(i + 1),
            first_filled(romaji, n["english"], japanese, v["plain"]),
            first_filled(song["artistString"], artist["artist"]),
            F.coalesce(song["lengthSeconds"], F.lit(0)) * 1000,
            title_i18n=_i18n(romaji, n["english"], japanese),
            artist_i18n=artist["artist_i18n"],
            lyrics=_vdb_lyrics(song["lyrics"]),
        )

    plain = first_filled(t["name"], song["name"])
    return let(F.struct(plain.alias("plain"), _three_names(song["names"]).alias("names")), whole)


def parse_vdb_album(body: ColumnOrName) -> Column:
    """STRUCT of a VocaDB-style album: names, artist, date, cover and tracks."""

    def build(doc: Column) -> Column:
        date, picture = doc["releaseDate"], doc["mainPicture"]

        def whole(v: Column) -> Column:
            rows = F.transform(doc["tracks"], lambda t, i: _vdb_track(t, i, v["by"]))
            return F.struct(
                v["named"]["title"].alias("title"),
                v["named"]["title_i18n"].alias("title_i18n"),
                v["by"]["artist"].alias("artist"),
                v["by"]["artist_i18n"].alias("artist_i18n"),
                _nt(doc["catalogNumber"]).alias("catalog_no"),
                F.when(F.coalesce(date["isEmpty"], F.lit(False)), "")
                .otherwise(values.format_release_date(date["year"], date["month"], date["day"]))
                .alias("release_date"),
                first_filled(picture["urlOriginal"], picture["urlThumb"], picture["urlSmallThumb"]).alias("cover_url"),
                some(F.filter(rows, lambda t: t["title"] != ""), TRACKS_DDL).alias("tracks"),
            )

        return let(F.struct(_vdb_names(doc).alias("named"), _vdb_artist(doc).alias("by")), whole)

    return let(F.from_json(col(body), _VDB_ALBUM), build)


def parse_vdb_song_lyrics(body: ColumnOrName) -> Column:
    """STRUCT<original, romaji, english> of one song."""
    return _vdb_lyrics(F.from_json(col(body), f"lyrics {_VDB_LYRICS}")["lyrics"])


def parse_vdb_lyrics_search(body: ColumnOrName) -> Column:
    """Lyrics of the first found song that has any."""
    items = F.from_json(col(body), f"items ARRAY<STRUCT<lyrics: {_VDB_LYRICS}>>")["items"]
    found = F.filter(
        F.transform(items, lambda i: _vdb_lyrics(i["lyrics"])),
        lambda l: (l["original"] != "") | (l["romaji"] != "") | (l["english"] != ""),
    )
    return F.coalesce(F.get(found, 0), _lyrics(_nothing(), _nothing(), _nothing()))


VDB_ROWS = "array<struct<id: int, title: string, catalog_no: string, artist: string>>"


def parse_vdb_search(body: ColumnOrName) -> Column:
    """Albums of a VocaDB-style search, in order."""
    items = F.from_json(
        col(body), "items ARRAY<STRUCT<id: INT, name: STRING, catalogNumber: STRING, artistString: STRING>>"
    )["items"]
    rows = F.transform(
        items,
        lambda i: F.struct(
            F.coalesce(i["id"], F.lit(0)).alias("id"),
            _nt(i["name"]).alias("title"),
            _nt(i["catalogNumber"]).alias("catalog_no"),
            _nt(i["artistString"]).alias("artist"),
        ),
    )
    return some(rows, VDB_ROWS)


DISCOGS_ROWS = (
    "array<struct<id: string, title: string, year: string, cover_url: string, is_master: boolean, "
    "descriptions: array<string>, have: double, want: double>>"
)


def parse_discogs_search(body: ColumnOrName) -> Column:
    """Releases of a Discogs search, in order."""
    results = F.from_json(
        col(body),
        "results ARRAY<STRUCT<id: STRING, title: STRING, year: STRING, cover_image: STRING, type: STRING, "
        "formats: ARRAY<STRUCT<descriptions: ARRAY<STRING>>>, community: STRUCT<have: DOUBLE, want: DOUBLE>>>",
    )["results"]
    rows = F.transform(
        results,
        lambda r: F.struct(
            _nt(r["id"]).alias("id"),
            _nt(r["title"]).alias("title"),
            _nt(r["year"]).alias("year"),
            _nt(r["cover_image"]).alias("cover_url"),
            (_nt(r["type"]) == "master").alias("is_master"),
            some(
                F.flatten(
                    F.filter(F.transform(r["formats"], lambda f: f["descriptions"]), lambda d: d.isNotNull())
                ),
                "array<string>",
            ).alias("descriptions"),
            F.coalesce(r["community"]["have"], F.lit(0.0)).alias("have"),
            F.coalesce(r["community"]["want"], F.lit(0.0)).alias("want"),
        ),
    )
    return some(F.filter(rows, lambda r: r["id"] != ""), DISCOGS_ROWS)


def _variants(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _scalar_text(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double").cast("bigint").cast("string")
    return _nt(
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(
            kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"), number
        )
    )


def _property_text(value: Column) -> Column:
    parts = F.filter(F.transform(_variants(value), _scalar_text), lambda v: v != "")
    return F.coalesce(F.array_join(parts, ", "), _scalar_text(value))


def _pairs(entry: Column) -> Column:
    """ARRAY<STRUCT<key, text>> of the pairs that have a value, the last first; each is read once for all keys."""

    def pair(p: Column) -> Column:
        value = F.try_variant_get(p, "$[1]", "variant")
        return F.struct(
            F.try_variant_get(p, "$[0]", "string").alias("key"),
            let(value, lambda v: F.when(v.isNotNull(), _property_text(v))).alias("text"),
        )

    return F.reverse(F.filter(F.transform(_variants(entry), pair), lambda p: p["text"].isNotNull()))


def _property(pairs: Column, key: str) -> Column:
    """Text of the last pair with the key, or empty."""
    return _nt(F.get(F.filter(pairs, lambda p: p["key"] == key), 0)["text"])


THWIKI_ROWS = "array<struct<id: int, title: string, artist: string>>"


def parse_thwiki_search(body: ColumnOrName) -> Column:
    """Albums of a wiki search, in order; entries are [id, title, circle]."""
    rows = F.transform(
        _variants(F.try_parse_json(col(body))),
        lambda e: F.struct(
            F.coalesce(F.try_variant_get(e, "$[0]", "int"), F.lit(0)).alias("id"),
            _nt(F.try_variant_get(e, "$[1]", "string")).alias("title"),
            _nt(F.try_variant_get(e, "$[2]", "string")).alias("artist"),
        ),
    )
    return some(F.filter(rows, lambda r: (r["id"] > 0) & (r["title"] != "")), THWIKI_ROWS)


def parse_thwiki_album(body: ColumnOrName) -> Column:
    """STRUCT<title, artist, release_date, event, cover_url, tracks> of a wiki album."""

    def facts(album: Column) -> Column:
        names = {"title": "alname", "artist": "circle", "release_date": "date", "event": "event", "cover_url": "coverurl"}
        return F.struct(*[_property(album, key).alias(name) for name, key in names.items()])

    def track_facts(pairs: Column) -> Column:
        keys = ("name", "trackno", "artist", "vocal", "arrange", "time", "lrc")
        return F.struct(*[_property(pairs, key).alias(key) for key in keys])

    def row(t: Column, i: Column, circle: Column) -> Column:
        artist = first_filled(t["artist"], t["vocal"], t["arrange"], circle)
        return _track(
            F.coalesce(leading_int(t["trackno"]), i + 1),
            t["name"],
            artist,
            F.coalesce(leading_int(t["time"]), F.lit(0)) * 1000,
            title_i18n=_i18n(_nothing(), _nothing(), t["name"]),
            artist_i18n=_i18n(_nothing(), _nothing(), artist),
            lyrics=_lyrics(t["lrc"], _nothing(), _nothing()),
        )

    def build(doc: Column) -> Column:
        whole = F.size(_variants(doc)) >= 2
        album = _pairs(F.when(whole, F.try_variant_get(doc, "$[0]", "variant")))
        listed = F.when(whole, F.try_variant_get(doc, "$[1]", "array<variant>"))
        named = F.transform(listed, lambda entry: let(_pairs(entry), track_facts))

        def release(head: Column) -> Column:
            tracks = F.transform(named, lambda t, i: row(t, i, head["artist"]))
            kept = F.filter(tracks, lambda t: t["title"] != "")
            return F.struct(
                *[head[n].alias(n) for n in ("title", "artist", "release_date", "event", "cover_url")],
                some(kept, TRACKS_DDL).alias("tracks"),
            )

        return let(let(album, facts), release)

    return let(F.try_parse_json(col(body)), build)


def parse_lrclib(body: ColumnOrName) -> Column:
    """Synced lyrics, else plain ones, else empty."""

    def build(doc: Column) -> Column:
        return first_filled(
            F.nullif(doc["syncedLyrics"], F.lit("null")), F.nullif(doc["plainLyrics"], F.lit("null"))
        )

    return let(F.from_json(col(body), "syncedLyrics STRING, plainLyrics STRING"), build)


_QQ_SEARCH = (
    "data STRUCT<song: STRUCT<list: ARRAY<STRUCT<songmid: STRING, songname: STRING, "
    "singer: ARRAY<STRUCT<name: STRING>>>>>>"
)


def parse_qq_search(body: ColumnOrName, artist: ColumnOrName, title: ColumnOrName) -> Column:
    """Id of the song that best fits artist and title; the first one wins ties."""
    wanted_artist = text.normalize_key(artist)
    wanted_title = text.normalize_key(title)
    songs = F.from_json(col(body), _QQ_SEARCH)["data"]["song"]["list"]

    def row(s: Column) -> Column:
        singers = F.array_join(F.transform(s["singer"], lambda x: _nt(x["name"])), " ")
        name_fits = (wanted_title != "") & F.contains(text.normalize_key(_nt(s["songname"])), wanted_title)
        artist_fits = (wanted_artist != "") & F.contains(text.normalize_key(_nt(singers)), wanted_artist)
        return F.struct(
            (F.when(name_fits, 50).otherwise(0) + F.when(artist_fits, 50).otherwise(0)).alias("score"),
            _nt(s["songmid"]).alias("id"),
        )

    rows = F.filter(F.transform(songs, row), lambda r: r["id"] != "")
    ranked = F.transform(rows, lambda r, i: F.struct(r["score"].alias("score"), (-i).alias("rank"), r["id"].alias("id")))
    return _nt(F.array_max(ranked)["id"])


def parse_qq_lyric(body: ColumnOrName) -> Column:
    """Decoded lyrics of a QQ Music reply, or empty."""
    coded = F.from_json(col(body), "lyric STRING")["lyric"]
    return F.when(_nt(coded) == "", "").otherwise(text.unescape_html(text.decode_base64_text(coded)))
