"""Album clusters, membership, summaries, review state, language and covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.operators import albums, covers
from catalogkit.session import written, written_by

from . import views
from .registry import Registry
from .views import key_sql

query = Registry()

_EMPTY = "('', 'unknown', 'tosort', 'music', 'media')"
_ALBUM_KEY = f"CASE WHEN {key_sql('album')} IN {_EMPTY} THEN {key_sql('folder')} ELSE {key_sql('album')} END"
_KEYED = views.ITEMS_SQL + f""",
keyed AS (SELECT *, {_ALBUM_KEY} AS album_key, CASE WHEN {key_sql('album')} IN {_EMPTY} THEN NULL ELSE {key_sql('album')} END AS title_key FROM items)"""
_SUMMARY = _KEYED + """,
open_items AS (SELECT * FROM keyed WHERE NOT is_processed),
summary AS (SELECT album_key, count(*) AS files, min(seq) AS first_seq,
  coalesce(arg_min(artist, seq) FILTER (artist NOT IN ('', 'Unknown Artist')), arg_max(artist, seq)) AS artist,
  coalesce(arg_min(album, seq) FILTER (album <> ''), '') AS album,
  coalesce(arg_min(release_id, seq) FILTER (release_id <> ''), '') AS release_id,
  coalesce(arg_min(tier, seq) FILTER (release_id <> ''), arg_min(tier, seq)) AS tier,
  coalesce(arg_min(year, seq) FILTER (year <> ''), '') AS release_date, bool_or(is_fetched) AS fetched
  FROM open_items GROUP BY album_key),
grouped AS (SELECT *, CASE WHEN tier IN ('AcoustId', 'TierA') THEN 'A' WHEN tier LIKE 'TierB%' THEN 'B' WHEN tier = 'Niche_Local' THEN 'Niche' ELSE tier END AS tier_group FROM summary)"""


def _items(spark, sf_dir):
    return albums.with_album_key(views.items(spark, sf_dir))


# What membership and edits read of an item.
_READ = ("seq", "folder", "artist", "album", "title", "year", "release_id", "tier", "is_processed", "is_fetched", "album_key")


def _written_items(spark, sf_dir):
    """Items for queries that read them several times: made and keyed once."""
    return written(_items(spark, sf_dir).select(*_READ))


def _items_by_seq(spark, sf_dir):
    """``_written_items`` for edits, which meet them by ``seq`` again and again."""
    return written_by(_items(spark, sf_dir).select(*_READ), "seq")


@query(f"WITH {_KEYED} SELECT album_key, count(*) AS tracks, min(seq) AS lead_seq, max(seq) AS last_seq, arg_min(title, seq) AS lead_title FROM keyed GROUP BY album_key")
def album_clusters(spark, sf_dir):
    return albums.cluster_albums(_items(spark, sf_dir)).select(
        "album_key", "tracks", "lead_seq", "last_seq", F.col("lead.title").alias("lead_title")
    )


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def release_summary(spark, sf_dir):
    return albums.release_summary(_items(spark, sf_dir))


@query(f"WITH {_SUMMARY} SELECT tier_group, count(*) AS releases, sum(files)::BIGINT AS files FROM grouped GROUP BY tier_group")
def tier_rollup(spark, sf_dir):
    return albums.tier_rollup(albums.release_summary(_items(spark, sf_dir)))


@query(f"WITH {_SUMMARY} SELECT album_key, files, tier FROM summary WHERE tier IN ('AcoustId', 'TierA') AND (contains(lower(artist), '0') OR contains(lower(album), '0') OR contains(lower(release_id), '0'))")
def filter_summary(spark, sf_dir):
    summary = albums.release_summary(_items(spark, sf_dir))
    return albums.filter_summary(summary, tier=1, search="0").select("album_key", "files", "tier")


@query(f"""
WITH {_SUMMARY}, refs AS (SELECT k.* FROM keyed k JOIN summary s ON k.seq = s.first_seq AND s.files > 1)
SELECT DISTINCT r.seq AS ref_seq, i.seq FROM refs r JOIN open_items i ON i.folder = r.folder
UNION SELECT r.seq, i.seq FROM refs r JOIN open_items i ON r.release_id <> '' AND i.release_id = r.release_id
UNION SELECT r.seq, i.seq FROM refs r JOIN open_items i ON r.title_key IS NOT NULL AND i.title_key = r.title_key
""")
def album_members(spark, sf_dir):
    items = _written_items(spark, sf_dir)
    leads = albums.release_summary(items).filter("files > 1").select(F.col("first_seq").alias("seq"))
    return albums.album_members(items, items.join(leads, "seq", "left_semi"))


@query(f"""
WITH {_SUMMARY}, refs AS (SELECT k.* FROM keyed k JOIN grouped s ON k.seq = s.first_seq AND s.tier_group = 'A')
SELECT seq FROM open_items i WHERE EXISTS (SELECT 1 FROM refs r WHERE r.folder = i.folder)
  OR EXISTS (SELECT 1 FROM refs r WHERE r.release_id <> '' AND r.release_id = i.release_id)
  OR EXISTS (SELECT 1 FROM refs r WHERE r.title_key = i.title_key)
""")
def approval_selection(spark, sf_dir):
    items = _items(spark, sf_dir)
    return albums.approval_selection(items, albums.release_summary(items)).select("seq")


@query(f"""
WITH {_KEYED}, refs AS (SELECT min(seq) AS ref_seq, folder FROM keyed GROUP BY folder)
SELECT ref_seq, seq FROM refs JOIN keyed USING (folder)
""")
def folder_members(spark, sf_dir):
    items = _items(spark, sf_dir)
    refs = items.groupBy("folder").agg(F.min("seq").alias("seq"))
    return albums.folder_members(items, refs)


@query(f"""
WITH {_KEYED}, c AS (SELECT seq, is_processed, 'folder' AS kind, folder AS value FROM keyed WHERE folder <> ''
  UNION ALL SELECT seq, is_processed, 'release', release_id FROM keyed WHERE release_id <> ''
  UNION ALL SELECT seq, is_processed, 'album', title_key FROM keyed WHERE title_key IS NOT NULL
  UNION ALL SELECT seq, is_processed, 'item', seq::VARCHAR FROM keyed WHERE NOT is_processed)
SELECT 'reference' AS role, kind, value, seq FROM c UNION ALL SELECT 'member', kind, value, seq FROM c WHERE NOT is_processed
""")
def album_classes(spark, sf_dir):
    """Every item is a reference: its album by classes, where pairs would be many times the items."""
    items = _written_items(spark, sf_dir)
    return albums.album_classes(items, items)


@query(f"WITH {_KEYED} SELECT 'reference' AS role, folder AS value, seq FROM keyed UNION ALL SELECT 'member', folder, seq FROM keyed")
def folder_classes(spark, sf_dir):
    items = _items(spark, sf_dir)
    return albums.folder_classes(items, items)


@query(f"""
WITH {_KEYED}, refs AS (SELECT min(seq) AS ref_seq, folder FROM keyed WHERE NOT is_processed GROUP BY folder),
chosen AS (SELECT k.seq AS ref_seq, k.folder, k.release_id, k.title_key, 'Set ' || k.title AS new_artist FROM keyed k JOIN refs r ON k.seq = r.ref_seq),
hits AS (SELECT i.seq, c.ref_seq, c.new_artist FROM chosen c JOIN keyed i ON i.folder = c.folder WHERE NOT i.is_processed
  UNION SELECT i.seq, c.ref_seq, c.new_artist FROM chosen c JOIN keyed i ON c.release_id <> '' AND i.release_id = c.release_id WHERE NOT i.is_processed
  UNION SELECT i.seq, c.ref_seq, c.new_artist FROM chosen c JOIN keyed i ON i.title_key = c.title_key WHERE NOT i.is_processed),
last_hit AS (SELECT seq, arg_max(new_artist, ref_seq) AS new_artist FROM hits GROUP BY seq)
SELECT k.seq, coalesce(h.new_artist, k.artist) AS artist, k.album FROM keyed k LEFT JOIN last_hit h USING (seq)
""")
def apply_to_album(spark, sf_dir):
    items = _items_by_seq(spark, sf_dir)
    leads = albums.unprocessed(items).groupBy("folder").agg(F.min("seq").alias("seq")).select("seq")
    refs = items.join(leads, "seq", "left_semi")
    edits = refs.select(F.col("seq").alias("ref_seq"), F.concat(F.lit("Set "), "title").alias("artist"))
    changed = albums.apply_to_album(items, edits)
    return changed.select("seq", "artist", "album")


@query(f"""
WITH {_KEYED}, marked AS (SELECT seq, is_processed OR title LIKE 'red%' AS done FROM keyed)
SELECT count(*) FILTER (done) AS done, count(*) FILTER (NOT done) AS open, min(seq) FILTER (NOT done) AS next_seq FROM marked
""")
def review_state(spark, sf_dir):
    items = _items(spark, sf_dir)
    marked = albums.mark_processed(items, items.filter(F.col("title").startswith("red")))
    return marked.agg(
        F.count_if("is_processed").alias("done"),
        F.count_if(~F.col("is_processed")).alias("open"),
        F.min(F.when(~F.col("is_processed"), F.col("seq"))).alias("next_seq"),
    )


@query(f"WITH {_KEYED} SELECT min(seq) AS next_seq FROM keyed WHERE NOT is_processed")
def next_unprocessed(spark, sf_dir):
    return albums.next_unprocessed(_items(spark, sf_dir))


@query(f"WITH {_KEYED} SELECT total, done, '61:05' AS elapsed, "
       "printf('%02d:%02d:%02d', r // 3600, r // 60 % 60, r % 60) AS eta FROM (SELECT count(*) AS total, count(*) FILTER (is_fetched) AS done, "
       "floor((count(*) - count(*) FILTER (is_fetched)) / (count(*) FILTER (is_fetched) / 3665.0))::BIGINT AS r FROM keyed)")
def progress_summary(spark, sf_dir):
    return albums.progress_summary(_items(spark, sf_dir), F.lit(3665.0))


@query(f"""
WITH {_KEYED}, v AS (SELECT seq, title, artist, album, NOT is_processed AS chosen,
  CASE WHEN l % 2 = 0 THEN 'ro ' || title ELSE '' END AS t_ro, CASE WHEN l % 3 = 0 THEN 'en ' || title ELSE '' END AS t_en
  FROM (SELECT *, length(title) AS l FROM keyed))
SELECT seq, CASE WHEN chosen AND t_en <> '' THEN t_en WHEN chosen AND t_ro <> '' THEN t_ro ELSE title END AS title,
  CASE WHEN chosen THEN 'en' ELSE 'now' END AS lyrics_text FROM v
""")
def switch_language(spark, sf_dir):
    items = _items(spark, sf_dir)
    size = F.length("title")
    names = F.struct(
        F.when(size % 2 == 0, F.concat(F.lit("ro "), "title")).otherwise("").alias("romaji"),
        F.when(size % 3 == 0, F.concat(F.lit("en "), "title")).otherwise("").alias("english"),
        F.lit("").alias("japanese"),
    )
    none = F.struct(*[F.lit("").alias(p) for p in ("romaji", "english", "japanese")])
    lyrics = F.struct(F.lit("or").alias("original"), F.lit("").alias("romaji"), F.lit("en").alias("english"))
    tagged = items.withColumns(
        {"title_i18n": names, "artist_i18n": none, "album_i18n": none, "lyrics": lyrics, "lyrics_text": F.lit("now")}
    )
    return albums.switch_language(tagged, albums.unprocessed(items), "EN").select("seq", "title", "lyrics_text")


@query(f"""
WITH {_KEYED}, c AS (SELECT seq, folder, CASE WHEN title LIKE 'red%' THEN 'online' ELSE 'local' END AS choice,
  CASE WHEN is_fetched THEN 'on-' || seq ELSE '' END AS onl, CASE WHEN release_id <> '' THEN 'lo-' || seq ELSE '' END AS loc FROM keyed),
d AS (SELECT *, nullif(CASE WHEN choice = 'online' THEN onl ELSE loc END, '') AS own, coalesce(nullif(onl, ''), nullif(loc, '')) AS any_cover FROM c),
f AS (SELECT folder, arg_min(own, seq) FILTER (own IS NOT NULL) AS picked, arg_min(any_cover, seq) FILTER (any_cover IS NOT NULL) AS first_cover FROM d GROUP BY folder)
SELECT seq, coalesce(own, picked, first_cover, '') AS cover FROM d JOIN f USING (folder)
""")
def batch_covers(spark, sf_dir):
    items = _items(spark, sf_dir).select(
        "seq",
        "folder",
        F.when(F.col("title").startswith("red"), "online").otherwise("local").alias("choice"),
        F.when(F.col("is_fetched"), F.concat(F.lit("on-"), "seq")).otherwise("").alias("online_cover"),
        F.when(F.col("release_id") != "", F.concat(F.lit("lo-"), "seq")).otherwise("").alias("local_cover"),
    )
    return covers.batch_covers(items, batch="folder").select("seq", "cover")


@query(f"""
WITH {_SUMMARY}, a AS (SELECT album_key, CASE WHEN release_id = '' THEN '' ELSE md5(release_id || album_key) END AS mbid, files, tier,
  CASE WHEN tier = 'Discogs' THEN 'own-' || album_key ELSE '' END AS own FROM summary)
SELECT album_key, CASE WHEN own <> '' THEN own WHEN mbid <> '' AND files % 2 = 0 THEN 'https://coverartarchive.org/release-group/' || mbid || '/front-1200'
    WHEN files % 3 = 0 THEN 'discogs' WHEN files % 5 = 0 THEN 'wiki' ELSE '' END AS cover_url,
  CASE WHEN own <> '' THEN 'catalogue' WHEN mbid <> '' AND files % 2 = 0 THEN 'CoverArtArchive'
    WHEN files % 3 = 0 THEN 'Discogs' WHEN files % 5 = 0 THEN 'THBWiki' ELSE '' END AS cover_source FROM a
""")
def choose_cover_source(spark, sf_dir):
    files = F.col("files")
    rows = albums.release_summary(_items(spark, sf_dir)).select(
        "album_key",
        "files",
        F.when(F.col("release_id") == "", "").otherwise(F.md5(F.concat("release_id", "album_key"))).alias("release_id"),
        F.when(F.col("tier") == "Discogs", F.concat(F.lit("own-"), "album_key")).otherwise("").alias("own_cover_url"),
        F.when(files % 3 == 0, "discogs").otherwise("").alias("discogs_cover_url"),
        F.when(files % 5 == 0, "wiki").otherwise("").alias("thwiki_cover_url"),
    )
    # Fetched: the two smaller sizes and one large one, for every second album; some replies are empty.
    tried = covers.cover_fetch_list(rows).join(rows.select("album_key", "files"), "album_key")
    fetched = tried.filter((files % 2 == 0) & (F.col("rank") != 3)).select(
        "url", F.when(F.col("rank") < 2, 0).otherwise(10).alias("length")
    )
    return covers.choose_cover_source(rows, fetched)


# A summary with every tier of the filter codes, by supplier.
_ALL_TIERS = [t for tiers in albums.TIER_FILTERS.values() for t in tiers]


@query(f"""
WITH s AS (SELECT s_suppkey AS n, s_name AS name, (ARRAY{_ALL_TIERS!r})[s_suppkey % {len(_ALL_TIERS)} + 1] AS tier FROM supplier)
{' UNION ALL '.join(f"SELECT {code}::BIGINT AS code, n FROM s WHERE tier IN ({', '.join(map(repr, tiers))}) AND contains(lower(name), 'r#0000000')" for code, tiers in albums.TIER_FILTERS.items())}
UNION ALL SELECT 0, n FROM s WHERE contains(lower(name), 'r#0000000')
""")
def filter_tiers(spark, sf_dir):
    tier = F.get(F.array(*map(F.lit, _ALL_TIERS)), (F.col("s_suppkey") % len(_ALL_TIERS)).cast("int"))
    summary = views.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("n"), F.col("s_name").alias("artist"), F.lit("").alias("album"), F.lit("").alias("release_id"), tier.alias("tier")
    )
    found = None
    for code in [0, *albums.TIER_FILTERS]:
        part = albums.filter_summary(summary, tier=code, search="R#0000000").select(F.lit(code).cast("bigint").alias("code"), "n")
        found = part if found is None else found.unionByName(part)
    return found


@query(f"""
WITH {_KEYED}, v AS (SELECT seq, title, NOT is_processed AS chosen, length(title) % 2 = 0 AS ro, length(title) % 3 = 0 AS en, length(title) % 5 = 0 AS jp FROM keyed)
SELECT 'RO' AS language, seq, CASE WHEN chosen AND ro THEN 'ro ' || title WHEN chosen AND en THEN 'en ' || title ELSE title END AS title,
  CASE WHEN chosen THEN CASE WHEN en THEN 'en words' ELSE 'or words' END ELSE 'now' END AS lyrics_text FROM v
UNION ALL SELECT 'JP', seq, CASE WHEN chosen AND jp THEN 'jp ' || title WHEN chosen AND ro THEN 'ro ' || title ELSE title END,
  CASE WHEN chosen THEN 'or words' ELSE 'now' END FROM v
""")
def switch_languages(spark, sf_dir):
    items, size = _items(spark, sf_dir), F.length("title")

    def named(word, step):
        return F.when(size % step == 0, F.concat(F.lit(word + " "), "title")).otherwise("")

    none = F.struct(*[F.lit("").alias(p) for p in ("romaji", "english", "japanese")])
    tagged = items.withColumns(
        {
            "title_i18n": F.struct(named("ro", 2).alias("romaji"), named("en", 3).alias("english"), named("jp", 5).alias("japanese")),
            "artist_i18n": none, "album_i18n": none, "lyrics_text": F.lit("now"),
            "lyrics": F.struct(
                F.lit("or words").alias("original"), F.lit("").alias("romaji"), F.when(size % 3 == 0, "en words").otherwise("").alias("english")
            ),
        }
    )
    parts = [
        albums.switch_language(tagged, albums.unprocessed(items), code).select(F.lit(code).alias("language"), "seq", "title", "lyrics_text")
        for code in ("RO", "JP")
    ]
    return parts[0].unionByName(parts[1])


@query(f"""
WITH {_KEYED}, refs AS (SELECT min(seq) AS ref_seq, folder FROM keyed WHERE NOT is_processed GROUP BY folder),
chosen AS (SELECT k.seq AS ref_seq, k.folder, k.release_id, k.title_key, CASE WHEN length(k.title) % 2 = 0 THEN 'Al ' || k.title END AS new_album,
  CASE WHEN length(k.title) % 3 = 0 THEN 'Y' || k.year END AS new_year FROM keyed k JOIN refs r ON k.seq = r.ref_seq),
hits AS (SELECT i.seq, c.ref_seq, c.new_album, c.new_year FROM chosen c JOIN keyed i ON i.folder = c.folder WHERE NOT i.is_processed
  UNION SELECT i.seq, c.ref_seq, c.new_album, c.new_year FROM chosen c JOIN keyed i ON c.release_id <> '' AND i.release_id = c.release_id WHERE NOT i.is_processed
  UNION SELECT i.seq, c.ref_seq, c.new_album, c.new_year FROM chosen c JOIN keyed i ON i.title_key = c.title_key WHERE NOT i.is_processed),
last_hit AS (SELECT seq, arg_max(new_album, ref_seq) FILTER (new_album IS NOT NULL) AS new_album, arg_max(new_year, ref_seq) FILTER (new_year IS NOT NULL) AS new_year FROM hits GROUP BY seq)
SELECT k.seq, coalesce(h.new_album, k.album) AS album, coalesce(h.new_year, k.year) AS year FROM keyed k LEFT JOIN last_hit h USING (seq)
""")
def edit_albums(spark, sf_dir):
    items = _items_by_seq(spark, sf_dir)
    leads = albums.unprocessed(items).groupBy("folder").agg(F.min("seq").alias("seq")).select("seq")
    size = F.length("title")
    edits = items.join(leads, "seq", "left_semi").select(
        F.col("seq").alias("ref_seq"), F.when(size % 2 == 0, F.concat(F.lit("Al "), "title")).alias("album"),
        F.when(size % 3 == 0, F.concat(F.lit("Y"), "year")).alias("year"),
    )
    return albums.apply_to_album(items, edits).select("seq", "album", "year")
