"""Captured replies: bodies built from orders, parsed, scored and picked.

Each order gives one reply whose entries are its lines, so a reply is as long as
an order. The SQL works on the lines themselves and never sees JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.operators import lyrics, matching
from catalogkit.session import once
from catalogkit.sources import requests, responses

from . import views
from .registry import Registry
from .views import key_sql

query = Registry()


def order_lines(spark, sf_dir, *fields):
    """Orders with their lines in order of ``seq``, as in ``orders``, but only with the given fields."""
    return views.sales(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("seq", *fields))).alias("lines"))


def orders(spark, sf_dir):
    """Orders with their lines in order of ``seq``, and the names the searches ask for."""
    line = F.struct(
        "seq", "l_linenumber", "p_name", "p_brand", "s_name", "l_partkey", "l_suppkey", "l_quantity",
        "l_returnflag", "l_shipdate", F.md5(F.col("seq").cast("binary")).alias("h"),
    )
    grouped = views.sales(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    first, last = F.get("lines", 0), F.get("lines", F.size("lines") - 1)
    noun = F.substring_index(last["p_name"], " ", -1)
    return grouped.select(
        "l_orderkey",
        "lines",
        F.when(last["l_linenumber"] % 2 == 0, noun).otherwise(F.initcap(last["p_name"])).alias("album"),
        F.when(first["l_linenumber"] == 1, "Unknown Artist").otherwise(F.upper(first["s_name"])).alias("artist"),
        F.concat(F.lit("CAT-"), last["l_partkey"].cast("string")).alias("catalog_no"),
    )


ORDERS_SQL = views.SALES_SQL + """,
ranked AS (SELECT *, md5(seq) AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) - 1 AS pos FROM sales),
asked AS (SELECT l_orderkey, CASE WHEN arg_max(l_linenumber, seq) % 2 = 0 THEN split_part(arg_max(p_name, seq), ' ', -1)
    ELSE array_to_string(list_transform(string_split(arg_max(p_name, seq), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') END AS album,
  CASE WHEN arg_min(l_linenumber, seq) = 1 THEN 'Unknown Artist' ELSE upper(arg_min(s_name, seq)) END AS artist,
  'CAT-' || arg_max(l_partkey, seq)::VARCHAR AS catalog_no FROM sales GROUP BY l_orderkey),
named AS (SELECT r.*, album, artist, catalog_no, """ + key_sql("album") + " AS album_key, " + key_sql("artist") + " AS artist_key, " + key_sql("p_name") + " AS name_key, " + key_sql("s_name") + """ AS supplier_key FROM ranked r JOIN asked USING (l_orderkey))"""


def body(df, **fields):
    return df.withColumn("body", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))


_TITLE_POINTS = "CASE WHEN album_key = '' OR name_key = '' THEN 0 WHEN album_key = name_key THEN 100 WHEN contains(name_key, album_key) OR contains(album_key, name_key) THEN 70 ELSE 0 END"


def _best(score: str, extra: str = "") -> str:
    return (
        f"scored AS (SELECT *, ({score})::BIGINT AS score FROM named), best AS (SELECT * FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY l_orderkey ORDER BY score DESC, pos) AS rn FROM scored {extra}) WHERE rn = 1)"
    )


_KIND = "CASE WHEN l_quantity > 25 THEN 15 WHEN l_quantity < 5 THEN -30 WHEN l_quantity < 10 THEN -50 WHEN l_quantity < 12 THEN -60 ELSE 0 END"


@query(f"""
WITH {ORDERS_SQL}, {_best(f"CASE WHEN contains(name_key, album_key) OR contains(album_key, name_key) THEN 100 ELSE 0 END + CASE WHEN l_returnflag <> 'R' THEN 30 ELSE 0 END + CASE WHEN l_returnflag <> 'N' THEN 20 ELSE 0 END + {_KIND} + trunc((l_quantity + l_linenumber) / 2)")}
SELECT l_orderkey, l_partkey::VARCHAR AS id, score, p_name AS title FROM best
""")
def rank_candidates_discogs(spark, sf_dir):
    def entry(c):
        q = c["l_quantity"]
        kind = F.when(q > 25, "Album").when(q < 5, "Promo").when(q < 10, "Test Pressing").when(q < 12, "Unofficial Release").otherwise("LP")
        return F.struct(
            c["l_partkey"].alias("id"),
            c["p_name"].alias("title"),
            F.when(c["l_returnflag"] == "R", 0).otherwise(F.year(c["l_shipdate"])).alias("year"),
            F.when(c["l_returnflag"] == "N", "").otherwise("http://c").alias("cover_image"),
            F.array(F.struct(F.array(F.lit("Vinyl"), kind).alias("descriptions"))).alias("formats"),
            F.struct(q.alias("have"), c["l_linenumber"].alias("want")).alias("community"),
        )

    rows = body(orders(spark, sf_dir), results=F.transform("lines", entry))
    best = matching.pick_best(
        responses.parse_discogs_search("body"),
        lambda c: matching.discogs_score("album", c["title"], c["year"], c["cover_url"], c["descriptions"], c["have"], c["want"]),
    )
    return rows.select("l_orderkey", best.alias("b")).select(
        "l_orderkey", F.col("b.row.id").alias("id"), F.col("b.score").cast("bigint").alias("score"), F.col("b.row.title").alias("title")
    )


@query(f"""
WITH {ORDERS_SQL}, {_best(f"CASE WHEN l_returnflag = 'A' AND 'CAT-' || l_partkey = catalog_no THEN 150 ELSE 0 END + {_TITLE_POINTS} + CASE WHEN artist <> 'Unknown Artist' AND (contains(supplier_key, artist_key) OR contains(artist_key, supplier_key)) THEN 40 ELSE 0 END")}
SELECT l_orderkey, l_partkey::BIGINT + 1 AS id, score FROM best WHERE score >= 40
""")
def rank_candidates_vdb(spark, sf_dir):
    def entry(c):
        number = F.when(c["l_returnflag"] == "A", F.concat(F.lit("cat "), c["l_partkey"].cast("string"))).otherwise("")
        return F.struct(
            (c["l_partkey"] + 1).alias("id"), c["p_name"].alias("name"), number.alias("catalogNumber"), c["s_name"].alias("artistString")
        )

    rows = body(orders(spark, sf_dir), items=F.transform("lines", entry))
    best = matching.pick_best(
        responses.parse_vdb_search("body"),
        lambda c: matching.vdb_score("artist", "album", "catalog_no", c["title"], c["artist"], c["catalog_no"]),
    )
    return rows.select("l_orderkey", best.alias("b")).filter(F.col("b.score") >= matching.ACCEPT_SCORE).select(
        "l_orderkey", F.col("b.row.id").cast("bigint").alias("id"), F.col("b.score").cast("bigint").alias("score")
    )


@query(f"""
WITH {ORDERS_SQL}, {_best(_TITLE_POINTS + " + CASE WHEN artist_key = supplier_key THEN 50 WHEN contains(supplier_key, artist_key) OR contains(artist_key, supplier_key) THEN 30 ELSE 0 END", "WHERE l_partkey > 0")}
SELECT l_orderkey, l_partkey::BIGINT AS id, score FROM best WHERE score >= 40
""")
def rank_candidates_thwiki(spark, sf_dir):
    entry = lambda c: F.concat(
        F.lit("["), c["l_partkey"].cast("string"), F.lit(',"'), c["p_name"], F.lit('","'), c["s_name"], F.lit('"]')
    )
    rows = orders(spark, sf_dir).withColumn(
        "body", F.concat(F.lit("["), F.array_join(F.transform("lines", entry), ","), F.lit("]"))
    )
    best = matching.pick_best(
        responses.parse_thwiki_search("body"), lambda c: matching.thwiki_score("artist", "album", c["title"], c["artist"])
    )
    return rows.select("l_orderkey", best.alias("b")).filter(F.col("b.score") >= matching.ACCEPT_SCORE).select(
        "l_orderkey", F.col("b.row.id").cast("bigint").alias("id"), F.col("b.score").cast("bigint").alias("score")
    )


@query(f"""
WITH {ORDERS_SQL}, {_best("CASE WHEN contains(name_key, album_key) THEN 50 ELSE 0 END + CASE WHEN contains(supplier_key || 'guest', artist_key) THEN 50 ELSE 0 END")}
SELECT l_orderkey, h AS songmid FROM best
""")
def rank_candidates_qq(spark, sf_dir):
    entry = lambda c: F.struct(
        c["h"].alias("songmid"),
        c["p_name"].alias("songname"),
        F.array(F.struct(c["s_name"].alias("name")), F.struct(F.lit("Guest").alias("name"))).alias("singer"),
    )
    rows = body(orders(spark, sf_dir), data=F.struct(F.struct(F.transform("lines", entry).alias("list")).alias("song")))
    return rows.select("l_orderkey", responses.parse_qq_search("body", "artist", "album").alias("songmid"))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


def _uuid(c):
    h = c["h"]
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


@query(f"""
WITH {ORDERS_SQL}, r AS (SELECT l_orderkey, pos, l_quantity / 100 AS score, CASE WHEN l_returnflag = 'R' THEN '' ELSE {_UUID} END AS grp,
    h AS rec, CASE WHEN l_returnflag = 'N' THEN '' ELSE p_name END AS title, s_name AS artist FROM ranked WHERE l_linenumber <> 7),
s AS (SELECT *, max(score) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
t AS (SELECT * FROM s WHERE score > coalesce(before, -1))
SELECT l_orderkey, max(score) AS score, coalesce(arg_max(grp, pos) FILTER (grp <> ''), '') AS release_group_id, arg_max(rec, pos) AS recording_id,
  coalesce(arg_max(title, pos) FILTER (title <> ''), '') AS title, arg_max(artist, pos) AS artist FROM t GROUP BY l_orderkey
""")
def acoustid_pick(spark, sf_dir):
    def result(c):
        recording = F.struct(
            c["h"].alias("id"),
            F.when(c["l_returnflag"] == "N", "").otherwise(c["p_name"]).alias("title"),
            F.array(F.struct(F.lit("").alias("name")), F.struct(c["s_name"].alias("name"))).alias("artists"),
            F.when(c["l_returnflag"] != "R", F.array(F.struct(_uuid(c).alias("id")))).alias("releasegroups"),
        )
        return F.struct((c["l_quantity"] / 100).alias("score"), F.when(c["l_linenumber"] != 7, F.array(recording)).alias("recordings"))

    rows = body(orders(spark, sf_dir), status=F.lit("ok"), results=F.transform("lines", result))
    picked = rows.select("l_orderkey", matching.running_best(responses.parse_acoustid("body")).alias("p")).select("l_orderkey", "p.*")
    return picked.filter(F.col("score") >= 0)


@query("""
WITH r AS (SELECT conv_id, turn, length(text) % 97 AS score, role, CASE WHEN turn % 3 = 0 THEN '' ELSE md5(text) END AS mark FROM conversations),
s AS (SELECT *, max(score) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
t AS (SELECT * FROM s WHERE score > coalesce(before, -1))
SELECT conv_id, max(score)::BIGINT AS best_score, arg_max(role, turn) FILTER (role <> '') AS role, arg_max(mark, turn) FILTER (mark <> '') AS mark FROM t GROUP BY conv_id
""")
def running_best(spark, sf_dir):
    turns = views.spread_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        (F.length("text") % 97).cast("bigint").alias("score"),
        "role",
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.md5("text")).alias("mark"),
    )
    return matching.running_best_rows(turns, "conv_id", "turn", "score", ["role", "mark"], chunk=3)


@query(f"""
WITH {ORDERS_SQL} SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) - 1 AS pos, {_UUID} AS id, p_name AS title,
  strftime(l_shipdate, '%Y-%m-%d') AS date, s_name || ', ' || p_brand AS artist, l_quantity::BIGINT AS score FROM ranked WHERE l_returnflag <> 'N'
""")
def parse_release_groups(spark, sf_dir):
    entry = lambda c: F.struct(
        F.when(c["l_returnflag"] == "N", "short").otherwise(_uuid(c)).alias("id"),
        c["p_name"].alias("title"),
        F.date_format(c["l_shipdate"], "yyyy-MM-dd").alias("first-release-date"),
        c["l_quantity"].cast("int").alias("score"),
        F.array(*[F.struct(v.alias("name")) for v in (c["s_name"], F.lit(""), c["p_brand"])]).alias("artist-credit"),
    )
    rows = body(orders(spark, sf_dir), **{"release-groups": F.transform("lines", entry)})
    return rows.select("l_orderkey", F.posexplode(responses.parse_musicbrainz_groups("body")).alias("pos", "g")).select(
        "l_orderkey", F.col("pos").cast("bigint").alias("pos"), "g.id", "g.title", "g.date", "g.artist", F.col("g.score").cast("bigint").alias("score")
    )


_MB_STATUS = "CASE WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 3 END"


@query(f"""
WITH {ORDERS_SQL}, t AS (SELECT *, {_MB_STATUS} AS kind FROM ranked),
pick AS (SELECT l_orderkey, min(kind) AS kind, min(strftime(l_shipdate, '%Y-%m-%d')) AS date FROM t GROUP BY l_orderkey)
SELECT l_orderkey, date, l_linenumber::BIGINT AS position, p_name AS title, s_name AS artist, (l_quantity * 1000)::BIGINT AS length_ms
FROM t JOIN pick USING (l_orderkey, kind)
""")
def parse_release_tracks(spark, sf_dir):
    def release(status, flag):
        own = F.filter("lines", lambda c: c["l_returnflag"] == flag)
        track = lambda c: F.struct(
            c["l_linenumber"].alias("position"),
            F.when(c["l_linenumber"] % 2 == 0, c["p_name"]).otherwise("").alias("title"),
            F.when(c["l_linenumber"] % 2 == 0, (c["l_quantity"] * 1000).cast("bigint")).alias("length"),
            F.when(c["l_linenumber"] % 2 == 0, F.array(F.struct(c["s_name"].alias("name")))).alias("artist-credit"),
            F.struct(
                c["p_name"].alias("title"),
                (c["l_quantity"] * 1000).cast("bigint").alias("length"),
                F.array(F.struct(c["s_name"].alias("name")), F.struct(F.lit("Guest").alias("name"))).alias("artist-credit"),
            ).alias("recording"),
        )
        date = F.coalesce(F.array_min(F.transform(own, lambda c: F.date_format(c["l_shipdate"], "yyyy-MM-dd"))), F.lit(""))
        odd = F.filter(own, lambda c: c["l_linenumber"] % 2 == 1)
        even = F.filter(own, lambda c: c["l_linenumber"] % 2 == 0)
        media = F.array(*[F.struct(F.transform(part, track).alias("tracks")) for part in (odd, even)])
        return F.struct(F.lit(status).alias("status"), date.alias("date"), media.alias("media"))

    rows = body(orders(spark, sf_dir), releases=F.array(release("Bootleg", "R"), release("Official", "A"), release("Pseudo-Release", "N")))
    return once(rows.select("l_orderkey", "body"), {"r": responses.parse_musicbrainz_releases("body")}).select(
        "l_orderkey", F.col("r.release_date").alias("date"), F.explode("r.tracks").alias("t")
    ).select(
        "l_orderkey", "date", F.col("t.position").cast("bigint").alias("position"), "t.title", "t.artist",
        F.col("t.length_ms").cast("bigint").alias("length_ms"),
    )


@query(f"""
WITH {ORDERS_SQL}, h AS (SELECT l_orderkey, string_agg(s_name || p_brand, '' ORDER BY pos) AS credit FROM ranked GROUP BY l_orderkey)
SELECT l_orderkey, 'rg-' || l_orderkey AS release_id, credit AS artist, CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE pos + 1 END::BIGINT AS position,
  p_name AS title, CASE WHEN l_returnflag = 'N' THEN s_name || ' feat. X' ELSE credit END AS track_artist FROM ranked JOIN h USING (l_orderkey)
""")
def parse_single_release(spark, sf_dir):
    credit = F.transform("lines", lambda c: F.struct(c["s_name"].alias("name"), c["p_brand"].alias("joinphrase")))
    track = lambda c: F.struct(
        F.when(c["l_returnflag"] == "A", c["l_linenumber"]).otherwise(0).alias("position"),
        F.lit("").alias("title"),
        F.when(
            c["l_returnflag"] == "N",
            F.array(F.struct(c["s_name"].alias("name"), F.lit(" feat. ").alias("joinphrase")), F.struct(F.lit("X").alias("name"), F.lit("").alias("joinphrase"))),
        ).alias("artist-credit"),
        F.struct(c["p_name"].alias("title")).alias("recording"),
    )
    rows = body(
        orders(spark, sf_dir),
        **{
            "artist-credit": credit,
            "release-group": F.struct(F.concat(F.lit("rg-"), F.col("l_orderkey").cast("string")).alias("id")),
            "media": F.array(F.struct(F.transform("lines", track).alias("tracks"))),
        },
    )
    return once(rows.select("l_orderkey", "body"), {"r": responses.parse_musicbrainz_release("body")}).select(
        "l_orderkey", "r.release_id", "r.artist", F.explode("r.tracks").alias("t")
    ).select(
        "l_orderkey", "release_id", "artist", F.col("t.position").cast("bigint").alias("position"), "t.title", F.col("t.artist").alias("track_artist")
    )


@query(f"WITH {ORDERS_SQL} SELECT l_orderkey, coalesce(arg_min({_UUID}, pos) FILTER (l_returnflag = 'A'), '') AS grp FROM ranked GROUP BY l_orderkey")
def parse_recording_groups(spark, sf_dir):
    entry = lambda c: F.struct(F.when(c["l_returnflag"] == "A", _uuid(c)).otherwise("none").alias("id"))
    rows = body(orders(spark, sf_dir), **{"release-groups": F.transform("lines", entry)})
    return rows.select("l_orderkey", responses.parse_recording_groups("body").alias("grp"))


@query(f"""
WITH {ORDERS_SQL}, counted AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS place FROM ranked WHERE l_returnflag <> 'R'),
h AS (SELECT l_orderkey, string_agg(s_name, ', ' ORDER BY pos) AS artist, coalesce(arg_min('p' || pos, pos) FILTER (l_quantity > 40), 'p0') AS cover,
  CASE WHEN l_orderkey % 3 = 0 THEN '1999-01-02' WHEN l_orderkey % 3 = 1 THEN (1950 + l_orderkey % 60)::VARCHAR ELSE (1900 + l_orderkey % 99)::VARCHAR END AS date FROM ranked GROUP BY l_orderkey)
SELECT l_orderkey, date AS release_date, artist, cover AS cover_url, CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE place END::BIGINT AS position,
  p_name AS title, CASE WHEN l_linenumber = 3 THEN s_name ELSE artist END AS track_artist, ((l_linenumber * 60 + l_quantity) * 1000)::BIGINT AS length_ms
FROM counted JOIN h USING (l_orderkey)
""")
def parse_discogs_release(spark, sf_dir):
    key = F.col("l_orderkey")
    track = lambda c: F.struct(
        F.when(c["l_returnflag"] == "A", F.concat(F.lit("B"), c["l_linenumber"].cast("string"))).otherwise("").alias("position"),
        F.when(c["l_returnflag"] == "R", "heading").when(c["l_linenumber"] > 4, "track").otherwise("").alias("type_"),
        c["p_name"].alias("title"),
        F.concat_ws(":", c["l_linenumber"].cast("string"), c["l_quantity"].cast("int").cast("string")).alias("duration"),
        F.when(c["l_linenumber"] == 3, F.array(F.struct(F.concat(c["s_name"], F.lit(" (guest)")).alias("name")))).alias("artists"),
    )
    image = lambda c, i: F.struct(
        F.when(c["l_quantity"] > 40, "primary").otherwise("secondary").alias("type"),
        F.when(i % 2 == 0, F.concat(F.lit("p"), i.cast("string"))).otherwise("").alias("uri"),
        F.concat(F.lit("p"), i.cast("string")).alias("resource_url"),
    )
    rows = body(
        orders(spark, sf_dir),
        title=F.lit("x"),
        released=F.when(key % 3 == 0, "1999-01-02").otherwise(""),
        year=F.when(key % 3 == 1, F.col("l_orderkey") % 60 + 1950).otherwise(0),
        master_id=key + 1,
        artists=F.transform("lines", lambda c: F.struct(F.concat(c["s_name"], F.lit(" (12)")).alias("name"))),
        images=F.transform("lines", image),
        tracklist=F.transform("lines", track),
    )
    parsed = rows.select("l_orderkey", responses.parse_discogs_release("body").alias("r")).select("l_orderkey", "r.*")
    masters = rows.filter(key % 3 == 2).select(
        (key + 1).alias("master_id"), (key % 99 + 1900).cast("string").alias("master_year")
    )
    dated = responses.with_master_year(parsed, masters)
    return dated.select("l_orderkey", "release_date", "artist", "cover_url", F.explode("tracks").alias("t")).select(
        "l_orderkey", "release_date", "artist", "cover_url", F.col("t.position").cast("bigint").alias("position"), "t.title",
        F.col("t.artist").alias("track_artist"), F.col("t.length_ms").cast("bigint").alias("length_ms"),
    )


@query(f"""
WITH {ORDERS_SQL}, h AS (SELECT l_orderkey, arg_min(s_name, pos) FILTER (l_returnflag = 'A') AS circle, arg_min(s_name, pos) FILTER (l_returnflag = 'N') AS producer,
  arg_min(p_brand, pos) FILTER (l_returnflag = 'R') AS japanese FROM ranked GROUP BY l_orderkey),
a AS (SELECT *, coalesce(circle, CASE WHEN l_orderkey % 2 = 1 THEN 'Band' END, producer, 'Various artists') AS artist FROM h)
SELECT l_orderkey, 'raw name' AS title, coalesce(japanese, 'default') AS title_japanese, artist,
  CASE WHEN l_orderkey % 4 = 0 THEN '2001.02.03' WHEN l_orderkey % 4 = 1 THEN '2001' ELSE '' END AS release_date, l_linenumber::BIGINT AS position,
  CASE WHEN l_linenumber % 2 = 0 THEN 'R ' || p_name ELSE p_name END AS track_title, CASE WHEN l_linenumber = 3 THEN s_name ELSE artist END AS track_artist,
  (l_quantity * 1000)::BIGINT AS length_ms, CASE WHEN l_linenumber % 2 = 0 THEN 'late' WHEN l_linenumber % 3 = 0 THEN 'fr first' ELSE '' END AS english, 'orig' AS original
FROM ranked JOIN a USING (l_orderkey)
""")
def parse_vdb_album(spark, sf_dir):
    key = F.col("l_orderkey")

    def name(language, value):
        return F.struct(F.lit(language).alias("language"), value.alias("value"))

    def lyric(kind, culture, value):
        return F.struct(F.lit(kind).alias("translationType"), F.array(F.lit(culture)).alias("cultureCodes"), F.lit(value).alias("value"))

    original = lyric("Original", "ja", "orig")
    late = [lyric("Translation", "fr", "first"), lyric("Translation", "en", "soon"), lyric("Translation", "de", "no"), lyric("Translation", "en", "late")]
    french = [lyric("Translation", "fr", "fr first"), lyric("Translation", "de", "no")]
    track = lambda c: F.struct(
        c["l_linenumber"].alias("trackNumber"),
        F.when(c["l_linenumber"] == 1, "").otherwise(c["p_name"]).alias("name"),
        F.struct(
            c["p_name"].alias("name"),
            F.when(c["l_linenumber"] % 2 == 0, F.array(name("Romaji", F.lit("")), name("Romaji", F.concat(F.lit("R "), c["p_name"])))).alias("names"),
            c["l_quantity"].cast("int").alias("lengthSeconds"),
            F.when(c["l_linenumber"] == 3, c["s_name"]).otherwise("").alias("artistString"),
            F.when(c["l_linenumber"] % 2 == 0, F.array(original, *late))
            .when(c["l_linenumber"] % 3 == 0, F.array(original, *french))
            .otherwise(F.array(original))
            .alias("lyrics"),
        ).alias("song"),
    )
    artist = lambda c: F.struct(
        F.when(c["l_returnflag"] == "A", "Circle, Label").when(c["l_returnflag"] == "N", "Producer").otherwise("Vocalist").alias("categories"),
        F.struct(c["s_name"].alias("name")).alias("artist"),
    )
    rows = body(
        orders(spark, sf_dir),
        name=F.lit("raw name"),
        defaultName=F.lit("default"),
        names=F.transform(F.filter("lines", lambda c: c["l_returnflag"] == "R"), lambda c: name("Japanese", c["p_brand"])),
        releaseDate=F.struct(
            F.lit(2001).alias("year"), F.when(key % 4 == 0, 2).otherwise(0).alias("month"), F.lit(3).alias("day"), (key % 4 > 1).alias("isEmpty")
        ),
        artistString=F.when(key % 2 == 1, "Band").otherwise("Various artists"),
        artists=F.transform("lines", artist),
        tracks=F.transform("lines", track),
    )
    # Bound once: the explode below brings a filter that would parse each body twice more.
    return once(rows.select("l_orderkey", "body"), {"r": responses.parse_vdb_album("body")}).select(
        "l_orderkey", "r.title", F.col("r.title_i18n.japanese").alias("title_japanese"), "r.artist", "r.release_date", F.explode("r.tracks").alias("t")
    ).select(
        "l_orderkey", "title", "title_japanese", "artist", "release_date", F.col("t.position").cast("bigint").alias("position"),
        F.col("t.title").alias("track_title"), F.col("t.artist").alias("track_artist"), F.col("t.length_ms").cast("bigint").alias("length_ms"),
        F.col("t.lyrics.english").alias("english"), F.col("t.lyrics.original").alias("original"),
    )


@query(f"""
WITH {ORDERS_SQL}, h AS (SELECT l_orderkey, string_agg(DISTINCT 'C' || l_orderkey % 5, '') AS circle FROM ranked GROUP BY l_orderkey)
SELECT l_orderkey, 'album ' || l_orderkey AS title, circle || ', guest' AS artist, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE pos + 1 END::BIGINT AS position,
  p_name AS track_title, CASE WHEN l_returnflag = 'A' THEN s_name || ', ' || p_brand WHEN l_returnflag = 'N' THEN 'vocal ' || s_name ELSE circle || ', guest' END AS track_artist,
  (trunc(l_quantity) * 1000)::BIGINT AS length_ms FROM ranked JOIN h USING (l_orderkey)
""")
def parse_thwiki_album(spark, sf_dir):
    def pair(key, value):
        return F.concat(F.lit(f'["{key}",'), value, F.lit("]"))

    def quoted(value):
        return F.concat(F.lit('"'), value, F.lit('"'))

    def track(c):
        pairs = F.array(
            pair("name", quoted(c["p_name"])),
            F.when(c["l_linenumber"] % 2 == 0, pair("trackno", c["l_linenumber"].cast("string"))),
            F.when(c["l_returnflag"] == "A", pair("artist", F.concat(F.lit("["), quoted(c["s_name"]), F.lit(',"",'), quoted(c["p_brand"]), F.lit("]")))),
            F.when(c["l_returnflag"] == "N", pair("vocal", quoted(F.concat(F.lit("vocal "), c["s_name"])))),
            pair("time", quoted(c["l_quantity"].cast("int").cast("string"))),
        )
        return F.concat(F.lit("["), F.array_join(F.array_compact(pairs), ","), F.lit("]"))

    key = F.col("l_orderkey").cast("string")
    head = F.array(
        pair("alname", quoted(F.lit("overwritten"))),
        pair("circle", F.concat(F.lit('["C'), (F.col("l_orderkey") % 5).cast("string"), F.lit('","guest"]'))),
        pair("alname", quoted(F.concat(F.lit("album "), key))),
    )
    text_body = F.concat(
        F.lit("[["), F.array_join(head, ","), F.lit("],["), F.array_join(F.transform("lines", track), ","), F.lit("]]")
    )
    rows = orders(spark, sf_dir).select("l_orderkey", text_body.alias("body"))
    # Bound once: the explode below brings a filter that would parse each body again.
    return once(rows, {"r": responses.parse_thwiki_album("body")}).select("l_orderkey", "r.title", "r.artist", F.explode("r.tracks").alias("t")).select(
        "l_orderkey", "title", "artist", F.col("t.position").cast("bigint").alias("position"), F.col("t.title").alias("track_title"),
        F.col("t.artist").alias("track_artist"), F.col("t.length_ms").cast("bigint").alias("length_ms"),
    )


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) WHEN doc_id % 3 = 1 THEN md5('p' || text) ELSE md5('') END AS lrclib,
  md5(CASE WHEN doc_id % 5 = 0 THEN '' ELSE text || '&' END) AS qq,
  CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE '' END AS song_original, CASE WHEN doc_id % 2 = 1 THEN lang ELSE '' END AS song_romaji FROM documents
""")
def parse_lyrics_replies(spark, sf_dir):
    docs = views.spread_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    third, even = F.col("doc_id") % 3, F.col("doc_id") % 2 == 0
    lrc = F.to_json(
        F.struct(
            F.when(third == 0, F.col("text")).when(third == 1, "null").otherwise("").alias("syncedLyrics"),
            F.when(third < 2, F.concat(F.lit("p"), "text")).alias("plainLyrics"),
        )
    )
    coded = F.base64(F.concat(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("&#38;")).cast("binary"))
    qq = F.to_json(F.struct(F.when(F.col("doc_id") % 5 == 0, "").otherwise(coded).alias("lyric")))
    song = F.struct(
        F.array(
            F.struct(
                F.when(even, F.lit("Original")).otherwise("Romanized").alias("translationType"),
                F.when(even, F.col("text")).otherwise(F.col("lang")).alias("value"),
            )
        ).alias("lyrics")
    )
    found = F.to_json(F.struct(F.array_append(
                F.array(F.struct(F.array().cast("array<struct<translationType:string,value:string>>").alias("lyrics"))), song
            ).alias("items")))
    lyric = responses.parse_vdb_lyrics_search(found)
    return docs.select(
        "doc_id",
        F.md5(responses.parse_lrclib(lrc)).alias("lrclib"),
        F.md5(responses.parse_qq_lyric(qq)).alias("qq"),
        F.when(lyric["original"] == "", "").otherwise(F.md5(lyric["original"])).alias("song_original"),
        lyric["romaji"].alias("song_romaji"),
    )


def _lyric_link():
    return F.concat_ws("/", F.lit("http://l"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))


_LYRIC_ITEMS = """
i AS (SELECT conv_id, turn, role || '-' || conv_id::VARCHAR AS artist, 'turn ' || turn::VARCHAR AS title, text, (conv_id * 7 + turn) % 5 AS kind FROM conversations),
f AS (SELECT *, CASE kind WHEN 0 THEN 'lrc ' || text WHEN 1 THEN '[01:00]' || text WHEN 2 THEN '[00:09]歌' ELSE '' END AS fetched FROM i)"""


@query(f"""
WITH {_LYRIC_ITEMS}
SELECT conv_id, turn, md5(CASE WHEN linked THEN 'linked ' || text WHEN fetched <> '' THEN fetched WHEN kind = 3 THEN 'romaji text' ELSE '' END) AS lyrics_text,
  linked OR fetched <> '' OR kind = 3 AS has_lyrics, NOT linked AND kind IN (1, 2) AS has_synced,
  CASE WHEN linked THEN 'http://l/' || conv_id || '/' || turn WHEN kind = 2 THEN '[00:09]歌' ELSE '' END AS original,
  CASE WHEN kind = 2 AND NOT linked THEN '[00:09]歌' WHEN kind = 3 THEN 'romaji text' ELSE '' END AS romaji FROM (SELECT *, turn % 3 = 1 AS linked FROM f)
""")
def resolve_lyrics(spark, sf_dir):
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 5
    turns = views.spread_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    items = turns.select(
        "conv_id",
        "turn",
        "text",
        kind.alias("kind"),
        F.concat("role", F.lit("-"), F.col("conv_id").cast("string")).alias("artist"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"),
        F.lit("").alias("album"),
        F.lit("").alias("lyrics_text"),
        F.struct(
            F.when(F.col("turn") % 3 == 1, _lyric_link()).otherwise("").alias("original"), F.when(kind == 3, "romaji text").otherwise("").alias("romaji"), F.lit("").alias("english")
        ).alias("lyrics"),
    )
    lrc = items.filter("kind IN (0, 2)").select(
        requests.lrclib("artist", "title", "album").alias("url"),
        F.to_json(F.struct(F.when(F.col("kind") == 0, F.concat(F.lit("lrc "), "text")).otherwise("[00:09]歌").alias("syncedLyrics"))).alias("body"),
    )
    songs = items.filter("kind = 1").withColumn("mid", F.md5(F.concat_ws("/", "artist", "title")))
    found = F.array(F.struct("mid", F.col("title").alias("songname")).withField("songmid", F.col("mid")).dropFields("mid"))
    qq = songs.select(
        requests.qq_search("artist", "title").alias("url"),
        F.to_json(F.struct(F.struct(F.struct(found.alias("list")).alias("song")).alias("data"))).alias("body"),
    ).unionByName(
        songs.select(
            requests.qq_lyric("mid").alias("url"),
            F.to_json(F.struct(F.base64(F.concat(F.lit("[01:00]"), "text").cast("binary")).alias("lyric"))).alias("body"),
        )
    )
    replies = lrc.unionByName(qq)
    fetched = lyrics.lookup_lyrics(items, replies)
    # The same address twice: the first by request_id counts.
    linked = turns.filter("turn % 3 = 1").select(
        _lyric_link().alias("url"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("request_id"), "text"
    ).select("url", "request_id", F.concat(F.when(F.col("request_id") == "a", "linked ").otherwise("a later "), "text").alias("body"))
    settled = lyrics.resolve_lyrics(fetched, linked)
    return settled.select(
        "conv_id", "turn", F.md5("lyrics_text").alias("lyrics_text"), "has_lyrics", "has_synced", "lyrics.original", "lyrics.romaji"
    )


@query(f"""
WITH {_LYRIC_ITEMS} SELECT conv_id, turn, md5(CASE kind WHEN 0 THEN fetched ELSE '' END) AS lyrics FROM f
""")
def batch_lyrics(spark, sf_dir):
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 5
    turns = views.spread_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", "text", kind.alias("kind"),
        F.concat("role", F.lit("-"), F.col("conv_id").cast("string")).alias("artist"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"),
        F.lit("").alias("album"),
    )
    replies = turns.filter("kind = 0").select(
        requests.lrclib("artist", "title", "album").alias("url"),
        F.to_json(F.struct(F.concat(F.lit("lrc "), "text").alias("plainLyrics"))).alias("body"),
    )
    found = lyrics.batch_lookup(turns.select("conv_id", "turn", "artist", "title", "album"), replies)
    return found.select("conv_id", "turn", F.md5("lyrics").alias("lyrics"))
