"""Column functions over whole documents, pages and names."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from catalogkit.functions import extract, japanese, language, text, values
from catalogkit.operators import covers
from catalogkit.session import shared_folder
from catalogkit.sources import requests

from . import views
from .registry import Registry
from .views import key_sql, lower_sql, strip_sql

query = Registry()


@query(f"SELECT doc_id, md5({key_sql(strip_sql('text'))}) AS name_key, md5({strip_sql('text')}) AS stripped, "
       f"md5(trim({strip_sql('text')}, ' \t\r\n')) AS cleaned, md5({lower_sql('text')}) AS lowered FROM documents")
def normalize_keys(spark, sf_dir):
    docs = views.spread_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(
        "doc_id",
        F.md5(text.normalize_key("text")).alias("name_key"),
        F.md5(text.strip_brackets("text")).alias("stripped"),
        F.md5(text.clean_metadata("text")).alias("cleaned"),
        F.md5(text.ascii_lower("text")).alias("lowered"),
    )


@query(f"SELECT page_id, md5({strip_sql('html', 8)}) AS stripped, length({strip_sql('html', 8)}) AS n FROM pages")
def strip_brackets(spark, sf_dir):
    pages = views.spread_table(spark, sf_dir, "pages", "page_id", "html")
    bare = text.strip_brackets("html")
    return pages.select("page_id", F.md5(bare).alias("stripped"), F.length(bare).cast("bigint").alias("n"))


_DATED = "strftime(l_shipdate, '%Y.%m.%d') || ' - ' || p_name || ' [' || p_brand || ']'"
_DATE_PATTERN = "^\\s*([0-9]{4}[.-][0-9]{2}[.-][0-9]{2}|[0-9]{4}[.-][0-9]{2}|[0-9]{4})\\s*"


@query(f"""
WITH {views.SALES_SQL}, n AS (SELECT seq, {_DATED} AS name FROM sales)
SELECT seq, trim(regexp_replace(trim({strip_sql('name', 2)}, ' \t\r\n'), '{_DATE_PATTERN}', ''), ' \t\r\n.-_') AS album,
  rtrim(ltrim(translate(name || '?. ', '<>:"/\\|?*' || chr(9) || chr(13) || chr(10), '_________   ')), ' .') AS safe,
  trim(translate(name, ';+-&|!(){{}}[]^"~*?:\\/', '                     '), ' \t') AS lucene,
  trim('**' || name || ' -', ' \t\r\n*#-_') AS plain FROM n
""")
def clean_titles(spark, sf_dir):
    name = F.concat(
        F.date_format("l_shipdate", "yyyy.MM.dd"), F.lit(" - "), F.col("p_name"), F.lit(" ["), F.col("p_brand"), F.lit("]")
    )
    return views.sales(spark, sf_dir).select("seq", name.alias("name")).select(
        "seq",
        text.clean_album_title("name").alias("album"),
        text.sanitize_filename(F.concat("name", F.lit("?. "))).alias("safe"),
        text.escape_lucene("name").alias("lucene"),
        text.trim_markup(F.concat(F.lit("**"), F.col("name"), F.lit(" -"))).alias("plain"),
    )


_URL_STEM = r"regexp_replace(regexp_extract(url, '(?s)([^/\\]*)$', 1), '(?s)^(.+)\.[^.]*$', '\1')"
_UUID = "substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4) || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, 12)"


@query(f"""
WITH u AS (SELECT page_id, url, url || '/release/' || {_UUID} AS link FROM pages)
SELECT page_id, regexp_extract(url, '((?:19|20)[0-9]{{2}})', 1) AS year, {_UUID} AS uuid,
  regexp_extract(url, '([0-9]{{4,10}})', 1) AS discogs_id, contains(url, '/master/') OR contains(url, '/masters/') AS is_master,
  coalesce(nullif(regexp_extract(url, '([0-9]{{1,8}})', 1), '')::BIGINT, 0) AS vdb_id,
  coalesce(try_cast(nullif(regexp_extract(url, '[?&][ai]=([0-9]{{1,10}})', 1), '') AS INT),
    try_cast(nullif(regexp_extract(url, '([0-9]{{1,10}})', 1), '') AS INT), 0)::BIGINT AS thwiki_id,
  CASE WHEN regexp_matches(url, '^[rmRM]') THEN 'discogs' ELSE 'musicbrainz' END AS service,
  {key_sql(strip_sql(f"CASE WHEN contains({_URL_STEM}, '_') AND strlen(split_part({_URL_STEM}, '_', 1)) <= 4 AND regexp_matches({_URL_STEM}, '^[0-9]') THEN substr({_URL_STEM}, length(split_part({_URL_STEM}, '_', 1)) + 2) ELSE {_URL_STEM} END", 1))} AS track_name
FROM u
""")
def extract_ids(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("page_id", "url")
    h = F.md5(F.col("url").cast("binary"))
    uuid = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
    )
    discogs = extract.extract_discogs_id("url")
    return pages.select(
        "page_id",
        extract.extract_year("url").alias("year"),
        extract.extract_uuid(F.concat(F.col("url"), F.lit("/release/"), uuid)).alias("uuid"),
        discogs["id"].alias("discogs_id"),
        discogs["is_master"].alias("is_master"),
        extract.extract_vdb_id("url").cast("bigint").alias("vdb_id"),
        extract.extract_thwiki_id("url").cast("bigint").alias("thwiki_id"),
        extract.route_metadata_link("url").alias("service"),
        text.normalize_track_name("url").alias("track_name"),
    )


@query(f"""
WITH {views.SALES_SQL}, n AS (SELECT seq, l_partkey, l_suppkey, l_linenumber,
  '[Circle-' || p_brand || '] [AB-' || l_suppkey || '] ' || p_name || ' (XYZ_' || l_partkey || ')' AS name,
  l_linenumber || '. ' || p_name || '.mp3' AS file FROM sales)
SELECT seq, regexp_extract(name, '[\\[(]([A-Za-z0-9]{{2,12}}[-_][A-Za-z0-9~_\\-.]{{1,16}})[\\])]', 1) AS catalog_no,
  split_part(split_part(name, '[', 2), ']', 1) AS artist,
  'https://touhoudb.com/Al/' || l_partkey AS touhou_page, 'https://www.discogs.com/release/' || l_suppkey AS discogs_page,
  'https://musicbrainz.org/release-group/' || md5(name) AS default_page,
  'https://coverartarchive.org/release/' || md5(name) || '/front-500' AS sixth_cover,
  l_linenumber::BIGINT AS lead_no, replace(lower(split_part(file, '. ', 2)[:-5]), ' ', '') AS stem_key FROM n
""")
def extract_names(spark, sf_dir):
    name = F.concat(
        F.lit("[Circle-"), "p_brand", F.lit("] [AB-"), "l_suppkey", F.lit("] "), "p_name", F.lit(" (XYZ_"), "l_partkey", F.lit(")")
    )
    file = F.concat(F.col("l_linenumber"), F.lit(". "), F.col("p_name"), F.lit(".mp3"))
    mbid = F.md5(F.col("name").cast("binary"))
    rows = views.sales(spark, sf_dir).select("seq", "l_partkey", "l_suppkey", name.alias("name"), file.alias("file"))
    return rows.select(
        "seq",
        extract.extract_catalog_no("name").alias("catalog_no"),
        extract.extract_artist_from_filename("name").alias("artist"),
        extract.release_web_url(extract.release_id(F.lit("TouhouDB"), "l_partkey")).alias("touhou_page"),
        extract.release_web_url(extract.release_id(F.lit("Discogs"), "l_suppkey")).alias("discogs_page"),
        extract.release_web_url(mbid).alias("default_page"),
        F.get(extract.cover_candidate_urls(mbid), 5).alias("sixth_cover"),
        extract.leading_track_no("file").cast("bigint").alias("lead_no"),
        extract.match_stem("file").alias("stem_key"),
    )


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS plain FROM pages")
def unescape_entities(spark, sf_dir):
    pages = views.spread_table(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", F.md5(text.unescape_html("html")).alias("plain"))


@query("SELECT doc_id, md5(url_encode(text)) AS encoded, md5(text) AS decoded FROM documents")
def encode_texts(spark, sf_dir):
    docs = views.spread_table(spark, sf_dir, "documents", "doc_id", "text")
    coded = F.concat_ws("\n ", F.split(F.base64(F.col("text").cast("binary")), "=+"))
    return docs.select(
        "doc_id",
        F.md5(text.url_encode_rfc3986("text")).alias("encoded"),
        F.md5(text.decode_base64_text(coded)).alias("decoded"),
    )


@query("""
WITH {SALES}, n AS (SELECT seq, s_name AS artist, p_brand AS album, p_name AS title, l_suppkey FROM sales)
SELECT seq,
 'https://musicbrainz.org/ws/2/release-group?query=' || url_encode('artist:"' || replace(artist, '#', '#') || '" AND release:"' || album || '"') || '&fmt=json' AS groups,
 'https://musicbrainz.org/ws/2/release-group?query=release:"' || url_encode(album) || '"&fmt=json' AS by_title,
 'https://vocadb.net/api/albums?query=' || url_encode(album) || '&lang=Romaji&fields=Tracks,MainPicture,Artists,Names,Identifiers&songFields=Lyrics,Names&maxResults=5' AS vocadb,
 'https://thwiki.cc/album.php?m=sa&v=' || url_encode(artist || ' ' || album) || '&o=1&g=0' AS thwiki,
 'https://api.discogs.com/database/search?release_title=' || url_encode(album) || '&artist=' || url_encode(artist) || '&type=release' AS discogs,
 'https://lrclib.net/api/get?artist_name=' || url_encode(artist) || '&track_name=' || url_encode(title) || '&album_name=' || url_encode(album) AS lrclib,
 'https://c.y.qq.com/soso/fcgi-bin/client_search_cp?p=1&n=5&w=' || url_encode(artist || ' ' || title) || '&format=json' AS qq
FROM n
""".replace("{SALES}", views.SALES_SQL))
def request_urls(spark, sf_dir):
    rows = views.sales(spark, sf_dir).select(
        "seq", F.col("s_name").alias("artist"), F.col("p_brand").alias("album"), F.col("p_name").alias("title")
    )
    return rows.select(
        "seq",
        requests.group_search("artist", "album").alias("groups"),
        requests.group_search_by_title("album").alias("by_title"),
        requests.vdb_album_search("VocaDB", "album").alias("vocadb"),
        requests.thwiki_search(F.concat_ws(" ", "artist", "album")).alias("thwiki"),
        requests.discogs_search("artist", "album").alias("discogs"),
        requests.lrclib("artist", "title", "album").alias("lrclib"),
        requests.qq_search("artist", "title").alias("qq"),
    )


@query("SELECT doc_id, regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]') AS plain, "
       "doc_id % 3 = 0 AS mixed FROM documents")
def contains_cjk(spark, sf_dir):
    docs = views.spread_table(spark, sf_dir, "documents", "doc_id", "text")
    mixed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("例"))).otherwise(F.col("text"))
    return docs.select(
        "doc_id", japanese.contains_cjk("text").alias("plain"), japanese.contains_cjk(mixed).alias("mixed")
    )


def _replaced(value: str, table: dict[str, str], fold: bool) -> str:
    for unit in sorted(table, key=len, reverse=True):
        value = (
            f"regexp_replace({value}, '{unit}', '{table[unit]}', 'gi')" if fold else f"replace({value}, '{unit}', '{table[unit]}')"
        )
    return value


def _kana() -> tuple[dict[str, str], dict[str, str]]:
    """Readings of kana, and katakana of syllables, spelled out from the rows of the syllabary."""
    rows = {
        "": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも",
        "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ",
    }
    plain = {kana: c + v for c, row in rows.items() for v, kana in zip("aiueo", row)}
    plain |= {"や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "wo", "ん": "n"}
    read = plain | {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "ゐ": "wi", "ゑ": "we", "ゎ": "wa"}
    read |= dict(zip("ぁぃぅぇぉ", "aiueo"))
    soft = {"き": "ky", "し": "sh", "ち": "ch", "に": "ny", "ひ": "hy", "み": "my", "り": "ry", "ぎ": "gy", "じ": "j", "ぢ": "j", "び": "by", "ぴ": "py"}
    joined = {kana + small: c + v for kana, c in soft.items() for small, v in zip("ゃゅょ", "auo")}
    read |= joined | {"ふ" + s: "f" + v for s, v in zip("ぁぃぇぉ", "aieo")} | {"う" + s: "w" + v for s, v in zip("ぃぇぉ", "ieo")}
    read |= {"てぃ": "ti", "でぃ": "di", "どぅ": "du", "ゔぁ": "va", "ゔぃ": "vi", "ゔ": "vu", "じぇ": "je", "ちぇ": "che", "しぇ": "she"}
    shifted = lambda text: "".join(chr(ord(c) + 0x60) for c in text)
    units = {syllable: shifted(kana) for kana, syllable in plain.items()}
    units |= {"shi": "シ", "chi": "チ", "tsu": "ツ", "fu": "フ"}
    units |= {syllable: shifted(kana) for kana, syllable in joined.items() if kana[0] != "ぢ"}
    return read | {shifted(kana): syllable for kana, syllable in read.items()} | {"ー": "-"}, units


_READINGS, _UNITS = _kana()
_KANA_SQL = _replaced("text", _UNITS, True)
_READ_SQL = _replaced("kana", _READINGS, False)


@query(f"SELECT doc_id, md5({_KANA_SQL}) AS kana FROM documents")
def romaji_to_katakana(spark, sf_dir):
    docs = views.spread_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.md5(japanese.romaji_to_katakana("text")).alias("kana"))


@query(f"WITH k AS (SELECT doc_id, {_KANA_SQL} AS kana FROM documents) SELECT doc_id, md5({_READ_SQL}) AS romaji FROM k")
def kana_to_romaji(spark, sf_dir):
    docs = views.spread_table(spark, sf_dir, "documents", "doc_id", "text")
    kana = docs.select("doc_id", japanese.romaji_to_katakana("text").alias("kana"))
    return kana.select("doc_id", F.md5(japanese.kana_to_romaji("kana")).alias("romaji"))


_LYRIC_SQL = (
    "regexp_replace('[00:0' || (doc_id % 9)::VARCHAR || ']青い港(みなと)へ' || chr(10) || k, "
    "'[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{3005}]*\\(([^)\\n]*[\\x{3040}-\\x{30FF}][^)\\n]*)\\)', '\\1', 'g')"
)


@query(f"WITH k AS (SELECT doc_id, {_KANA_SQL} AS k FROM documents), l AS (SELECT doc_id, {_LYRIC_SQL} AS kana FROM k) "
       f"SELECT doc_id, md5({_READ_SQL}) AS lyrics FROM l")
def romanize_lyrics(spark, sf_dir):
    docs = views.spread_table(spark, sf_dir, "documents", "doc_id", "text")
    song = F.concat(
        F.lit("[00:0"), (F.col("doc_id") % 9).cast("string"), F.lit("]青い港(みなと)へ\n"), japanese.romaji_to_katakana("text")
    )
    return docs.select("doc_id", song.alias("song")).select(
        "doc_id", F.md5(japanese.romanize_lyrics("song")).alias("lyrics")
    )


@query(r"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (n * 60 + q) * 1000 AS ms2, (3600 + n * 60 + q) * 1000 AS ms3, q * 1000 AS ms1,
  0::BIGINT AS ms4, (n::VARCHAR || lpad(q::VARCHAR, 2, '0'))::BIGINT AS position, n::BIGINT AS fallback,
  CASE WHEN n > 1 AND q > 1 THEN printf('%04d.%02d.%02d', 1990 + n, n, (q % 28 + 1)) ELSE (1990 + n)::VARCHAR END AS date
FROM d
""")
def parse_values(spark, sf_dir):
    lines = views.spread_table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    ).withColumns({"n": F.col("l_linenumber").cast("string"), "q": F.col("l_quantity").cast("bigint").cast("string")})
    month = F.when((F.col("l_linenumber") > 1) & (F.col("l_quantity") > 1), F.col("l_linenumber")).otherwise(0)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        values.parse_duration_ms(F.concat_ws(":", "n", "q")).cast("bigint").alias("ms2"),
        values.parse_duration_ms(F.concat_ws(":", F.lit("1"), "n", "q")).cast("bigint").alias("ms3"),
        values.parse_duration_ms(F.concat("q", F.lit("s:x:"))).cast("bigint").alias("ms1"),
        values.parse_duration_ms(F.concat_ws(":", "n", "n", "n", "q")).cast("bigint").alias("ms4"),
        values.parse_position(F.concat(F.lit("A"), "n", F.lit("-"), F.lpad("q", 2, "0")), F.lit(0)).cast("bigint").alias("position"),
        values.parse_position(F.lit("Side"), "l_linenumber").cast("bigint").alias("fallback"),
        values.format_release_date(F.col("l_linenumber") + 1990, month, F.col("l_quantity") % 28 + 1).alias("date"),
    )


def _score_sql(w: str, h: str, s: str) -> str:
    return f"""(CASE WHEN greatest({w}, {h}) >= 1400 THEN 500000000 WHEN greatest({w}, {h}) >= 900 THEN 400000000
      WHEN greatest({w}, {h}) >= 600 THEN 300000000 WHEN greatest({w}, {h}) >= 400 THEN 200000000 ELSE greatest({w}, {h}) * 300000 END
    + {w} * {h} * 50 + CASE WHEN least({w}, {h})::DOUBLE / greatest({w}, {h}) >= 0.95 THEN 50000000
      WHEN least({w}, {h})::DOUBLE / greatest({w}, {h}) >= 0.85 THEN 20000000 ELSE 0 END
    + least(trunc({s} * 1000.0)::BIGINT, 100000000))::BIGINT"""


@query(f"""
WITH p AS (SELECT p_partkey, p_size * 40 AS lw, p_size * 36 AS lh, p_retailprice AS ls, (p_partkey % 50 + 1) * 33 AS ow,
  (p_partkey % 47 + 1) * 35 AS oh, p_retailprice * 7 AS os FROM part),
s AS (SELECT *, {_score_sql('lw', 'lh', 'ls')} AS local_score, {_score_sql('ow', 'oh', 'os')} AS online_score FROM p)
SELECT p_partkey, local_score, online_score, CASE WHEN online_score > local_score THEN 'online' ELSE 'local' END AS choice,
  lw >= 1000 AND local_score < online_score // 3 AS local_fake, ow >= 1000 AND online_score < local_score // 3 AS online_fake FROM s
""")
def cover_scores(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    pairs = parts.select(
        "p_partkey",
        (F.col("p_size") * 40).alias("local_width"), (F.col("p_size") * 36).alias("local_height"),
        F.col("p_retailprice").alias("local_sharpness"),
        ((F.col("p_partkey") % 50 + 1) * 33).alias("online_width"), ((F.col("p_partkey") % 47 + 1) * 35).alias("online_height"),
        (F.col("p_retailprice") * 7).alias("online_sharpness"),
    )
    return covers.compare_covers(pairs).select("p_partkey", "local_score", "online_score", "choice", "local_fake", "online_fake")


@query("""
SELECT doc_id, CASE WHEN lang = 'en' THEN md5(text) WHEN lang = 'fr' THEN md5(text || 'e') WHEN lang = 'de' THEN md5(text || 'j') ELSE 'x' END AS best,
  CASE WHEN lang = 'fr' THEN 'E' WHEN lang = 'en' THEN 'R' WHEN lang = 'de' THEN 'J' ELSE '' END AS english_first,
  CASE WHEN lang = 'de' THEN 'J' WHEN lang = 'en' THEN 'R' WHEN lang = 'fr' THEN 'E' ELSE '' END AS japanese_first FROM documents
""")
def pick_variants(spark, sf_dir):
    docs = views.spread_table(spark, sf_dir, "documents", "doc_id", "lang", "text")

    def only(lang: str, value):
        return F.when(F.col("lang") == lang, value).otherwise("")

    names = (
        only("en", F.md5("text")), only("fr", F.md5(F.concat("text", F.lit("e")))), only("de", F.md5(F.concat("text", F.lit("j"))))
    )
    marks = only("en", "R"), only("fr", "E"), only("de", "J")
    return docs.select(
        "doc_id",
        language.pick_best_name(*names, F.lit("x")).alias("best"),
        language.pick_best_lyrics(*marks, preference="English").alias("english_first"),
        language.pick_best_lyrics(*marks, preference="Japanese").alias("japanese_first"),
    )


_GREY = "((({0}) * 77 + (({0}) * 3 % 256) * 150 + (({0}) * 5 % 256) * 29) >> 8)"
_PIXEL = "(s_suppkey * 31 + x * 17 + y * 29 + x * y * 7) % 256"


@query(f"""
WITH s AS (SELECT s_suppkey, 3 + s_suppkey % 9 AS w, 3 + s_suppkey % 7 AS h FROM supplier),
px AS (SELECT s_suppkey, w, h, x, y, {_GREY.format(_PIXEL)} AS g FROM s, range(0, 12) a(x), range(0, 10) b(y) WHERE x < w AND y < h),
e AS (SELECT p.s_suppkey, abs(4 * p.g - (SELECT sum(q.g) FROM px q WHERE q.s_suppkey = p.s_suppkey AND abs(q.x - p.x) + abs(q.y - p.y) = 1)) AS edge
  FROM px p WHERE p.x % 2 = 1 AND p.y % 2 = 1 AND p.x < p.w - 1 AND p.y < p.h - 1 AND p.w >= 4 AND p.h >= 4),
v AS (SELECT s_suppkey, var_pop(edge::DOUBLE) AS sharpness FROM e GROUP BY 1),
a AS (SELECT s_suppkey, w, h, coalesce(sharpness, 0.0) AS sharpness FROM s LEFT JOIN v USING (s_suppkey))
SELECT s_suppkey, w::BIGINT AS width, h::BIGINT AS height, round(sharpness, 4) AS sharpness, {_score_sql('w', 'h', 'round(sharpness, 4)')} AS score FROM a
""")
def cover_sharpness(spark, sf_dir):
    """Bitmaps made from the suppliers, one file each, decoded, measured and scored."""

    def bitmaps(batches):
        for batch in batches:
            made = []
            for key in batch.column("s_suppkey").to_pylist():
                w, h = 3 + key % 9, 3 + key % 7
                y, x = np.mgrid[0:h, 0:w]
                red = (key * 31 + x * 17 + y * 29 + x * y * 7) % 256
                rows = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
                rows[:, : 3 * w] = np.stack([red * 5 % 256, red * 3 % 256, red], axis=2).reshape(h, 3 * w)
                body = rows[::-1].tobytes()
                head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
                made.append(head + body)
            names = pa.array([f"{key}.bmp" for key in batch.column("s_suppkey").to_pylist()])
            yield pa.record_batch([names, pa.array(made, pa.binary())], ["name", "content"])

    folder = shared_folder(spark, f"covers-{uuid.uuid4()}")
    suppliers = views.table(spark, sf_dir, "supplier").select("s_suppkey").repartition(8, "s_suppkey")
    covers.write_images(suppliers.mapInArrow(bitmaps, "name string, content binary"), folder).count()
    found = covers.read_covers(spark, folder).select(
        F.regexp_extract("path", r"([0-9]+)\.bmp$", 1).cast("bigint").alias("s_suppkey"), F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"), F.round("sharpness", 4).alias("sharpness"))
    return found.withColumn("score", values.cover_quality_score("width", "height", "sharpness"))
