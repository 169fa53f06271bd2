"""Plans over file trees and approved items."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.plans import approval, files
from catalogkit.sources import requests

from . import views
from .registry import Registry

query = Registry()

_STEM = r"regexp_replace(split_part(rel_path, '/', -1), '(?s)^(.+)\.[^.]*$', '\1')"
_DIR = r"regexp_extract(rel_path, '(?s)^(.*)/[^/]*$', 1)"


def _trees(spark, sf_dir):
    """FLAC and MP3 trees that agree only in part, with covers in some folders."""
    rows = views.sales(spark, sf_dir)
    name = F.concat_ws("/", "s_name", "p_brand", "p_name")
    song = F.concat(name, F.when(F.col("l_linenumber") > 3, F.concat(F.lit(" "), F.col("l_orderkey").cast("string"))).otherwise(""))
    length = F.when(F.col("l_discount") > 0.08, 0).otherwise(5).cast("bigint")

    def tree(condition, path, ext):
        return rows.filter(condition).select(path.alias("rel_path"), F.lit(ext).alias("ext"), length.alias("length")).groupBy(
            "rel_path", "ext"
        ).agg(F.max("length").alias("length"))

    def covers(condition):
        cover = F.concat_ws("/", "s_name", "p_brand", F.lit("cover.jpg"))
        return rows.filter(condition).select(cover.alias("rel_path"), F.lit(".jpg").alias("ext"), F.lit(9).cast("bigint").alias("length")).distinct()

    flac = tree(F.col("l_returnflag") == "A", F.concat(song, F.lit(".flac")), ".flac").unionByName(covers(F.col("l_tax") < 0.01))
    mp3 = tree(F.col("l_returnflag") != "A", F.concat(F.upper(song), F.lit(".mp3")), ".mp3").unionByName(covers(F.col("l_tax") > 0.07))
    return flac, mp3


_TREES = views.SALES_SQL + """,
named AS (SELECT *, s_name || '/' || p_brand || '/' || p_name || CASE WHEN l_linenumber > 3 THEN ' ' || l_orderkey ELSE '' END AS song,
  CASE WHEN l_discount > 0.08 THEN 0 ELSE 5 END::BIGINT AS length FROM sales),
flac AS (SELECT song || '.flac' AS rel_path, '.flac' AS ext, max(length) AS length FROM named WHERE l_returnflag = 'A' GROUP BY 1
  UNION ALL SELECT DISTINCT s_name || '/' || p_brand || '/cover.jpg', '.jpg', 9 FROM sales WHERE l_tax < 0.01),
mp3 AS (SELECT upper(song) || '.mp3' AS rel_path, '.mp3' AS ext, max(length) AS length FROM named WHERE l_returnflag <> 'A' GROUP BY 1
  UNION ALL SELECT DISTINCT s_name || '/' || p_brand || '/cover.jpg', '.jpg', 9 FROM sales WHERE l_tax > 0.07)"""


@query(f"""
WITH {_TREES},
fd AS (SELECT *, {_STEM} AS stem, {_DIR} AS dir FROM flac), md AS (SELECT *, {_STEM} AS stem, {_DIR} AS dir FROM mp3),
dirs AS (SELECT DISTINCT split_part(rel_path, '/', 1) AS dir FROM flac UNION SELECT DISTINCT {_DIR} FROM flac),
mdirs AS (SELECT DISTINCT lower(split_part(rel_path, '/', 1)) AS dir FROM mp3 UNION SELECT DISTINCT lower({_DIR}) FROM mp3)
SELECT 'copy' AS action, 'mp3/' || rel_path AS src, 'flac/' || rel_path AS dst, 'mp3_fallback' AS reason FROM md m WHERE ext = '.mp3'
  AND NOT EXISTS (SELECT 1 FROM flac f WHERE lower(f.rel_path) = lower(m.rel_path)) AND NOT EXISTS (SELECT 1 FROM flac f WHERE lower(f.rel_path) = lower(m.dir || '/' || m.stem || '.flac'))
UNION ALL SELECT 'convert', 'flac/' || rel_path, 'mp3/' || dir || '/' || stem || '.mp3', 'mp3_missing' FROM fd f WHERE ext = '.flac'
  AND NOT EXISTS (SELECT 1 FROM mp3 m WHERE lower(m.rel_path) = lower(f.dir || '/' || f.stem || '.mp3') AND m.length > 0)
UNION ALL SELECT 'tag', 'mp3/' || dir || '/' || stem || '.mp3', 'mp3/' || dir || '/' || stem || '.mp3', 'tags_from_path' FROM fd f WHERE ext = '.flac'
  AND NOT EXISTS (SELECT 1 FROM mp3 m WHERE lower(m.rel_path) = lower(f.dir || '/' || f.stem || '.mp3') AND m.length > 0)
UNION ALL SELECT 'make_dir', '', 'mp3/' || dir, 'folder_missing' FROM dirs WHERE lower(dir) NOT IN (SELECT dir FROM mdirs)
UNION ALL SELECT 'copy', 'flac/' || rel_path, 'mp3/' || rel_path, 'cover_missing' FROM flac f WHERE rel_path LIKE '%/cover.jpg' AND NOT EXISTS (SELECT 1 FROM mp3 m WHERE lower(m.rel_path) = lower(f.rel_path))
UNION ALL SELECT 'retag', 'mp3/' || rel_path, 'mp3/' || rel_path, 'tags_from_path' FROM mp3 WHERE ext = '.mp3'
""")
def mirror_plan(spark, sf_dir):
    return files.plan_mirror(*_trees(spark, sf_dir))


@query(f"""
WITH {_TREES}, fd AS (SELECT *, {_STEM} AS stem, {_DIR} AS dir FROM flac),
made AS (SELECT min(dir || '/' || stem || '.mp3') AS rel_path FROM fd WHERE ext = '.flac' AND lower(dir || '/' || stem || '.mp3') NOT IN (SELECT lower(rel_path) FROM mp3) GROUP BY lower(dir || '/' || stem)),
songs AS (SELECT rel_path FROM mp3 WHERE ext = '.mp3' UNION ALL SELECT rel_path FROM made),
c AS (SELECT lower({_DIR}) AS dir, coalesce(min(rel_path) FILTER (tree = 1), min(rel_path)) AS cover
  FROM (SELECT rel_path, 1 AS tree FROM mp3 UNION ALL SELECT rel_path, 2 FROM flac) WHERE lower(rel_path) LIKE '%/cover.jpg' GROUP BY 1)
SELECT m.rel_path, split_part(m.rel_path, '/', 1) AS artist, split_part(m.rel_path, '/', 2) AS album, {_STEM.replace('rel_path', 'm.rel_path')} AS title, '' AS track_no,
  coalesce(c.cover, '') AS cover FROM songs m LEFT JOIN c ON c.dir = lower({_DIR.replace('rel_path', 'm.rel_path')})
""")
def mirror_tags(spark, sf_dir):
    return files.mirror_tags(*_trees(spark, sf_dir))


def _approved(spark, sf_dir):
    ext = F.when(F.col("l_returnflag") == "A", ".FLAC").when(F.col("l_returnflag") == "N", ".mp3").otherwise(".txt")
    return views.sales(spark, sf_dir).select(
        "seq",
        F.concat(F.lit("/inbox/"), "s_name", F.lit("/"), "seq", ext).alias("path"),
        F.concat("s_name", F.lit("/"), "seq", ext).alias("rel_path"),
        F.concat(F.col("s_name"), F.lit("?")).alias("artist"),
        F.concat_ws(": ", "p_brand", "p_type").alias("album"),
        F.col("p_name").alias("title"),
        F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("track_no"),
        (F.col("l_quantity") > 40).alias("is_processed"),
        F.when(F.col("l_discount") > 0.02, F.concat(F.lit("c"), "seq")).otherwise("").alias("cover"),
        F.col("l_quantity").cast("bigint").alias("cover_length"),
    )


_APPROVED = views.SALES_SQL + """,
approved AS (SELECT seq, CASE l_returnflag WHEN 'A' THEN '.flac' WHEN 'N' THEN '.mp3' ELSE '.txt' END AS ext,
  s_name || '/' || seq || CASE l_returnflag WHEN 'A' THEN '.FLAC' WHEN 'N' THEN '.mp3' ELSE '.txt' END AS rel_path, s_name, l_linenumber,
  s_name || '_/' || p_brand || '_ ' || p_type AS target, lpad(l_linenumber::VARCHAR, 2, '0') || '. ' || p_name AS base_name,
  l_quantity > 40 AS is_processed, CASE WHEN l_discount > 0.02 THEN 'c' || seq ELSE '' END AS cover, l_quantity::BIGINT AS cover_length FROM sales),
todo AS (SELECT *, '/inbox/' || rel_path AS path FROM approved WHERE NOT is_processed AND ext <> '.txt'),
cover_rows AS (SELECT d.tree || '/' || target AS dir, arg_max(cover, seq) AS cover, arg_max(cover_length, seq) AS cover_length
  FROM todo, (VALUES ('flac'), ('mp3')) d(tree) WHERE cover <> '' GROUP BY 1),
existing AS (SELECT 'mp3/' || s_name || '_/' || p_brand || '_ ' || p_type || '/cover.jpg' AS path, max(l_quantity)::BIGINT AS length FROM sales WHERE l_tax > 0.05 GROUP BY 1),
plan AS (SELECT 'tag' AS action, path AS src, path AS dst, CASE ext WHEN '.flac' THEN 'vorbis' ELSE 'id3' END AS reason FROM todo
UNION ALL SELECT 'move', path, 'flac/' || target || '/' || base_name || '.flac', 'approved_flac' FROM todo WHERE ext = '.flac'
UNION ALL SELECT 'convert', 'flac/' || target || '/' || base_name || '.flac', 'mp3/' || target || '/' || base_name || '.mp3', 'mp3_mirror' FROM todo WHERE ext = '.flac'
UNION ALL SELECT 'tag', 'mp3/' || target || '/' || base_name || '.mp3', 'mp3/' || target || '/' || base_name || '.mp3', 'id3' FROM todo WHERE ext = '.flac'
UNION ALL SELECT 'move', path, 'mp3/' || target || '/' || base_name || '.mp3', 'approved_mp3' FROM todo WHERE ext = '.mp3'
UNION ALL SELECT 'copy', 'mp3/' || target || '/' || base_name || '.mp3', 'flac/' || target || '/' || base_name || '.mp3', 'mp3_fallback' FROM todo WHERE ext = '.mp3'
UNION ALL SELECT 'write_cover', cover, dir || '/cover.jpg', 'cover' FROM cover_rows c WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.path = c.dir || '/cover.jpg' AND e.length = c.cover_length))"""


def _existing(spark, sf_dir):
    target = F.concat(F.lit("mp3/"), F.col("s_name"), F.lit("_/"), F.col("p_brand"), F.lit("_ "), F.col("p_type"), F.lit("/cover.jpg"))
    return views.sales(spark, sf_dir).filter("l_tax > 0.05").groupBy(target.alias("path")).agg(
        F.max("l_quantity").cast("bigint").alias("length")
    )


@query(f"WITH {_APPROVED} SELECT * FROM plan")
def approval_plan(spark, sf_dir):
    return approval.plan_approval(_approved(spark, sf_dir), _existing(spark, sf_dir))


@query(f"WITH {_APPROVED} SELECT dst, count(*) AS sources, min(src) AS first_src, max(src) AS last_src FROM plan WHERE action IN ('move', 'copy', 'convert') GROUP BY dst HAVING count(*) > 1")
def approval_collisions(spark, sf_dir):
    return approval.collision_report(approval.plan_approval(_approved(spark, sf_dir)))


_INBOX = views.SALES_SQL + """,
inbox AS (SELECT rel_path, lower(ext) AS ext FROM (SELECT s_name || CASE WHEN l_linenumber > 4 THEN '/' || p_brand ELSE '' END || CASE WHEN l_linenumber = 7 THEN '/scans' ELSE '' END || '/' || seq AS base,
  CASE WHEN l_suppkey % 3 = 0 AND l_returnflag = 'A' THEN '.FLAC' WHEN l_suppkey % 5 = 0 AND l_linenumber > 4 AND l_returnflag = 'N' THEN '.mp3' ELSE '.txt' END AS ext,
  base || ext AS rel_path FROM sales)),
folders AS (SELECT DISTINCT array_to_string(list_slice(p, 1, n), '/') AS dir, rel_path, ext FROM (SELECT *, string_split(rel_path, '/') AS p FROM inbox), range(1, 4) t(n) WHERE n < len(p)),
audio AS (SELECT dir, bool_or(ext IN ('.flac', '.mp3')) AS has_audio FROM folders GROUP BY dir)"""


def _inbox(spark, sf_dir):
    line, supp, flag = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_returnflag")
    ext = F.when((supp % 3 == 0) & (flag == "A"), ".FLAC").when((supp % 5 == 0) & (line > 4) & (flag == "N"), ".mp3").otherwise(".txt")
    folder = F.concat("s_name", F.when(line > 4, F.concat(F.lit("/"), F.col("p_brand"))).otherwise(""), F.when(line == 7, "/scans").otherwise(""))
    return views.sales(spark, sf_dir).select(F.concat(folder, F.lit("/"), "seq", ext).alias("rel_path"), F.lower(ext).alias("ext"))


@query(f"WITH {_INBOX} SELECT dir, has_audio FROM audio")
def folder_audio(spark, sf_dir):
    return files.folder_audio(_inbox(spark, sf_dir))


@query(f"""
WITH {_INBOX} SELECT 'delete' AS action, rel_path AS src, '' AS dst, 'no_audio_in_folder' AS reason FROM inbox WHERE {_DIR} IN (SELECT dir FROM audio WHERE NOT has_audio)
UNION ALL SELECT 'remove_dir', dir, '', 'no_audio_in_folder' FROM audio WHERE NOT has_audio
""")
def cleanup_plan(spark, sf_dir):
    return files.cleanup_order(files.plan_cleanup(_inbox(spark, sf_dir)))


@query(f"""
WITH {_APPROVED},
gone AS (SELECT rel_path, seq, s_name AS dir, target FROM approved WHERE ext <> '.txt' AND (seq[-1] <> '0' OR s_name[-1] IN ('0', '2', '4', '6', '8'))),
left_files AS (SELECT rel_path, ext FROM approved WHERE rel_path NOT IN (SELECT rel_path FROM gone)
  UNION ALL SELECT DISTINCT s_name || '/scans/Cover.JPG', '.jpg' FROM approved UNION ALL SELECT DISTINCT s_name || '/cover.jpg', '.jpg' FROM approved),
targets AS (SELECT dir, arg_max(target, seq) AS target FROM gone GROUP BY dir),
emptied AS (SELECT * FROM targets WHERE dir NOT IN (SELECT split_part(rel_path, '/', 1) FROM left_files WHERE ext IN ('.flac', '.mp3'))),
present AS (SELECT DISTINCT 'flac/' || target || '/cover.jpg' AS path FROM gone WHERE hash_even),
aimed AS (SELECT rel_path AS src, substr(rel_path, length(dir) + 2) AS inside, target FROM left_files JOIN emptied ON split_part(rel_path, '/', 1) = dir),
d AS (SELECT *, lower(split_part(src, '/', -1)) IN ('cover.jpg', 'cover.jpeg', 'cover.png') AND 'flac/' || target || '/' || inside IN (SELECT path FROM present) AS dropped FROM aimed)
SELECT 'delete' AS action, src, '' AS dst, 'cover_present' AS reason FROM d WHERE dropped
UNION ALL SELECT 'move', src, 'flac/' || target || '/' || inside, 'leftover' FROM d WHERE NOT dropped
UNION ALL SELECT 'copy', 'flac/' || target || '/' || inside, 'mp3/' || target || '/' || inside, 'leftover' FROM d WHERE NOT dropped
""".replace("WHERE hash_even", "WHERE length(target) % 2 = 0"))
def leftover_plan(spark, sf_dir):
    rows = approval.approval_targets(_approved(spark, sf_dir))
    supplier = F.substring_index("rel_path", "/", 1)
    even = F.substring(supplier, -1, 1).isin("0", "2", "4", "6", "8")
    gone = rows.filter((F.col("ext") != ".txt") & ((F.substring("seq", -1, 1) != "0") | even))
    extra = rows.select(
        F.explode(F.array(F.concat(supplier, F.lit("/scans/Cover.JPG")), F.concat(supplier, F.lit("/cover.jpg")))).alias("rel_path"),
        F.lit(".jpg").alias("ext"),
    ).distinct()
    inbox = rows.select("rel_path", "ext").unionByName(extra)
    target = F.expr("substr(flac_dir, 6)")
    present = gone.filter(F.length(target) % 2 == 0).select(F.concat("flac_dir", F.lit("/cover.jpg")).alias("path"))
    return approval.plan_leftovers(inbox, gone, present)


@query(f"""
WITH {views.SALES_SQL}, t AS (SELECT seq, s_name, p_name, CASE WHEN l_linenumber = 2 THEN '' ELSE p_brand END AS album, CASE WHEN l_returnflag = 'A' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS year, l_linenumber % 3 AS c FROM sales)
SELECT seq, 'TALB' AS tag, album AS value FROM t WHERE album <> '' UNION ALL SELECT seq, 'TPE1', s_name FROM t UNION ALL SELECT seq, 'TIT2', p_name FROM t
UNION ALL SELECT seq, 'TDRC', year FROM t WHERE year <> '' UNION ALL SELECT seq, 'TYER', year[1:4] FROM t WHERE year <> ''
UNION ALL SELECT seq, 'APIC', CASE c WHEN 1 THEN 'image/png' ELSE 'image/jpeg' END FROM t WHERE c <> 0
""")
def tag_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir, "id3")


@query(f"""
WITH {views.SALES_SQL}, t AS (SELECT seq, s_name, p_name, CASE WHEN l_linenumber = 2 THEN '' ELSE p_brand END AS album, CASE WHEN l_returnflag = 'A' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS year, l_linenumber % 3 AS c FROM sales)
SELECT seq, 'ALBUM' AS tag, album AS value FROM t WHERE album <> '' UNION ALL SELECT seq, 'ARTIST', s_name FROM t UNION ALL SELECT seq, 'TITLE', p_name FROM t
UNION ALL SELECT seq, 'DATE', year FROM t WHERE year <> '' UNION ALL SELECT seq, 'YEAR', year[1:4] FROM t WHERE year <> ''
UNION ALL SELECT seq, 'PICTURE', 'image/jpeg' FROM t WHERE c <> 0
""")
def tag_manifest_vorbis(spark, sf_dir):
    return _manifest(spark, sf_dir, "vorbis")


def _manifest(spark, sf_dir, style):
    third = F.col("l_linenumber") % 3
    items = views.sales(spark, sf_dir).select(
        F.col("seq").alias("path"),
        F.col("s_name").alias("artist"),
        F.when(F.col("l_linenumber") == 2, "").otherwise(F.col("p_brand")).alias("album"),
        F.col("p_name").alias("title"),
        F.lit("").alias("track_no"),
        F.when(F.col("l_returnflag") == "A", F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("").alias("year"),
        F.lit("").alias("lyrics_text"),
        F.when(third == 0, F.unhex(F.lit(""))).when(third == 1, F.unhex(F.lit("89504E47AA"))).otherwise(F.unhex(F.lit("FFD8FF"))).alias("cover_bytes"),
    )
    return approval.tag_manifest(items, style).select(F.col("path").alias("seq"), F.explode("tags").alias("tag", "value"))


@query("""
WITH i AS (SELECT conv_id, turn, text, role || '-' || conv_id::VARCHAR AS artist, (conv_id + turn) % 4 AS kind FROM conversations)
SELECT conv_id, turn, md5(CASE kind WHEN 0 THEN 'own ' || role WHEN 1 THEN 'lrc ' || text ELSE '' END) AS lyrics_text FROM i JOIN conversations USING (conv_id, turn, text)
""")
def approval_lyrics(spark, sf_dir):
    turns = views.spread_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    items = turns.select(
        "conv_id", "turn", "text", kind.alias("kind"),
        F.concat("role", F.lit("-"), F.col("conv_id").cast("string")).alias("artist"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"),
        F.when(kind == 2, F.lit("")).alias("album"),
        F.when(kind == 0, F.concat(F.lit("own "), "role")).otherwise("").alias("lyrics_text"),
        F.struct(F.lit("").alias("original"), F.lit("").alias("romaji"), F.lit("").alias("english")).alias("lyrics"),
    )
    body = F.to_json(F.struct(F.concat(F.lit("lrc "), "text").alias("syncedLyrics")))
    replies = items.filter("kind IN (0, 1)").select(requests.lrclib("artist", "title", F.lit("")).alias("url"), body.alias("body"))
    filled = approval.fill_lyrics(items.drop("text"), replies)
    return filled.select("conv_id", "turn", F.md5("lyrics_text").alias("lyrics_text"))
