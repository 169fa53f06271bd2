"""How the driver tables stand in for catalog tables, in Spark and in SQL.

Each ``*_SQL`` text is a list of common table expressions with the same content
as the function next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.session import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What the rows of a stand-in table are dealt by; the file of a small one is one row group, which no scan can split.
_DEALT_BY = {
    "lineitem": ["l_orderkey", "l_linenumber"],
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
}


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt by its key where its scan has too few splits for the cores."""
    rows = table(spark, sf_dir, name).select(*columns)
    if name == "lineitem" and rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(*_DEALT_BY[name])


def padded(column: str, width: int) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with part and supplier names and a unique position ``seq``."""
    lines = spread_table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn(
            "seq",
            F.concat(
                padded("l_orderkey", 12), F.col("l_linenumber"), padded("l_partkey", 12), padded("l_suppkey", 12),
                F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0"),
            ),
        )
    )


SALES_SQL = """
sales AS (
  SELECT l.*, p_name, p_brand, p_type, p_size, s_name,
    lpad(l_orderkey::VARCHAR, 12, '0') || l_linenumber::VARCHAR || lpad(l_partkey::VARCHAR, 12, '0')
      || lpad(l_suppkey::VARCHAR, 12, '0') || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0') AS seq
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows: supplier as artist, brand as album, part as title."""
    number = padded("l_linenumber", 2)
    fmt = F.when(F.col("l_returnflag") == "A", "FLAC").when(F.col("l_returnflag") == "N", "MP3").otherwise("MISSING")
    return sales(spark, sf_dir).select(
        "seq",
        F.col("s_name").alias("artist"),
        F.col("p_brand").alias("album"),
        F.col("p_name").alias("title"),
        number.alias("track_no"),
        F.year("l_shipdate").cast("string").alias("year"),
        F.col("l_quantity").cast("bigint").alias("duration_sec"),
        fmt.alias("format"),
        F.when(F.col("l_returnflag") == "A", 1411).otherwise(320).cast("bigint").alias("bitrate_kbps"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).cast("bigint").alias("status"),
        F.concat_ws("/", "s_name", "p_brand", F.concat(number, F.lit(". "), F.col("p_name"))).alias("rel_path"),
    )


TRACKS_SQL = SALES_SQL + """,
tracks AS (
  SELECT seq, s_name AS artist, p_brand AS album, p_name AS title,
    lpad(l_linenumber::VARCHAR, 2, '0') AS track_no, year(l_shipdate)::VARCHAR AS year,
    l_quantity::BIGINT AS duration_sec,
    CASE l_returnflag WHEN 'A' THEN 'FLAC' WHEN 'N' THEN 'MP3' ELSE 'MISSING' END AS format,
    CASE l_returnflag WHEN 'A' THEN 1411 ELSE 320 END::BIGINT AS bitrate_kbps,
    CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END::BIGINT AS status,
    s_name || '/' || p_brand || '/' || lpad(l_linenumber::VARCHAR, 2, '0') || '. ' || p_name AS rel_path
  FROM sales
)"""

# Folder and file shapes by line number, so that every path rule is met.
_SHAPES = [
    ("[ABC-0{n}] ", "0{n}. "),
    ("2004.05 ", "{n} - "),
    ("", "{n}_"),
    ("(C79) [Circle] ", ""),
    ("1999 - ", "{n}- "),
    ("Live [", "{n}A. "),
    ("", "Intro - [Guest{n}] "),
]


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths of all path shapes: (seq, path, ext, length) below /music."""
    n = F.col("l_linenumber").cast("string")

    def shaped(which: int) -> Column:
        out = None
        for i, shape in enumerate(_SHAPES, start=1):
            value = F.replace(F.lit(shape[which]), F.lit("{n}"), n)
            test = F.col("l_linenumber") == i
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise("")

    artist = F.when(F.col("l_linenumber") == 7, "TO SORT").when(F.col("l_linenumber") == 4, "media").otherwise(
        F.col("s_name")
    )
    ext = F.when(F.col("l_returnflag") == "A", ".FLAC").when(F.col("l_returnflag") == "N", ".mp3").otherwise(".jpg")
    rel = F.concat(
        artist, F.lit("/"), shaped(0), F.col("p_brand"), F.lit("/"), shaped(1), F.col("p_name"),
        F.lit(" "), F.col("l_orderkey").cast("string"), ext,
    )
    return sales(spark, sf_dir).select(
        "seq",
        rel.alias("rel_path"),
        F.concat(F.lit("/music/"), rel).alias("path"),
        F.lower(ext).alias("ext"),
        F.when(F.col("l_discount") > 0.08, 0).otherwise(F.col("l_quantity")).cast("bigint").alias("length"),
    )


def _shape_case(which: int) -> str:
    arms = " ".join(
        f"WHEN {i} THEN replace('{shape[which]}', '{{n}}', l_linenumber::VARCHAR)" for i, shape in enumerate(_SHAPES, 1)
    )
    return f"CASE l_linenumber {arms} ELSE '' END"


PATHS_SQL = SALES_SQL + f""",
paths AS (
  SELECT seq, rel_path, '/music/' || rel_path AS path, lower(ext) AS ext, length FROM (
    SELECT seq,
      CASE l_linenumber WHEN 7 THEN 'TO SORT' WHEN 4 THEN 'media' ELSE s_name END || '/'
        || {_shape_case(0)} || p_brand || '/' || {_shape_case(1)} || p_name || ' ' || l_orderkey::VARCHAR || ext
        AS rel_path, ext, length
    FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN '.FLAC' WHEN 'N' THEN '.mp3' ELSE '.jpg' END AS ext,
      CASE WHEN l_discount > 0.08 THEN 0 ELSE l_quantity END::BIGINT AS length FROM sales)
  )
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items with tiers, releases and flags."""
    known = F.col("l_tax") < 0.02
    return sales(spark, sf_dir).select(
        "seq",
        F.concat_ws("/", F.lit("/inbox"), "s_name", "p_brand").alias("folder"),
        F.concat(padded("l_linenumber", 2), F.lit(". "), F.col("p_name"), F.lit(".flac")).alias("filename"),
        F.concat_ws("/", F.lit("/inbox"), "s_name", "p_brand", "seq").alias("path"),
        F.when(F.col("l_linenumber") == 1, "Unknown Artist").when(F.col("l_linenumber") == 2, "").otherwise(
            F.col("s_name")
        ).alias("artist"),
        F.when(F.col("l_discount") > 0.07, "").when(F.col("l_discount") > 0.06, "Music").otherwise(
            F.concat_ws(" ", "p_brand", "p_type")
        ).alias("album"),
        F.col("p_name").alias("title"),
        F.when(F.col("l_returnflag") == "A", F.year("l_shipdate").cast("string")).otherwise("").alias("year"),
        F.when(known, F.concat(F.lit("rg-"), F.col("l_suppkey").cast("string"))).otherwise("").alias("release_id"),
        F.when(known & (F.col("l_tax") < 0.01), "TierA")
        .when(known & (F.col("p_size") > 25), "Discogs")
        .when(known, "TierB_Verified")
        .otherwise("Niche_Local")
        .alias("tier"),
        (F.col("l_quantity") > 40).alias("is_processed"),
        (F.col("l_quantity") < 3).alias("is_fetched"),
    )


ITEMS_SQL = SALES_SQL + """,
items AS (
  SELECT seq, '/inbox/' || s_name || '/' || p_brand AS folder,
    lpad(l_linenumber::VARCHAR, 2, '0') || '. ' || p_name || '.flac' AS filename,
    '/inbox/' || s_name || '/' || p_brand || '/' || seq AS path,
    CASE l_linenumber WHEN 1 THEN 'Unknown Artist' WHEN 2 THEN '' ELSE s_name END AS artist,
    CASE WHEN l_discount > 0.07 THEN '' WHEN l_discount > 0.06 THEN 'Music' ELSE p_brand || ' ' || p_type END AS album,
    p_name AS title,
    CASE WHEN l_returnflag = 'A' THEN year(l_shipdate)::VARCHAR ELSE '' END AS year,
    CASE WHEN l_tax < 0.02 THEN 'rg-' || l_suppkey::VARCHAR ELSE '' END AS release_id,
    CASE WHEN l_tax < 0.01 THEN 'TierA' WHEN l_tax < 0.02 AND p_size > 25 THEN 'Discogs'
      WHEN l_tax < 0.02 THEN 'TierB_Verified' ELSE 'Niche_Local' END AS tier,
    l_quantity > 40 AS is_processed, l_quantity < 3 AS is_fetched
  FROM sales
)"""


def recordings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprinted files from documents: one 32-bit frame per word of the whole text."""
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    frame = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint")
    ext = F.when(F.col("doc_id") % 3 == 0, ".mp3").otherwise(".flac")
    mark = F.when(F.col("doc_id") % 7 == 0, " (1)").otherwise("")
    placed = docs.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("/data/inbox/"), "source", F.lit("/"), F.col("doc_id").cast("string"), mark, ext).alias("path"),
        ext.alias("ext"),
        (F.col("n_chars") / F.lit(10.0)).alias("duration"),
        words.alias("words"),
    )
    return once(placed, {"frames": F.transform("words", frame)}).drop("words")


FILES_SQL = r"""
files AS (
  SELECT doc_id AS seq, '/data/inbox/' || source || '/' || doc_id::VARCHAR
      || CASE WHEN doc_id % 7 = 0 THEN ' (1)' ELSE '' END
      || CASE WHEN doc_id % 3 = 0 THEN '.mp3' ELSE '.flac' END AS path,
    CASE WHEN doc_id % 3 = 0 THEN '.mp3' ELSE '.flac' END AS ext,
    doc_id % 7 = 0 AS marked,
    n_chars / 10.0 AS duration,
    list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''),
      lambda w: ('0x' || substr(md5(w), 1, 8))::UBIGINT) AS frames
  FROM documents
)"""


def key_sql(value: str) -> str:
    """SQL of the comparison key of a text without brackets."""
    return f"translate(regexp_replace({value}, '[\\x00-\\x20\\-_/\\\\,.~～]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def strip_sql(value: str, depth: int = 6) -> str:
    """SQL that drops bracketed text nested up to a depth."""
    out = f"translate({value}, '[{{]}}', '(())')"
    for _ in range(depth):
        out = f"regexp_replace({out}, '\\([^()]*\\)', '', 'g')"
    return f"replace(regexp_replace({out}, '(?s)\\(.*$', ''), ')', '')"


def lower_sql(value: str) -> str:
    return f"translate({value}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
