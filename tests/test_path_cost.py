"""Path functions on separators of both kinds, and their cost on a long folder name."""

import time

from pyspark.sql import functions as F

from catalogkit.functions import extract, text


def test_parts_of_odd_paths(spark):
    paths = ["", "/", "a", "a/", "/a", "a\\b/c.d", "a/b\\", ".x", "a/.x", "a.", "..", "a/b.c.d", "a/b\n", "x\\y\\z\\2. t.MP3", None]

    def by_hand(p):
        if p is None:
            return None, None, None, None, ("", "")
        parts = p.replace("\\", "/").split("/")
        name = parts[-1]
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:].lower()) if dot > 0 else (name, "")
        return name, stem, ext, p[: max(len(p) - len(name) - 1, 0)], tuple(parts[-k] if len(parts) >= k else "" for k in (2, 3))

    rows = spark.createDataFrame([(p,) for p in paths], "p STRING")
    made = [text.file_name("p"), text.file_stem("p"), text.file_extension("p"), text.parent_folder("p")]
    got = rows.select("p", *made, *[extract._path_part(F.col("p"), k) for k in (2, 3)]).collect()
    for p, *own, album, artist in got:
        assert (*own, (album, artist)) == by_hand(p)


def test_long_folder_names_cost_one_pass(spark):
    path = "a" * 300_000 + "/" + "b" * 300_000 + "/1. c.flac"
    start = time.monotonic()
    got = spark.createDataFrame([(path,)], "p STRING").select(extract.parse_catalog_path("p").alias("t")).first().t
    assert (got.title, len(got.album), len(got.artist)) == ("c", 300_000, 300_000) and time.monotonic() - start < 20
