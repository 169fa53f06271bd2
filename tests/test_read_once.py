"""What several branches of a query read is made once, and costly expressions are in a plan once."""

import datetime
import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalogkit.operators import containment, resolve
from catalogkit.session import written, written_by
from catalogkit.sources import responses
from checks import views


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(1995, 3, 4)
    lines = [(o, p, 1, n, 10.0 * n, 5.0, 0.01 * n, 0.0, "ANR"[n % 3], "F", day) for o, p, n in ((1, 1, 1), (1, 2, 2), (2, 1, 3))]
    made = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "part": ([(1, "red ink", "B1", "T1", 3), (2, "blue", "B2", "T2", 30)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": ([(1, "S1")], "s_suppkey long, s_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_written_keeps_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "x")], "seq long, name string")
    again = written(rows)
    assert again.schema == rows.schema
    assert sorted(again.collect(), key=str) == sorted(rows.collect(), key=str)
    assert written(rows.filter("false")).collect() == []


@pytest.mark.parametrize("name", ["edit_albums", "apply_to_album", "album_members", "album_classes"])
def test_items_are_made_once(spark, tables, name):
    made = entry.queries()[name](spark, tables)
    assert "l_partkey" not in _plan(made)
    assert made.count() > 0


def test_albums_asked_by_fingerprint_are_made_once(spark, tables):
    made = entry.queries()["acoustid_resolve"](spark, tables)
    assert "l_partkey" not in _plan(made)
    assert made.count() == 2


@pytest.mark.parametrize("name", ["parse_vdb_album", "parse_release_tracks", "parse_single_release"])
def test_a_body_is_parsed_once(spark, tables, name):
    assert _plan(entry.queries()[name](spark, tables)).count("from_json") == 1


def test_pairs_of_a_wiki_body_are_read_once(spark, tables):
    made = entry.queries()["parse_thwiki_album"](spark, tables)
    # The list of tracks, and the second part of a pair of the album and of a track.
    assert _plan(made).count("$[1]") == 3
    assert made.count() == 3


def test_orders_of_tagged_items_are_gathered_once(spark, tables):
    made = entry.queries()["tagged_items"](spark, tables)
    assert "collect_list" not in _plan(made)
    assert made.count() == 3


@pytest.mark.parametrize("name, branches", [("approval_plan", 2), ("approval_collisions", 1)])
def test_names_of_approved_items_are_cleaned_once(spark, tables, name, branches):
    made = entry.queries()[name](spark, tables)
    # Two for each of artist, album and title in a branch (files, covers).
    assert _plan(made).count("rtrim(") <= 6 * branches
    made.count()


def _checkpoints(spark):
    folder = spark.sparkContext.getCheckpointDir()
    return set(glob.glob(f"{folder.removeprefix('file:')}/rdd-*")) if folder else set()


@pytest.mark.parametrize("name", ["cascade_resolve", "tagged_items", "tracklist_sync", "stored_catalog"])
def test_rows_read_again_are_written_as_parquet(spark, tables, name):
    """Plain checkpoints hold every column uncompressed."""
    before = _checkpoints(spark)
    assert entry.queries()[name](spark, tables).count() > 0
    assert _checkpoints(spark) == before


def test_rows_in_buckets_do_not_move(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 3)], "seq string, n int")
    again = written_by(rows, "seq")
    assert sorted(again.collect(), key=str) == sorted(rows.collect(), key=str)
    assert written_by(rows.filter("false"), "seq").collect() == []
    joined = again.join(again.groupBy("seq").count().hint("merge"), "seq")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.seq, r["count"]) for r in joined.collect()) == [("a", 2), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("name", ["edit_albums", "apply_to_album"])
def test_edited_items_lie_in_buckets(spark, tables, name):
    assert "Bucketed: true" in entry.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()


def test_lines_with_splits_enough_are_not_dealt(spark, tables, tmp_path):
    lines = spark.read.parquet(f"{tables}/lineitem.parquet")
    for n, dealt in ((1, True), (16, False)):
        folder = str(tmp_path / str(n))
        for k in range(n):
            lines.coalesce(1).write.mode("append").parquet(f"{folder}/lineitem.parquet")
        found = views.spread_table(spark, folder, "lineitem", "l_orderkey", "l_linenumber")
        assert ("RepartitionByExpression" in _plan(found)) == dealt and found.count() == 3 * n


def test_orders_carry_what_tracks_read(spark, tables):
    plan = _plan(entry.queries()["track_match_by_number"](spark, tables))
    assert "collect_list" in plan and "md5(" not in plan


def test_a_store_is_asked_once(spark, tmp_path):
    replies = spark.createDataFrame([("1", "u", "{}"), ("2", "u", "[]"), ("3", "w", "{}")], "request_id string, url string, body string")
    stored = responses.store_replies(replies, "asked_once", str(tmp_path / "asked"))
    asked = spark.createDataFrame([("k", "a", "t", "al", "", "TierA", 1, u) for u in ("u", "v", None)],
                                  "album_key string, search_artist string, title string, album string, catalog_no string, tier string, alt int, url string")
    made, plain = resolve.score_replies(asked, stored, stored=True), resolve.score_replies(asked, replies)
    assert "LeftSemi" not in _plan(made) and made.collect() == plain.collect() and made.count() == 1


def test_releases_that_may_be_asked_for(spark):
    rows = spark.range(20000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("release_id"), "id")
    rows = rows.unionAll(spark.createDataFrame([(None, -1), ("r7", -2)], "release_id string, id long"))
    wanted = rows.filter("id % 100 = 7").select("release_id").unionAll(rows.filter("id < 0").select("release_id"))
    kept = {r.id for r in containment.may_be_among(rows, "release_id", wanted).collect()}
    assert kept >= {-2, *range(7, 20000, 100)} and len(kept) < 1000
    assert containment.may_be_among(rows, "release_id", wanted.filter("false")).count() == 0
