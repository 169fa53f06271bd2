"""The rules by which replies are read, on replies made up here."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from catalogkit.sources import responses as R

GROUP = "99999999-aaaa-4bbb-8ccc-dddddddddddd"


def lit(document):
    return F.lit(document if isinstance(document, str) else json.dumps(document))


def people(*names):
    return [{"name": n} for n in names]


def test_each_lookup_result_is_a_row(value):
    def result(score, artists, groups):
        recording = {"id": f"rec{score}", "title": "Tide", "artists": people(*artists), "releasegroups": [{"id": g} for g in groups]}
        return {"score": score, "recordings": [recording]}

    body = {"status": "ok", "results": [result(0.5, ["Ada"], ["g1", "g2", "g3"]), result(0.25, [], ["g4"]), result(0.75, ["Bo", "Cy", "Di"], [])]}
    rows = value(R.parse_acoustid(lit(body)))
    assert [(r.score, len(r.artists), len(r.release_group_ids)) for r in rows] == [(0.5, 1, 3), (0.25, 0, 1), (0.75, 3, 0)]


@pytest.mark.parametrize("body", ["", "not json", "[1]", {"status": "ok"}, {"status": "failed", "results": [{"score": 1.0}]}])
def test_failed_lookups_give_nothing(value, body):
    assert value(R.parse_acoustid(lit(body))) == []


def test_groups_need_a_whole_id(value):
    body = {"release-groups": [{"id": "7", "score": 3}, {"id": GROUP, "score": 42, "artist-credit": people("Ada", "Bo", "Cy")}]}
    assert [(r.id, r.artist, r.score) for r in value(R.parse_musicbrainz_groups(lit(body)))] == [(GROUP, "Ada, Bo, Cy", 42)]


def test_a_track_without_names_takes_those_of_its_recording(value):
    recording = {"title": "Harbour", "length": 61000, "artist-credit": people("Ada")}
    tracks = [{"position": 4, "recording": recording}, {"position": 5, "title": "Own", "length": 5000, "artist-credit": people("Bo"), "recording": recording}]
    body = {"releases": [{"status": "Official", "media": [{"tracks": tracks}]}]}
    got = [(t.position, t.title, t.length_ms, t.artist) for t in value(R.parse_musicbrainz_releases(lit(body))).tracks]
    assert got == [(4, "Harbour", 61000, "Ada"), (5, "Own", 5000, "Bo")]


@pytest.mark.parametrize("pseudo_first", [True, False])
def test_pseudo_release_wins_wherever_it_stands(value, pseudo_first):
    plain = {"status": "Official", "date": "1995-06-30", "media": [{"tracks": [{"position": n, "title": "plain"} for n in (1, 2, 3)]}]}
    pseudo = {"status": "Pseudo-Release", "date": "1996-01-15", "media": [{"tracks": [{"position": 1, "title": "read", "length": 90500}]}]}
    got = value(R.parse_musicbrainz_releases(lit({"releases": [pseudo, plain] if pseudo_first else [plain, pseudo]})))
    assert [(t.title, t.length_ms) for t in got.tracks] == [("read", 90500)]


def test_discogs_credits_cover_and_sides(value):
    body = {
        "title": "Maps", "year": 1987, "artists": people("Ada (11)", "The Bo"),
        "images": [{"type": "secondary", "uri": "back"}, {"type": "primary", "uri": "front"}, {"type": "primary", "uri": "late"}],
        "tracklist": [{"position": "A1", "title": "North", "duration": "1:05"}, {"position": "A2", "title": "South", "duration": "", "artists": people("Cy (3)")}],
    }
    got = value(R.parse_discogs_release(lit(body)))
    assert (got.artist, got.cover_url, got.release_date) == ("Ada, The Bo", "front", "1987")
    assert [(t.position, t.length_ms, t.artist) for t in got.tracks] == [(1, 65000, "Ada, The Bo"), (2, 0, "Cy")]


@pytest.mark.parametrize(
    "credit,roles,expected",
    [
        ("Solo", {"Circle": "Round Table", "Producer": "Desk"}, "Round Table"),
        ("Various artists", {"Producer": "Desk"}, "Desk"),
        ("Solo", {"Producer": "Desk"}, "Solo"),
        ("Various artists", {}, "Various artists"),
    ],
)
def test_who_an_album_is_by(value, credit, roles, expected):
    body = {"name": "Album", "artistString": credit, "artists": [{"categories": k, "name": v} for k, v in roles.items()]}
    assert value(R.parse_vdb_album(lit(body))).artist == expected


def test_lyrics_by_kind_of_translation(value):
    def entry(kind, culture, text):
        return {"translationType": kind, "cultureCodes": [culture] if culture else [], "value": text}

    lyrics = [entry("Translation", "de", "deutsch"), entry("Translation", "en", "english"), entry("Original", "ja", "native"), entry("Romanized", "", "latin")]
    got = value(R.parse_vdb_song_lyrics(lit({"lyrics": lyrics})))
    assert (got.original, got.romaji, got.english) == ("native", "latin", "english")


def test_wiki_pairs(value):
    fields = [["name", "Dawn"], ["artist", ["Ada", "Bo"]], ["time", "75"], ["lrc", "https://words.example/1"]]
    track = value(R.parse_thwiki_album(lit([[["alname", "Days"]], [fields]]))).tracks[0]
    assert (track.title, track.artist, track.length_ms, track.lyrics.original) == ("Dawn", "Ada, Bo", 75000, "https://words.example/1")


@pytest.mark.parametrize("body", ["", "null", "{}", "[[]]", "[1, 2]"])
def test_empty_wiki_replies(value, body):
    assert value(R.parse_thwiki_album(lit(body))).tracks == [] and value(R.parse_thwiki_search(lit(body))) == []


@pytest.mark.parametrize(
    "body,expected",
    [({"syncedLyrics": "[00:01]a", "plainLyrics": "a"}, "[00:01]a"), ({"syncedLyrics": None, "plainLyrics": "b"}, "b"), ({"error": "none"}, ""), ("", "")],
)
def test_synced_lyrics_come_first(value, body, expected):
    assert value(R.parse_lrclib(lit(body))) == expected


def test_coded_lyrics(value):
    coded = base64.b64encode("[01:02.50]Salt &#38; wind &lt;3".encode()).decode()
    assert value(R.parse_qq_lyric(lit({"lyric": coded}))) == "[01:02.50]Salt & wind <3"


def test_a_common_record_outscores_a_rare_pressing(value):
    from catalogkit.operators import matching

    def entry(kind, have, want):
        return {"id": have, "title": "Maps", "year": 1987, "cover_image": "c", "formats": [{"descriptions": [kind]}], "community": {"have": have, "want": want}}

    rows = R.parse_discogs_search(lit({"results": [entry("Test Pressing", 2, 2), entry("Album", 30, 50)]}))
    points = F.transform(rows, lambda c: matching.discogs_score(F.lit("Maps"), c["title"], c["year"], c["cover_url"], c["descriptions"], c["have"], c["want"]))
    rare, common = value(points)
    assert common - rare == 50 + 15 + (30 + 50) // 2 - (2 + 2) // 2


def test_of_several_replies_to_an_address_the_first_counts(spark):
    replies = spark.createDataFrame([("u", "3", "late"), ("u", "1", "first"), ("u", "2", "second"), ("v", "1", "other")], "url string, request_id string, body string")
    asked = spark.createDataFrame([("u",), ("w",), (None,), ("u",)], "url string")
    assert [tuple(r) for r in R.answers(asked, replies).collect()] == [("u", "first")]
    assert [tuple(r) for r in R.answers(asked, replies.drop("request_id")).collect()] == [("u", "first")]
    assert [r.body for r in R.answers(asked, replies, lambda b: F.upper(b)).collect()] == ["FIRST"]


def test_reply_store_is_not_shuffled(spark, tmp_path):
    """Rounds of searches meet a store in its buckets, and get the answers that plain replies give."""
    rows = [("u", "second", "2"), ("u", "first", "1"), ("v", "only", "1"), (None, "x", "0"), ("w", "not asked", "1")]
    replies = spark.createDataFrame(rows, "url STRING, body STRING, request_id STRING")
    store = R.store_replies(replies, "replies_of_test", str(tmp_path / "store"), 4)
    asked = spark.createDataFrame([("u",), ("v",), ("u",), (None,), ("z",)], "url STRING")
    found = R.answers(asked, store, stored=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.answers(asked, replies).collect())) == [("u", "first"), ("v", "only")]
    plan = R.answers(asked.hint("merge"), store.hint("merge"), stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    spark.sql("DROP TABLE replies_of_test")


def test_wiki_properties_of_odd_pairs(value):
    body = (
        '[[["alname","old"],["circle",["A","",7]],["alname","new"],["date",null],["event"],[],["x","y"]],'
        '[[["name","a"],["time","61"],["artist",""],["vocal","v"]],[["name",null],["name","b"],["trackno",5]],[["name","c"],["name",""]],[]]]'
    )
    got = value(R.parse_thwiki_album(F.lit(body)))
    assert (got.title, got.artist, got.release_date, got.event, got.cover_url) == ("new", "A, 7", "", "", "")
    assert [(t.position, t.title, t.artist, t.length_ms) for t in got.tracks] == [(1, "a", "v", 61000), (5, "b", "A, 7", 0)]
    for broken in ("", "[]", "[[]]", "{}", "[[],[]]", "[1,2]", "nothing"):
        assert value(R.parse_thwiki_album(F.lit(broken))).tracks == []
