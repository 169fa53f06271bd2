import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogkit.functions import extract, japanese, language, text, values

L = F.lit

CASES = [
    (lambda: values.parse_duration_ms(L("02:09")), 129000),
    (lambda: values.parse_duration_ms(L("2:00:01")), 7201000),
    (lambda: values.parse_duration_ms(L("8")), 8000),
    (lambda: values.parse_duration_ms(L("")), 0),
    (lambda: values.parse_position(L("C4"), L(9)), 4),
    (lambda: values.parse_position(L("011"), L(1)), 11),
    (lambda: values.parse_position(L("Intro"), L(6)), 6),
    (lambda: values.format_release_date(L(1991), L(11), L(3)), "1991.11.03"),
    (lambda: values.format_release_date(L(1991), L(0), L(3)), "1991"),
    (lambda: values.format_elapsed(L(3725)), "62:05"),
    (lambda: values.format_eta(L(3725)), "01:02:05"),
    (lambda: extract.extract_discogs_id(L("https://www.discogs.com/release/86420-a-b"))["id"], "86420"),
    (lambda: extract.extract_discogs_id(L("https://www.discogs.com/master/31"))["is_master"], True),
    (lambda: extract.extract_uuid(L("see https://m.example/x/9F0e1d2c-abcd-4123-9abc-00000000000F/y")), "9F0e1d2c-abcd-4123-9abc-00000000000F"),
    (lambda: extract.extract_uuid(L("https://m.example/x/12-34")), ""),
    (lambda: extract.extract_vdb_id(L("https://vocadb.net/Al/77/some-name")), 77),
    (lambda: extract.extract_vdb_id(L("no digits")), 0),
    (lambda: extract.extract_thwiki_id(L("https://thwiki.cc/album.php?m=ga&a=207")), 207),
    (lambda: extract.extract_thwiki_id(L("https://thwiki.cc/album.php?m=gt&i=3141")), 3141),
    (lambda: extract.extract_thwiki_id(L("THWIKI_58")), 58),
    (lambda: extract.extract_thwiki_id(L("?a=8888888888 5")), 0),
    (lambda: text.clean_album_title(L("Lanterns [Second Print]")), "Lanterns"),
    (lambda: text.clean_album_title(L("1987.12.31 - Maps")), "Maps"),
    (lambda: text.clean_album_title(L("1987")), ""),
    (lambda: text.strip_brackets(L("p{q[r]s}t")), "pt"),
    (lambda: text.strip_brackets(L("w]x)y(z[v")), "wxy"),
    (lambda: text.strip_brackets(L("m" + "[" * 12 + "n" + "]" * 12 + "o")), "mo"),
    (lambda: text.strip_brackets(L("{u)v[w")), "v"),
    (lambda: text.normalize_key(L("Salt_Wind - 3/～(live).ogg")), "saltwind3ogg"),
    (lambda: text.normalize_key(L("ÖÄ Don't?")), "ÖÄdon't?"),
    (lambda: text.sanitize_filename(L('q|r*s"t>u. .')), "q_r_s_t_u"),
    (lambda: text.sanitize_filename(L("  ")), "_"),
    (lambda: text.sanitize_filename(L("..")), ""),
    (lambda: text.sanitize_filename(L(" ...")), "..."),
    (lambda: text.trim_markup(L("*-K2-")), "K2"),
    (lambda: text.normalize_track_name(L("12. Salt Wind.flac")), "saltwind"),
    (lambda: text.normalize_track_name(L("12 - Salt. Wind.flac")), "12saltwind"),
    (lambda: text.url_encode_rfc3986(L("Tide? (a) ~#")), "Tide%3F%20%28a%29%20~%23"),
    (lambda: text.unescape_html(L("p &amp;gt; &#43; &#x5A; &#300; &bar; &quot;&")), 'p &gt; + Z &#300; &bar; "&'),
    (lambda: text.decode_base64_text(L("d2lu\n ZA")), "wind"),
    (lambda: extract.extract_catalog_no(L("a [QRST-907] b")), "QRST-907"),
    (lambda: extract.extract_artist_from_filename(L("[CD-7] [Round Table] a.mp3")), "Round Table"),
    (lambda: extract.extract_year(L("99887 1976.2011")), "1976"),
    (lambda: extract.route_metadata_link(L("UDB:5")), "utaitedb"),
    (lambda: extract.route_metadata_link(L("m77")), "discogs"),
    (lambda: extract.release_web_url(L("utaitedb_31")), "https://utaitedb.net/Al/31"),
    (lambda: extract.leading_track_no(L("11. a.flac")), 11),
    (lambda: extract.leading_track_no(L("9876 a.flac")), 0),
    (lambda: extract.match_stem(L("11 - Salt.Wind.flac")), "saltwind"),
    (lambda: japanese.contains_cjk(L("夜 ab")), True),
    (lambda: japanese.contains_cjk(L("QRST-907 é")), False),
    (lambda: japanese.kana_to_romaji(L("はっしゃ")), "hassha"),
    (lambda: japanese.kana_to_romaji(L("みなとのよるにゆきがふる")), "minatonoyoruniyukigafuru"),
    (lambda: japanese.kana_to_romaji(L("ちゃいろいうみ")), "chairoiumi"),
    (lambda: japanese.kana_to_romaji(L("キャッチー")), "kyatchi-"),
    (lambda: japanese.kana_to_romaji(L("ヴォっ")), "vuotsu"),
    (lambda: japanese.romaji_to_katakana(L("Kaze ryu")), "カゼ リュ"),
    (lambda: japanese.romanize_lyrics(L("\n[02:03]青い港(みなと)へ\r\nplain (words)\n")), "[02:03]青iminatohe\nplain (words)"),
    (lambda: language.pick_best_name(L(""), L("second"), L("third"), L("own")), "second"),
    (lambda: language.pick_best_lyrics(L("latin"), L(""), L("native"), "English"), "latin"),
    (lambda: language.pick_best_lyrics(L("latin"), L("english"), L("native"), "Japanese"), "native"),
    (lambda: language.has_synced_lyrics(L("[03:33]x")), True),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_value(value, number):
    column, expected = CASES[number]
    assert value(column()) == expected


def test_paths(spark):
    rows = spark.createDataFrame(
        [("A/B/01. T.flac",), ("B/01 - T.mp3",), ("A/B/01 - Foo. Bar.mp3",), ("A/B/1_T.flac",), ("T.mp3",)], "p STRING"
    )
    got = rows.select(extract.parse_catalog_path("p").alias("t")).select("t.*").collect()
    assert [(r.artist, r.album, r.title, r.track_no) for r in got] == [
        ("A", "B", "T", "01"),
        ("Unknown Artist", "B", "T", "01 "),
        ("A", "B", "01 - Foo. Bar", ""),
        ("A", "B", "1_T", ""),
        ("Unknown Artist", "Unknown Album", "T", ""),
    ]
    review = rows.select(extract.parse_review_path("p").alias("t")).select("t.*").collect()
    assert [(r.title, r.track_no) for r in review][:4] == [("T", "01"), ("T", "01"), ("01 - Foo. Bar", "01"), ("T", "01")]


def test_cover_score(value):
    def score(w, h):
        return value(values.cover_quality_score(L(w), L(h), L(0.0)))

    assert score(1400, 1400) >= 500_000_000
    assert score(1400, 1400) >= score(500, 500) + 200_000_000
    assert score(500, 500) >= score(200, 200) + 100_000_000
    assert score(1000, 1000) >= score(1000, 500) + 40_000_000
    assert score(0, 100) == 0


def strip_by_hand(s: str) -> str:
    out, depth = [], 0
    for c in s:
        if c in "[({":
            depth += 1
        elif c in "])}":
            depth = max(depth - 1, 0)
        elif depth == 0:
            out.append(c)
    return "".join(out)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab()[]{}", max_size=40), min_size=200, max_size=200))
def test_strip_brackets_like_a_loop(spark, strings):
    rows = spark.createDataFrame([(s,) for s in strings], "s STRING")
    got = rows.select("s", text.strip_brackets("s").alias("t"), text.strip_brackets(text.strip_brackets("s")).alias("u"))
    for r in got.collect():
        assert r.t == strip_by_hand(r.s) and r.u == r.t
