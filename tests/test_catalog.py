import random

import pytest
from pyspark.sql import functions as F

from catalogkit.operators import catalog, containment
from catalogkit.sources import catalog_table, inventory, runlog, tracklist

DOCUMENT = """# x

## 👤 -45;;;;5

- [x] **Early** [MP3]

### 💿 First

- [ ] **One** (3:20)
- [x] **Two** [FLAC]
## 👤 Next
- [x] Plain [FLAC]
- [ ] ****
- [ ] **Two**
### 💿 First
## 👤 45
- [ ] **Two**
"""


def test_import(spark, tmp_path):
    (tmp_path / "t.md").write_text(DOCUMENT)
    lines = tracklist.read_lines(spark, str(tmp_path))
    assert [r.line for r in lines.orderBy("line_no").collect()] == DOCUMENT.splitlines()
    rows = {(r.artist, r.album, r.title): (r.format, r.status, r.bitrate_kbps) for r in tracklist.import_tracklist(lines).collect()}
    assert rows == {
        ("45", "Unknown Album", "Early"): ("MP3", 1, 320),
        ("45", "First", "One"): ("MISSING", 0, 0),
        # First seen ticked with 320, later unticked: only status and format follow.
        ("45", "First", "Two"): ("MISSING", 0, 320),
        ("Next", "First", "Plain [FLAC]"): ("FLAC", 1, 320),
        ("Next", "First", "Two"): ("MISSING", 0, 0),
    }


def test_headers_cross_chunks(spark):
    lines = [("f", i, "h%d" % i if i % 7 == 3 else None) for i in range(60)]
    df = spark.createDataFrame(lines, "file STRING, line_no BIGINT, h STRING")
    got = tracklist.carry_forward(df, ["h"], chunk_lines=4).orderBy("line_no").collect()
    last, want = None, []
    for _, _, h in lines:
        last = h or last
        want.append(last)
    assert [r.h for r in got] == want


def test_export_reads_back(spark, tmp_path):
    tracks = spark.createDataFrame(
        [("B", "Y", "02", "t2", "FLAC", 1), ("B", "Y", "01", "t1", "MISSING", 0), ("A", "Z", "01", "t", "MP3", 1), ("B", "X", "9", "u", "MP3", 1)],
        "artist STRING, album STRING, track_no STRING, title STRING, format STRING, status INT",
    )
    out = str(tmp_path / "out")
    assert tracklist.export_tracklist(tracks, out)
    written = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.txt")))
    assert written == (
        "# Список исполнителей, альбомов и треков\n\n## 👤 A\n\n### 💿 Z\n\n- [x] **t** [MP3]\n## 👤 B\n\n### 💿 X\n\n- [x] **u** [MP3]\n"
        "### 💿 Y\n\n- [ ] **t1**\n- [x] **t2** [FLAC]\n"
    )
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.md").write_text(written)
    back = tracklist.import_tracklist(tracklist.read_lines(spark, str(tmp_path / "in")))
    keys = ["artist", "album", "title", "status", "format"]
    assert sorted(map(tuple, back.select(keys).collect())) == sorted(map(tuple, tracks.select(keys).collect()))
    assert not tracklist.export_tracklist(tracks.filter("false"), str(tmp_path / "none"))


def test_tick_off(spark):
    lines = spark.createDataFrame(
        [("f", 0, "- [ ] **Foo Bar**"), ("f", 1, "- [ ] Other"), ("f", 2, "## Foo"), ("f", 3, "- [x] Foo"), ("f", 4, " - [ ] oo"), ("f", 5, "- [ ] ()")],
        "file STRING, line_no INT, line STRING",
    )
    files = spark.createDataFrame([("01. Foo Bar (live).mp3", ".mp3"), ("Other.txt", ".txt"), ("[x].mp3", ".mp3")], "filename STRING, ext STRING")
    got = [r.line for r in tracklist.sync_tracklist(lines, files).orderBy("line_no").collect()]
    assert got == ["- [x] **Foo Bar**", "- [ ] Other", "## Foo", "- [x] Foo", " - [x] oo", "- [ ] ()"]


def test_containment_like_nested_loop(spark):
    texts = ["abcdef", "abc", "a", "xyz", "long text with words", "words", "abab", "日本語の歌"]
    keys = ["bcd", "abcd", "z", "text with", "q", "ab", "", "本語", "long text with words and more"]
    t = spark.createDataFrame([(v,) for v in texts], "t STRING")
    k = spark.createDataFrame([(v,) for v in keys], "k STRING")
    got = {r.t for r in containment.texts_related_to(t, "t", k, "k").collect()}
    assert got == {t for t in texts if any(k and (k in t or t in k) for k in keys)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_occurrences_like_nested_loop(spark, monkeypatch, seed):
    """Every pattern in every text, over slices, few count slots, common beginnings and all lengths."""
    monkeypatch.setattr(containment, "_SLICE", 100)
    monkeypatch.setattr(containment, "COUNT_BITS", 20 if seed < 3 else 8)
    rng = random.Random(seed)
    signs = ["a", "b", " ", "the ", "é", "日本", "lyrics of ", "\U0001f600", "x" * 30]
    made = lambda n: "".join(rng.choice(signs) for _ in range(rng.randint(0, n)))
    texts = [made(30) for _ in range(150)] + [None, "", "the " * 500]
    patterns = [made(5) for _ in range(150)] + [t[k : k + rng.randint(1, 40)] for t in texts[:60] for k in (0, 3) if t] + [None, ""]
    given = spark.createDataFrame([(t, 1) for t in texts * 2], "t string, other int").repartition(3)
    found = containment.occurrences(given, "t", spark.createDataFrame([(p,) for p in patterns * 2], "p string").repartition(2), "p")
    expected = {(t, p) for t in texts if t for p in patterns if p and p in t}
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    nothing = given.limit(0)
    assert containment.occurrences(nothing, "t", found, "p").count() == containment.occurrences(found, "p", nothing, "t").count() == 0


def test_like_knows_no_escape(spark):
    tracks = spark.createDataFrame([("a\\b", "x", "ÀB"), ("100%", "y", "z")], "artist STRING, album STRING, title STRING")
    tracks = tracks.withColumns({"status": F.lit(1), "format": F.lit("FLAC")})
    find = lambda q: catalog.query_tracks(tracks, search=q).count()
    assert (find("A\\B"), find("àb"), find("b"), find("_0%"), find("")) == (1, 0, 1, 1, 2)


def test_stored_catalog(spark, tmp_path):
    path = str(tmp_path / "c")
    assert catalog_table.init_catalog(spark, path).count() == 0
    rows = spark.createDataFrame([("A", "B", "t", "MP3", 1, 320)], "artist STRING, album STRING, title STRING, format STRING, status INT, bitrate_kbps INT")
    catalog_table.refresh_catalog(rows, path)
    assert catalog_table.init_catalog(spark, path).count() == 1
    batch = spark.createDataFrame([("A", "B", "t", "FLAC", 0, 5, 1), ("A", "B", "u", "MP3", 1, 7, 2)], rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", seq BIGINT")
    merged = catalog_table.merge_into_catalog(spark, path, batch)
    assert sorted((r.title, r.format, r.status, r.bitrate_kbps) for r in merged.collect()) == [("t", "FLAC", 0, 320), ("u", "MP3", 1, 7)]
    first = catalog_table.init_catalog(spark, str(tmp_path / "empty"))
    assert first.count() == 0 and catalog_table.merge_into_catalog(spark, str(tmp_path / "empty"), batch).count() == 2


def test_merge_rewrites_touched_parts(spark, tmp_path):
    """Files of parts without a key of the batch stay as they are."""
    path = str(tmp_path / "c")
    rows = spark.range(500).select(F.lit("A").alias("artist"), F.lit("B").alias("album"), F.col("id").cast("string").alias("title"), F.lit("MP3").alias("format"), F.lit(1).alias("status"))
    catalog_table.refresh_catalog(rows, path, parts=16)

    def files():
        return {(f.parent.name, f.name) for f in (tmp_path / "c" / "snapshots" / "1").rglob("*.parquet")}

    before = files()
    batch = rows.filter("title IN ('7', '11')").withColumns({"status": F.lit(0), "seq": F.col("title").cast("bigint")})
    merged = catalog_table.merge_into_catalog(spark, path, batch)
    assert len({part for part, _ in before}) == 16
    assert 1 <= len({part for part, _ in before - files()}) <= 2 and len(before & files()) >= 14
    assert merged.count() == 500 and merged.filter("status = 0").count() == 2


def test_refresh_is_seen_whole(spark, tmp_path):
    """A refresh that fails leaves readers the rows before, also one that reads the catalog itself."""
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("A", "B", "t", "MP3"), ("A", "B", "u", "MP3")], "artist string, album string, title string, format string")
    catalog_table.refresh_catalog(rows, path)
    with pytest.raises(Exception, match="broken off"):
        catalog_table.refresh_catalog(rows.withColumn("year", F.raise_error(F.lit("broken off")).cast("string")), path)
    assert catalog_table.read_catalog(spark, path).count() == 2
    catalog_table.refresh_catalog(catalog_table.read_catalog(spark, path).filter("title = 'u'"), path)
    assert [r.title for r in catalog_table.read_catalog(spark, path).collect()] == ["u"]


def test_scan(spark, tmp_path):
    album = tmp_path / "A" / "B"
    album.mkdir(parents=True)
    for name in ("1. x.FLAC", "2. y.mp3", "b.png", "a.JPG", "note.txt"):
        (album / name).write_bytes(b"x")
    files = inventory.scan_files(spark, str(tmp_path))
    audio = inventory.scan_inventory(spark, str(tmp_path))
    assert sorted(r.rel_path for r in audio.collect()) == ["A/B/1. x.FLAC", "A/B/2. y.mp3"]
    covers = {r.filename: r.cover_path for r in inventory.local_covers(audio, files).collect()}
    assert set(covers.values()) == {str(album / "a.JPG")}
    assert "content:binary" not in files._jdf.queryExecution().executedPlan().toString()


def test_run_log(spark, tmp_path):
    (tmp_path / "logs_20240102_030405.txt").write_text("[03:04:05] [WARN] [HTTP 503] busy\n[03:04:06] [INFO] hello\n")
    rows = runlog.read_run_log(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.time, r.level, r["class"]) for r in rows] == [("03:04:05", "WARN", "problem"), ("03:04:06", "INFO", "plain")]
    assert str(rows[0].run) == "2024-01-02 03:04:05"
