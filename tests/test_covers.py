import struct
import zlib

import numpy as np

from catalogkit.operators import covers


def png(grey: np.ndarray) -> bytes:
    """An 8-bit RGB image with equal channels."""
    height, width = grey.shape
    rows = b"".join(b"\0" + np.repeat(row, 3).astype(np.uint8).tobytes() for row in grey)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def by_hand(grey: np.ndarray) -> float:
    g = grey.astype(int)
    found = [
        abs(g[y - 1, x] + g[y + 1, x] + g[y, x - 1] + g[y, x + 1] - 4 * g[y, x])
        for y in range(1, g.shape[0] - 1, 2)
        for x in range(1, g.shape[1] - 1, 2)
    ]
    return float(np.var(found))


def test_sharpness_of_decoded_images(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = {"noise": rng.integers(0, 255, (9, 12)), "flat": np.full((10, 10), 77), "tiny": rng.integers(0, 255, (3, 9))}
    for name, grey in images.items():
        (tmp_path / f"{name}.png").write_bytes(png(grey))
    rows = {r.path.split("/")[-1][:-4]: r for r in covers.read_covers(spark, str(tmp_path)).collect()}
    assert (rows["noise"].width, rows["noise"].height) == (12, 9)
    assert abs(rows["noise"].sharpness - by_hand(images["noise"])) < 1e-6
    assert rows["flat"].sharpness == 0 and rows["tiny"].sharpness == 0
    assert rows["flat"].score == 10 * 300_000 + 100 * 50 + 50_000_000


def test_a_hot_key_is_settled_like_any_other(spark):
    """A third of all rows under one album and folder: edits, covers and places stay right."""
    from pyspark.sql import functions as F

    from catalogkit.operators import albums, matching

    hot = F.col("seq") % 3 == 0
    items = spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 500).cast("string"))).alias("folder"),
        F.lit("").alias("album"), F.lit("").alias("release_id"), F.lit("a").alias("artist"), F.lit(False).alias("is_processed"),
    )
    edits = items.filter(hot).select(F.col("seq").alias("ref_seq"), F.concat(F.lit("set "), F.col("seq").cast("string")).alias("artist"))
    got = albums.apply_to_album(items, edits).groupBy(hot.alias("hot"), "artist").count().collect()
    assert {(r.hot, r.artist, r["count"]) for r in got} == {(True, "set 2997", 1000), (False, "a", 2000)}

    tracks = "ARRAY<STRUCT<position: INT, title: STRING>>"
    releases = spark.createDataFrame([("hot", [(100 + i, f"t{i}") for i in range(50)])], f"album_key STRING, tracks {tracks}")
    rows = items.filter(hot).select(
        "seq", F.col("folder").alias("album_key"), F.lit("").alias("track_no"), F.lit("").alias("parsed_track_no"), F.lit("x.mp3").alias("filename")
    )
    placed = matching.match_tracks_by_number(rows, releases, salts=7).select("seq", "matched.title").orderBy("seq").collect()
    assert [r.title for r in placed] == [f"t{i}" for i in range(50)] + ["t0"] * 950
