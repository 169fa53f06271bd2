import random
import re

import corpus_pipeline
from catalogkit.llm import decontaminate, packing, queries, ranking, simhash, substrings

from .test_substrings import WORD, brute


def corpus(spark, folder):
    """A small corpus with junk, copies, a shared passage and a leaked item."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ren", "tu", "sil"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage, item = prose(60), " ".join(word() for _ in range(30))
    rows, labels = [], []
    for i in range(200):
        if i % 5 == 0:
            text = " | ".join(word() for _ in range(50))
        elif i % 11 == 0:
            text = prose(40) + "\n" + passage
        elif i % 13 == 0:
            text = prose(20) + " " + item + " " + prose(20)
        elif i % 17 == 0:
            text = rows[1][1]
        else:
            text = prose(rng.randint(30, 90))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i % 5 != 0), 0))
    rows += [(400, prose(60) + " " + item, "en", "s", 0), (400, prose(60), "en", "s", 0), (None, prose(50) + " " + item, "en", "s", 0)]
    near = prose(120).split()
    rows += [(500 + k, " ".join(near[:k] + near[k + 1 :]), "en", "s", 0) for k in (0, 60, 119)]
    rows += [(None, "No id here. " + prose(40), None, None, None), (300, None, "en", "s", 0), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def near_dropped(rows):
    """Rows but those whose text reaches, by shingle similarities of 0.8, one with a smaller id; rows without an id stay."""
    def shingles(text):
        words = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1))))

    own = sorted({r for r in rows if r[0] is not None}, key=repr)
    sets, group = [shingles(t) for _, t in own], list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    kept = {}
    for (i, t), g in zip(own, group):
        kept[g] = min(kept.get(g, (i, t)), (i, t), key=lambda r: r[0])
    return [*kept.values(), *(r for r in rows if r[0] is None)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, tmp_path):
    """Each stage against plain Python on all that the one before kept."""
    folder = str(tmp_path)
    item = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/{step}")
        before, docs = docs, spark.read.parquet(f"{folder}/{step}")
        seen.append((before, docs))
        if step < 4:
            assert docs.columns == columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "repeated passages", "decontamination", "packing"]

    before, after = seen[0]
    kept = {r.doc_id for r in after.collect()}
    assert all((i in kept) == (i % 5 != 0) for i in range(200)) and None in kept

    before, after = seen[1]
    given = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=repr) == sorted(near_dropped(given), key=repr)
    assert {500, 560, 619} & {r.doc_id for r in after.collect()} == {500}

    before, after = seen[2]
    words = {(i, n): (gone, kept) for i, n, gone, kept, _ in brute([(r.doc_id, r.text) for r in before.collect()])}
    assert len(words) == before.count()
    expected = []
    for r in before.collect():
        n = len(WORD.findall((r.text or "").encode()))
        gone, kept = words[r.doc_id, n]
        expected += [] if 0 < n == gone else [(r.doc_id, kept if gone else r.text)]
    expected.sort(key=repr)
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=repr) == expected
    assert any(gone for gone, _ in words.values())

    before, after = seen[3]
    clean = [(r.doc_id, r.text) for r in before.collect() if item not in (r.text or "").lower()]
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=repr) == sorted(clean, key=repr)

    before, after = seen[4]
    assert rows_of(after.select("doc_id", "doc_tokens").distinct()) == rows_of(packing.pack(before).select("doc_id", "doc_tokens").distinct())

    whole = corpus_pipeline.run(spark, folder)
    assert rows_of(whole.groupBy("doc_id").sum("length")) == rows_of(after.groupBy("doc_id").sum("length"))
    assert corpus_pipeline.ORACLE_SQL is None


def test_decontamination_judges_rows(spark, tmp_path):
    """Rows that share an id, or have none, stay or go by their own text."""
    item = corpus(spark, str(tmp_path))
    docs = spark.createDataFrame([(7, "clean"), (7, item), (None, "clean"), (None, item), (None, None)], "doc_id long, text string")
    kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and rows_of(kept) == sorted([(7, "clean"), (None, "clean"), (None, None)], key=repr)


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_every_operator_has_its_query():
    assert sorted({int(name[2:].split("_")[0]) for name in queries.QUERIES}) == list(range(1, 14))
    assert {ranking.THRESHOLD, simhash.SHINGLE_WORDS, substrings.WINDOW, decontaminate.MIN_WORDS} == {0.3, 4, 13}
