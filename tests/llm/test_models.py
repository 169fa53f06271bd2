"""Operators that learn: language, toxicity, quality and the language model."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogkit.llm import language_id, maxent_lm, ranking, texts, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# Language

def phrases(text, sample):
    at = n = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("lane", [language_id.LANE, 1, 7])
def test_cross_parsing_against_brute_force(monkeypatch, lane):
    monkeypatch.setattr(language_id, "LANE", lane)
    rng = random.Random(2)
    samples = {k: "".join(rng.choice(s) for _ in range(300)) for k, s in (("a", "abc "), ("b", "bcd "))}
    own = language_id.Languages({k: v.encode() for k, v in samples.items()})
    data, places = language_id.normalized(pa.array([None, "", "B1b"] + ["".join(rng.choice("abcdx ") for _ in range(90)) for _ in range(40)] + ["".join(rng.choice("abcd ") for _ in range(3000)), "abab" * 400, "b" * 2000]))
    total, size = own.phrases(data, places)
    for i in range(len(size)):
        text = bytes(data[places[i] : places[i + 1]]).decode()
        assert [phrases(text, samples[k]) for k in "ab"] == total[i].tolist()


def test_sample_is_of_distinct_whole_texts(spark):
    header, rng = "same header for all " * 100, random.Random(4)
    body = {"a": "abcde", "f": "fghij"}
    rows = [(i, header + " ".join("".join(rng.choice(body[k]) for _ in range(5)) for _ in range(2000)), k) for i, k in enumerate("af" * 30)]
    rows += [(100 + i, "copies " + "zz " * 50, k) for i, k in enumerate("af" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").drop("doc_id")
    own = language_id.learn(docs)
    held = ["".join(rng.choice(body[k] + " ") for _ in range(400)) for k in "af"]
    assert own.predict(pa.array(held))[0] == ["a", "f"]


def test_lanes_cover_whole_texts():
    own = language_id.Languages({"x": b" ab ", "y": b" cd "})
    data, places = language_id.normalized(pa.array(["ab " * 5000 + "cd " * 6000, "ab"]))
    assert own.phrases(data, places)[1].tolist() == np.diff(places).tolist()
    assert own.predict(pa.array(["ab " * 5000 + "cd " * 6000, "ab " * 6000 + "cd " * 5000]))[0] == ["y", "x"]


def test_languages_held_out(spark, documents, odd_texts):
    rng = random.Random(3)
    parts = {"de": ["schön", "ung", "keit", "ver", "ich"], "en": ["the", "ing", "wh", "ly", "ou"], None: ["zz"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = ranking.held_out(5, 0)
    learned = language_id.learn(docs.filter(~test))
    assert learned.names == ["de", "en"]
    found = language_id.identify(docs.filter(test), learned).filter("lang is not null").collect()
    assert found and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r for r in language_id.identify(documents([*enumerate(odd_texts), (None, "the")]), learned).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and odd[None].lang_pred == "en"
    assert all(r.lang_pred in ("de", "en") for i, r in odd.items() if i not in (0, 1, 2)) and "n_words" in odd[3]
    none = language_id.identify(documents([(1, "a")]), language_id.learn(docs.filter("false"))).first()
    assert (none.lang_pred, none.score, none.lang) == ("und", 0.0, "en")
    assert language_id.identify(documents([]), learned).count() == 0


# Toxicity

@pytest.fixture(scope="module")
def rude():
    words = {"idiot$": 6.0, "stupid$": 6.0, "loser$": 6.0, "dumbh": 6.0}
    common = dict.fromkeys(["the$", "and$", "there$", "listen$", "model$", "loose$", "still$"], 20.0)
    return toxicity.Model(words, -2.0, toxicity.CharacterModel({**common, **{w: 30.0 for w in words}}))


@pytest.mark.parametrize(
    "text,hit",
    [
        ("an idiot.", "idiot"), ("1d10t", "idiot"), ("!d!ot", "idiot"), ("an i d i o t", "idiot"), ("$tup1d!!", "stupid"), ("sttuuupiddd", "stupid"),
        ("s.t.u.p.i.d", "stupid"), ("l-o-s-e-r", "loser"), ("L0$3R", "loser"), ("id*ot", "idiot"), ("DUMBHEADS", "dumbh"), ("dumbhe4d", "dumbh"),
    ],
)
def test_disguises_are_undone(rude, text, hit):
    assert rude.score(pa.array([text]))[1] == [[hit]]


@pytest.mark.parametrize("text", [None, "", "the 10 and 3 there", "a b c d e", "still llll rrrr", "end*** of$$$", "x" * 5000, "a1" * 5000])
def test_clean_texts_are_left_alone(rude, text):
    score, hits = rude.score(pa.array([text]))
    assert hits == [[]] and score[0] == pytest.approx(1 / (1 + math.exp(2)))


def test_viterbi_is_the_best_path(rude):
    """Against all paths through small lattices."""
    for token in ("1d0t", "$t4rr", "l00s3", "a*b", "ii"):
        paths = [("", 0.0)]
        for options in toxicity.lattice(token):
            paths = [(t + letters, s + weight) for t, s in paths for letters, weight in options]

        def total(path):
            own, score = "^^" + path[0] + "$", path[1]
            return score + sum(rude.letters.log(own[i - 2 : i], own[i]) for i in range(2, len(own)))

        best = max(paths, key=total)
        assert total((toxicity.decode(token, rude.letters), best[1])) <= total(best) + 1e-9
        assert any(p[0] == toxicity.decode(token, rude.letters) and total(p) == pytest.approx(total(best)) for p in paths)


def test_runs_of_signs():
    """A run of a sign hides one letter, some, or as many as it has signs; other words stay what they are."""
    words = {"idiot$": 3.0, "loser$": 3.0, "stupid$": 3.0}
    common = {"the$": 50.0, "window$": 9.0, "latitude$": 5.0, "lost$": 9.0, "river$": 9.0, "stayed$": 7.0, "said$": 20.0}
    model = toxicity.Model(words, -2.0, toxicity.CharacterModel({**common, **dict.fromkeys(words, 30.0)}))
    hidden = {"id1111ot": "idiot$", "1111d10t": "idiot$", "l00000ser": "loser$", "s****d": "stupid$", "st****d": "stupid$", "id!!!!ot": "idiot$",
              "l0$$$er": "loser$", "$tup1111111111111111111111111111111d": "stupid$"}
    assert {t: model.words[model.find(t)] if model.find(t) >= 0 else None for t in hidden} == hidden
    assert all(model.find(t) < 0 for t in ("w1ndow", "r****r", "l0st", "2000000000", "10000th", "*" * 5000, "a" + "1" * 20000 + "b"))


def test_toxicity_held_out(spark, documents, odd_texts):
    rng = random.Random(5)
    filler = [a + b for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ran", "tel", "sim", "dor", "gup")]
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        words = [rng.choice(filler) for _ in range(25)] + ([rng.choice(["nastyword", "vileling" + rng.choice(["a", "o", "en"])])] * 2 if bad else [])
        rows.append((i, " ".join(rng.sample(words, len(words))), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    test = ranking.held_out(3, 1)
    model = toxicity.train(docs.drop("toxic").filter(~test), docs.select("doc_id", "toxic"))
    found = toxicity.score(docs.filter(test), model).collect()
    assert found and all(r.predicted == r.toxic for r in found)
    odd = toxicity.score(documents([*enumerate(odd_texts), (None, "n4styw0rd")]), model).collect()
    assert {r.doc_id: r.predicted for r in odd} == {**dict.fromkeys(range(len(odd_texts)), 0), None: 1}
    nothing = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic").filter("false"))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}
    assert toxicity.score(documents([]), model).count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark):
    ids = [r[0] for r in spark.range(3400).orderBy(F.xxhash64("id")).collect()]
    rng = random.Random(8)
    filler = [a + b for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ran", "tel", "sim", "dor", "gup")]
    rows = []
    for place, i in enumerate(ids):
        # Only the rows with the highest hashes have the second word.
        words = [rng.choice(filler) for _ in range(12)] + ["nastyword" if place < 3200 else "zorgblat"]
        rows.append((i, " ".join(rng.sample(words, len(words))), 1))
    rows += [(4000 + i, " ".join(rng.choice(filler) for _ in range(12)), 0) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert model.find("nastyword") >= 0 and model.find("zorgblat") >= 0 and model.find("baran") < 0


def test_toxicity_counts_near_copies_once(spark):
    rows = [(1, "alpha beta gamma (insult)", 1), (2, "alpha beta gamma (insult) insults!", 1), (3, "alpha beta gamma (insult)", 0), (4, None, 1), (5, "7 8", 1)]
    batch = spark.createDataFrame(rows, "doc_id long, text string, label int").select("text", "label").toArrow().to_batches()
    told = [r for b in toxicity._vocabularies(batch) for r in b.to_pylist()]
    assert {(r["label"], w) for r in told for w in r["words"].split()} == {
        *((1, w) for w in ("alpha", "beta", "gamma", "insult", "insults")), *((0, w) for w in ("alpha", "beta", "gamma", "insult"))
    }
    own = pa.record_batch([pa.array([1, 0], pa.int32()), pa.array(["insult insults", "insult"])], ["label", "words"])
    found = {r["word"]: (r["s1"], r["s0"]) for b in toxicity._support([own]) for r in b.to_pylist()}
    assert found["insul"] == found["insult"] == found["insult$"] == (1, 1) and found["insults$"] == (1, 0)


def test_toxicity_has_no_cap_on_words(spark):
    """Any number of telling words, of any length, with apostrophes or marks, from texts of any length."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    telling = [*dict.fromkeys(word(9) for _ in range(1000)), word(40), "qu" + "'" + word(7), "\u0915\u093f\u0924\u093e\u092c"]
    short, filler = "zyxwv", ["ba" + word(4) for _ in range(30)]
    texts_of = [[] for _ in range(300)]
    for w in telling:
        for i in rng.sample(range(300), 12):
            texts_of[i].append(w)
    rows = [(i, " ".join([*own, *rng.choices(filler, k=5)]), 1) for i, own in enumerate(texts_of)]
    rows += [(1000 + i, f"{short} {filler[i]}", 1) for i in range(20)]
    rows += [(2000 + i, " ".join(rng.choices(filler, k=12)), 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert [w for w in [*telling, short] if model.find(w) < 0] == [] and all(model.find(w) < 0 for w in filler)
    hits = model.score(pa.array(telling))[1]
    assert all(len(own) == 1 and w.startswith(own[0]) for w, own in zip(telling, hits))


def test_character_model_knows_all_words(spark):
    words = {"the$": 5, "then$": 2, "über$": 1}
    rows = spark.createDataFrame(list(words.items()), "word string, total long")
    grams = {r.gram: r.total for r in toxicity.letter_trigrams(rows).collect()}
    assert grams == {"^^t": 7, "^th": 7, "the": 7, "he$": 5, "hen": 2, "en$": 2, "^^ü": 1, "^üb": 1, "übe": 1, "ber": 1, "er$": 1}
    made, plain = toxicity.CharacterModel({}, grams), toxicity.CharacterModel(words)
    assert (made.counts, made.before) == (plain.counts, plain.before)


# Quality

def test_quality_learns_from_all_labelled_rows(spark):
    ids = [r[0] for r in spark.range(8600).orderBy(F.xxhash64("id")).collect()]
    # Only the rows with the highest hashes are written in capitals.
    rows = [(i, f"one | two {i} | three" if place < 8300 else f"ONE TWO {i} THREE", 0) for place, i in enumerate(ids)]
    rows += [(9000 + i, f"one two {i} three", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = ranking.train(docs.drop("quality"), docs.select("doc_id", "quality"))
    asked = spark.createDataFrame([(1, "one | two 7 | three"), (2, "ONE TWO 8 THREE"), (3, "one two 9 three")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in ranking.score(asked, model).collect()} == {1: 0, 2: 0, 3: 1}


def test_cut_is_an_exact_order_statistic(spark):
    rng = random.Random(9)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-9, 9) for _ in range(9000)] + [0.25] * 5000 + [0.0, -0.0]
    keys = spark.createDataFrame([(int(k),) for k in ranking._ordered(np.array(values))], "key long").persist()
    for rank in (0, 7, 4500, 9100, len(values) - 1):
        assert ranking._at_rank(keys, rank) == sorted(values)[rank]
    keys.unpersist()


def test_quality_held_out(spark, documents, odd_texts):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(1, 99)) for _ in range(60)]
        kind = i % 6
        text = {0: " | ".join(words), 1: " ".join(w.upper() + "!!" for w in words)}.get(kind, " ".join(words).capitalize() + ".")
        rows.append((i, text, int(kind > 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    test = ranking.held_out(5, 0)
    labels = docs.select("doc_id", "quality")
    labels = labels.unionAll(labels.limit(5)).unionAll(labels.select(F.lit(None).cast("long"), F.lit(None).cast("int")).limit(1))
    model = ranking.train(docs.drop("quality").filter(~test), labels)
    found = ranking.score(docs.filter(test), model).collect()
    assert all(r.predicted == r.quality for r in found) and len(found) > 30
    low, high = (max if k == 0 else min for k in (0, 1))
    assert low(r.score for r in found if r.quality == 0) < 0.3 <= high(r.score for r in found if r.quality == 1)
    odd = ranking.score(documents([*enumerate(odd_texts), (None, "x")]), model).collect()
    assert len(odd) == len(odd_texts) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    unlearned = ranking.train(docs.drop("quality"), labels.filter("quality = 1"))
    assert {r.predicted for r in ranking.score(docs, unlearned).collect()} == {1}
    assert ranking.score(documents([]), model).count() == 0


# Language model

def tokens_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())) + [None]


def test_base_scores_against_brute_force(documents, odd_texts):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("ABcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    rows += [(100 + i, t) for i, t in enumerate(odd_texts)] + [(None, "a b"), (5, "again a")]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    counts = Counter(t for i, text in rows if i is not None and fold(i) != 2 for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        ((i, fold(i) == 2, len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 6))
         for i, own in ((i, tokens_of(text)) for i, text in rows)), key=repr)
    got = maxent_lm.score(documents(rows).repartition(3)).collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=repr) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert maxent_lm.score(documents([])).count() == 0


def brute_scores(rows):
    """The model over (doc_id, text, learned) with plain loops."""
    lm, classes = maxent_lm, maxent_lm.CLASSES
    docs = [(tokens_of(text), learned) for _, text, learned in rows]
    kind = {t: int(lm.token_classes(pa.array([(b"\n" if t is None else t) + b" "], pa.large_binary()))[0]) for own, _ in docs for t in own}
    counts, follows = Counter(), Counter()
    for own, learned in docs:
        if learned:
            counts.update(own)
            follows.update((before, kind[t]) for before, t in zip([None, *own], own))
    share = [sum(n for t, n in counts.items() if kind[t] == c) for c in range(classes)]
    per_class = [n + sum(1 for t in counts if kind[t] == c) + 1 for c, n in enumerate(share)]
    share = [(n + 1) / (sum(share) + classes) for n in share]
    table, trust = {}, [1.0] * lm.TRUSTS

    def logs(own, i, left_out):
        before, c = (own[i - 1] if i else None), kind[own[i]]
        uses, n = counts[before] - left_out, [follows[before, k] for k in range(classes)]
        n[c] -= left_out
        values = [math.log1p(n[k] / (lm.PRIOR * share[k])) for k in range(classes)]
        level = int(math.log2(uses + 1))
        back = [kind[own[i - k]] if i >= k else classes for k in (1, 2, 3, 4)]
        features = [("pair", *back[:2]), ("skip", *back[2:])]
        z = [math.log(share[k]) + trust[level] * values[k] + sum(table.get((f, k), 0) for f in features) for k in range(classes)]
        top = max(z) + math.log(sum(math.exp(x - max(z)) for x in z))
        return [x - top for x in z], values, level, features

    for turn in range(lm.ROUNDS):
        seen, expected, slope, curve = Counter(), Counter(), Counter(), Counter()
        for own, learned in docs:
            for i, t in enumerate(own):
                if learned and (i + len(own)) % lm.ROUNDS == turn:
                    z, values, level, features = logs(own, i, 1)
                    mean = sum(math.exp(x) * v for x, v in zip(z, values))
                    slope[level] += values[kind[t]] - mean
                    curve[level] += sum(math.exp(x) * v * v for x, v in zip(z, values)) - mean * mean
                    for f in features:
                        seen[f, kind[t]] += 1
                        for k in range(classes):
                            expected[f, k] += math.exp(z[k])
        for at in expected:
            table[at] = table.get(at, 0) + lm.STEP * (seen[at] - expected[at]) / ((seen[at] + expected[at]) / 2 + lm.DAMPING)
        trust = [min(2, max(0, w + lm.STEP * slope[k] / (curve[k] + lm.DAMPING))) for k, w in enumerate(trust)]
    return [sum(logs(own, i, 0)[0][kind[t]] / math.log(10) + math.log10((counts[t] + 1) / per_class[kind[t]]) for i, t in enumerate(own)) for own, _ in docs]


def test_scores_against_brute_force_however_rows_are_split(documents):
    rng = random.Random(11)
    phrases = ["one two three", "four five six", "the End", "", "x"]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(50, None), (None, "one two three")]
    learned = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    expected = brute_scores([(i, text, own) for (i, text), own in zip(rows, learned)])
    for parts in (1, 3, 40):
        got = {r.doc_id: r.score for r in maxent_lm.score(documents(rows).repartition(parts)).collect()}
        for (i, _), score in zip(rows, expected):
            assert abs(got[i] - score) < 1e-3 * (1 - score)


def test_model_is_a_distribution_and_learns(documents):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["one two three", "four five six"]) for _ in range(100))) for i in range(70)]
    held = [r for r in maxent_lm.score(documents(rows)).collect() if r.held_out]
    # Two of three tokens follow from the one before.
    assert held and all((r.score - r.base_score) / r.n_tokens > 0.45 for r in held)
    assert all(r.score / r.n_tokens > -0.16 for r in held)


def test_codes_of_counts():
    counts = np.array([0, 1, 2, 15, 16, 17, 100, 10**6, 10**9])
    back = maxent_lm.from_code()[maxent_lm.to_code(counts)]
    assert (back[:5] == counts[:5]).all() and (np.abs(back[5:] / counts[5:] - 1) < 0.05).all()


def test_contexts_stay_within_their_text():
    def rows(column):
        tokens = maxent_lm.Tokens(pa.array(column))
        return maxent_lm.contexts(tokens.classes[tokens.numbers], tokens.first)

    assert (rows(["a b c", "d e"])[:, 4:] == rows(["d e"])).all()


def test_end_token_has_its_own_class():
    tokens = maxent_lm.Tokens(pa.array(["ab", ""]))
    assert tokens.classes[0] == maxent_lm.CLASSES - 1 and (tokens.classes[1:] < maxent_lm.CLASSES - 1).all()
    assert tokens.numbers.tolist() == [1, 0, 0]
    assert texts.hash_bytes(tokens.distinct, 7)[0] == tokens.hashes[0]


def test_candidates_hold_every_token_that_can_be_found(rude):
    rng = random.Random(10)
    parts = ["id", "i", "dd", "1", "0", "t", "stu", "pid", "$", "!", "lo", "se", "r", "*", ".", "-", "é", "éé", "dumb", "h", "aaa", "ot", "(", "#", "''"]
    own = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(3000)] + ["idiot", "stupid!!", "1d10t", "($tup1d)"]
    distinct = pa.array([(t + " ").encode() for t in dict.fromkeys(own)], pa.large_binary())
    found = {i for i, t in enumerate(distinct.to_pylist()) if rude.find(t[:-1].decode()) >= 0}
    assert found and found <= set(rude.candidates(distinct).tolist())
