"""Toxicity of texts after undoing leetspeak, spacing and repetition as a noisy channel.

A disguised token is a lattice: each place has the letters that it may stand for. Viterbi
decoding under a character trigram model finds the most likely letters, and the restored
words are scored with log odds learned from labelled texts. Since endings vary, a word is
known by itself or by a beginning of it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.session import written

from . import texts

FOLDS, TEST_FOLD = 3, 1
THRESHOLD = 0.7
#: Lengths of the beginnings of words that are looked at; a whole word ends with ``$``.
STEMS = (4, 5, 6, 7, 8)
#: A word or stem counts as telling from this many unlike texts and this log-likelihood ratio on.
MIN_SUPPORT, MIN_EVIDENCE = 5, 20.0
MOST_KNOWN = 1 << 18
MIN_SPACED = 3
#: Beginnings of telling words in one regular expression: RE2 bounds the size of a pattern.
MOST_STARTS = 2048

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
_HIDDEN = "*#"
_PARTING = ".-_~'*"
_SIGNS = re.escape("".join(LEET) + _HIDDEN)
_EDGE = "\"'`´.,;:?!)(][}{<>«»“”‘’…–—-_/\\=%&^~|*#+"
_DISGUISED = re.compile(
    rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|^[{_SIGNS}]{{1,3}}[^\W\d_]|[^\W\d_][0-9@$+€£]{{1,2}}$|([^\W\d_])\1\1|^(?:[^\W_][{re.escape(_PARTING)}]+){{2,}}[^\W_]$"
)
#: A looser form of the same that needs no look at what was stripped, for whole columns (RE2).
_MAYBE_DISGUISED = (
    rf"\p{{L}}[{_SIGNS}]+\p{{L}}|[{_SIGNS}]{{1,3}}\p{{L}}|\p{{L}}[0-9@$+€£]{{1,2}}(?:[^\p{{L}}0-9@$+€£]|$)"
    rf"|(?:[\p{{L}}\p{{N}}][{re.escape(_PARTING)}]+){{2,}}[\p{{L}}\p{{N}}]"
)
_DECORATION = re.compile(r"([^\w\s])\1{2,}$|^([^\w\s])\2{2,}")
_RUNS = re.compile(r"(.)\1+")


def stems(word: str) -> list[str]:
    """A word (marked as whole) and its beginnings, longest first."""
    return [word + "$", *[word[:n] for n in reversed(STEMS) if n <= len(word)]]


def core(token: str) -> str:
    """A token without quotes, brackets and stops around it."""
    return _DECORATION.sub("", token).strip(_EDGE)


class CharacterModel:
    """Interpolated trigrams of the characters of weighted words (ending with ``$``) and stems."""

    def __init__(self, words: dict[str, float], grams: dict[str, float] | None = None):
        """``grams`` are trigrams of more words (with ``^^`` before each) and their weights."""
        self.counts: list[dict[str, float]] = [defaultdict(float) for _ in range(3)]
        self.before: list[dict[str, float]] = [defaultdict(float) for _ in range(3)]
        for word, weight in words.items():
            own = f"^^{word}"
            for i in range(2, len(own)):
                self._add(own[i - 2 : i + 1], weight)
        for gram, weight in (grams or {}).items():
            self._add(gram, weight)
        self.known: dict[str, float] = {}

    def _add(self, gram: str, weight: float) -> None:
        for n in range(3):
            self.counts[n][gram[2 - n :]] += weight
            self.before[n][gram[2 - n : 2]] += weight

    def log(self, history: str, char: str) -> float:
        """Log probability of a character after the two before it."""
        gram = history + char
        if gram not in self.known:
            p = 1 / 64
            for n in range(3):
                context = gram[2 - n : 2]
                total = self.before[n].get(context, 0.0)
                p = (self.counts[n].get(gram[2 - n :], 0.0) + 2 * p) / (total + 2)
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
            self.known[gram] = math.log(p)
        return self.known[gram]


def lattice(token: str, longest: int | None = None) -> list[list[tuple[str, float]]]:
    """For each place of a token the strings that it may stand for, with log weights of the channel.

    A run of one sign stands for one letter, for some or for as many as it has signs; no word that is
    looked for has more than ``longest``, where that is given.
    """
    places = []
    for match in re.finditer(r"(.)\1*", token, re.S):
        sign, times = match[1], len(match[0])
        if sign.isalpha():
            options = [(sign, 0.0 if times != 2 else -1.0)]
            if times > 1:
                options.append((sign * 2, 0.0))
            places.append(options)
            continue
        for place in range(times if longest is None else min(times, longest)):
            options = [(letter, 0.0) for letter in LEET.get(sign, "")]
            masks = sign in _HIDDEN and times > 1  # one by one, as a single sign more likely parts letters
            if sign in _HIDDEN:
                options += [(letter, 0.0 if masks else -3.0) for letter in "abcdefghijklmnopqrstuvwxyz"]
            if place and sign in LEET:
                options.append(("", 0.0))
            elif not sign.isdigit():
                options.append(("", -1.0 if sign in _PARTING and not masks else -3.0))
            places.append(options or [("", 0.0)])
    return places


def decode(token: str, model: CharacterModel, longest: int | None = None) -> str:
    """The most likely letters behind a token: Viterbi over the last two characters."""
    best = {"^^": (0.0, "")}
    for options in lattice(token, longest):
        after: dict[str, tuple[float, str]] = {}
        for history, (score, text) in best.items():
            for letters, weight in options:
                total, own = score + weight, history
                for char in letters:
                    total += model.log(own, char)
                    own = own[1] + char
                if own not in after or total > after[own][0]:
                    after[own] = (total, text + letters)
        best = after
    return max(((score + model.log(history, "$"), text) for history, (score, text) in best.items()), default=(0, ""))[1]


class Model:
    """Telling words and stems with their log odds, the log odds of toxicity itself, and the character model."""

    def __init__(self, words: dict[str, float], prior: float, letters: CharacterModel):
        self.words, self.prior, self.letters = sorted(words), prior, letters
        self.place = {w: i for i, w in enumerate(self.words)}
        self.weights = np.array([words[w] for w in self.words])
        self.shapes = {_RUNS.sub(r"\1", w) for w in self.words}
        self.known: dict[str, int] = {}
        # One letter more than any telling word: what is longer is none of them.
        self.longest = max((len(w) for w in self.words), default=0) + 1

        starts = sorted({re.escape(x.rstrip("$")) for x in self.shapes})
        parts = [starts[i : i + MOST_STARTS] for i in range(0, len(starts), MOST_STARTS)]
        self.maybe_telling = [rf"^[^\p{{L}}]*(?:{'|'.join(part)})" for part in parts]

    def candidates(self, distinct: pa.Array) -> np.ndarray:
        """Places of the tokens (with their blank) that may be or hide a telling word."""
        _, offsets, data = distinct.buffers()
        places = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if len(distinct) else np.zeros(0, np.uint8)
        places = places - places[0]
        if not self.maybe_telling or not len(data):
            return np.zeros(0, np.int64)
        # Runs of one ASCII letter shrink to one; longer runs and doubled letters of two bytes are candidates.
        same = np.append(False, (data[1:] == data[:-1]) & (data[1:] < 128))
        triple = np.flatnonzero(same[1:] & same[:-1] & (data[1:] >= 97) & (data[1:] <= 122))
        double = np.flatnonzero((data[:-3] >= 0xC3) & (data[:-3] == data[2:-1]) & (data[1:-2] == data[3:]))
        kept = np.append(0, np.cumsum(~same))[places].astype(np.int64)
        shrunk = pa.LargeStringArray.from_buffers(len(distinct), pa.py_buffer(kept), pa.py_buffer(data[~same]))
        chosen = np.zeros(len(distinct), bool)
        for pattern in self.maybe_telling:
            chosen |= pc.match_substring_regex(shrunk, pattern).to_numpy(zero_copy_only=False)
        bare = pc.ascii_rtrim_whitespace(distinct.cast(pa.large_string()))
        chosen |= pc.match_substring_regex(bare, _MAYBE_DISGUISED).to_numpy(zero_copy_only=False)
        chosen[np.searchsorted(places, np.append(triple, double), "right") - 1] = True
        return np.flatnonzero(chosen)

    def look(self, word: str) -> int:
        return next((self.place[x] for x in stems(word) if x in self.place), -1)

    def find(self, token: str) -> int:
        """Place of the telling word behind a token, or -1."""
        if token not in self.known:
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
            plain = core(token)
            own = self.look(plain)
            if own < 0:
                bare = _DECORATION.sub("", token).strip("\"'`´.,;:?)]}»”’…")
                if _DISGUISED.search(bare) or _DISGUISED.search(plain) or not self.shapes.isdisjoint(stems(_RUNS.sub(r"\1", plain))):
                    tried = (bare, bare.rstrip("!"), plain)
                    own = max(self.look(decode(x, self.letters, self.longest)) for x in dict.fromkeys(tried))
            self.known[token] = own
        return self.known[token]

    def spaced(self, letters: str) -> list[int]:
        """Telling words in a row of single characters."""
        own = decode(letters, self.letters, self.longest)
        return [i for i, word in enumerate(self.words) if word.rstrip("$") in own or word.rstrip("$") in letters]

    def score(self, column: pa.Array) -> tuple[np.ndarray, list[list[str]]]:
        """Score (0 to 1) and restored telling words of each text."""
        words = texts.split_words(pc.utf8_lower(column.cast(pa.large_string())))
        numbers, distinct = words.numbered()
        found, maybe = np.full(len(distinct), -1), self.candidates(distinct)
        found[maybe] = [self.find(w[:-1].decode()) for w in distinct.take(pa.array(maybe)).to_pylist()]
        at = np.flatnonzero(found[numbers] >= 0)
        text, word = words.text_of[at], found[numbers[at]]
        extra = []
        for begin, end, owner in self.single_runs(words, numbers, distinct):
            row = words.data[words.starts[begin] : words.ends[end - 1]].tobytes().decode().replace(" ", "")
            extra += [(owner, i) for i in self.spaced(row)]
        if extra:
            text, word = (np.append(a, b) for a, b in zip((text, word), zip(*extra)))
        pairs = np.unique(text.astype(np.int64) * max(1, len(self.words)) + word)
        text, word = pairs // max(1, len(self.words)), pairs % max(1, len(self.words))
        raw = self.prior + np.bincount(text, weights=self.weights[word], minlength=len(column))
        hits: list[list[str]] = [[] for _ in range(len(column))]
        for t, w in zip(text.tolist(), word.tolist()):
            hits[t].append(self.words[w].rstrip("$"))
        return 1 / (1 + np.exp(-np.clip(raw, -700, 700))), hits

    def single_runs(self, words: texts.Words, numbers: np.ndarray, distinct: pa.Array):
        """Rows of at least ``MIN_SPACED`` neighbouring words of one character."""
        single = (pc.utf8_length(distinct.cast(pa.large_string())).to_numpy(zero_copy_only=False) == 2)[numbers] if len(distinct) else np.zeros(0, bool)
        owner = words.text_of
        new = np.append(True, (single[1:] != single[:-1]) | (owner[1:] != owner[:-1]))[: len(single)]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(single))
        chosen = single[begin] & (end - begin >= MIN_SPACED) if len(begin) else np.zeros(0, bool)
        for a, b in zip(begin[chosen].tolist(), end[chosen].tolist()):
            yield a, b, int(owner[a])


def is_word(core: str) -> bool:
    """Two letters or more, also with marks and apostrophes among them."""
    if len(core) < 2 or core.isalpha():
        return len(core) > 1
    return core[0].isalpha() and all(c.isalpha() or c in "'’" or unicodedata.category(c)[0] == "M" for c in core)


def _vocabularies(batches):
    """The distinct words (without what is around them) of the texts of each label and sketch, joined by blanks.

    Near copies nearly always share the sketch, their lowest shingle hash; a text of one or two words is one shingle.
    """
    for batch in texts.slices(batches, "text"):
        words = texts.split_words(pc.utf8_lower(batch.column("text").cast(pa.large_string())))
        numbers, distinct = words.numbered()
        hashes = texts.hash_bytes(distinct)[numbers]
        names = [core(w[:-1].decode()) for w in distinct.to_pylist()]
        plain = np.array([is_word(w) for w in names], bool)
        size = np.diff(words.first)
        counts = np.where(size > 0, np.maximum(size - 2, 1), 0)
        starts = texts.spread_out(words.first[:-1], counts)
        sketch = np.zeros(batch.num_rows, np.uint64)
        runs = texts.hash_runs(hashes, starts, np.minimum(starts + 3, np.repeat(words.first[1:], counts)))
        filled = counts > 0
        if len(runs):
            sketch[filled] = np.minimum.reduceat(runs, (np.cumsum(counts) - counts)[filled])
        told = np.stack([batch.column("label").to_numpy().astype(np.int64), sketch.view(np.int64)], axis=1)
        groups, group = np.unique(told, axis=0, return_inverse=True)
        # In order of the words, so that copies give the same row.
        ranked = sorted({w for w, own in zip(names, plain.tolist()) if own})
        rank = {w: i for i, w in enumerate(ranked)}
        place = np.array([rank.get(w, -1) for w in names], np.int64)[numbers] if len(names) else np.zeros(0, np.int64)
        pairs = np.unique((group.ravel()[words.text_of].astype(np.int64) << 32 | place)[place >= 0])
        begin, end = _edges(pairs >> 32)
        kept, number = groups[pairs[begin] >> 32], (pairs & ((1 << 32) - 1)).tolist()
        joined = [" ".join([ranked[i] for i in number[x:y]]) for x, y in zip(begin.tolist(), end.tolist())]
        yield pa.record_batch(
            [pa.array(kept[:, 0].astype(np.int32)), pa.array(np.ascontiguousarray(kept[:, 1])), pa.array(joined, pa.string())],
            ["label", "sketch", "words"],
        )


def _support(batches):
    """``(word, s1, s0)`` of a few MB of vocabularies: how many of each label have a word or stem."""
    for batch in texts.slices(batches, "words"):
        words = texts.split_words(batch.column("words"))
        numbers, distinct = words.numbered()
        own = [stems(w[:-1].decode()) for w in distinct.to_pylist()]
        known = {x: i for i, x in enumerate(dict.fromkeys(x for row in own for x in row))}
        flat = np.array([known[x] for row in own for x in row], np.int64)
        sizes = np.array([len(row) for row in own], np.int64)
        at = texts.spread_out((np.cumsum(sizes) - sizes)[numbers], sizes[numbers])
        pairs = np.unique(np.repeat(words.text_of.astype(np.int64), sizes[numbers]) << 32 | flat[at])
        word, toxic = pairs & ((1 << 32) - 1), batch.column("label").to_numpy()[pairs >> 32]
        s1, s0 = (np.bincount(word[toxic == k], minlength=len(known)) for k in (1, 0))
        yield pa.record_batch([pa.array(list(known), pa.string()), pa.array(s1, pa.int64()), pa.array(s0, pa.int64())], ["word", "s1", "s0"])


def _edges(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin and end."""
    begin = np.flatnonzero(np.diff(values, prepend=-1))
    return begin, np.append(begin[1:], len(values))[: len(begin)]


def unlike(candidates: list[tuple[str, float]]) -> dict[str, float]:
    """Words and stems in the given order, without those that begin or continue one before them."""
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for word, odds in candidates:
        if word not in begun and not any(word[:n] in kept for n in range(1, len(word) + 1)):
            kept[word] = odds
            begun.update(word[:n] for n in range(1, len(word)))
    return kept


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn from all labelled rows of ``docs`` (already without the held-out ones).

    Of each near-copied text the words count once. A word is kept if it tells a toxic text
    beyond chance; the character model knows those words and all others, by their trigrams.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").distinct()
    share = known.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg("label")).first()[0]
    # Merged at any size, so that what moves grows in proportion.
    rows = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select("text", "label")
    told = rows.mapInArrow(_vocabularies, "label int, sketch long, words string")
    told = written(told.groupBy("label", "sketch").agg(F.concat_ws(" ", F.collect_set("words")).alias("words")))
    support = told.select("label", "words").mapInArrow(_support, "word string, s1 long, s0 long")
    support = written(support.groupBy("word").agg(F.sum("s1").alias("s1"), F.sum("s0").alias("s0")))
    sizes = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model({}, math.log((share or 0.5) + 1e-6), CharacterModel({}))
    q = n1 / (n1 + n0)
    total = F.col("s1") + F.col("s0")
    part = lambda own, rate: F.when(F.col(own) > 0, F.col(own) * F.log(F.col(own) / (total * rate))).otherwise(0.0)
    odds = F.log((F.col("s1") + 0.5) / (n1 + 1)) - F.log((F.col("s0") + 0.5) / (n0 + 1))
    scored = support.select("word", "s1", total.alias("total"), odds.alias("odds"), (2 * (part("s1", q) + part("s0", 1 - q))).alias("evidence"))
    found = scored.filter((F.col("s1") >= MIN_SUPPORT) & (F.col("evidence") >= MIN_EVIDENCE) & (F.col("odds") > 2))
    found = found.orderBy(F.desc("evidence"), F.desc(F.length("word")), "word").collect()
    telling = unlike([(r["word"], r["odds"]) for r in found])
    grams = {r["gram"]: float(r["total"]) for r in letter_trigrams(scored.filter("word like '%$'")).collect()}
    # Half of the character model's mass belongs to the telling words. One trigram of a word ends it.
    own = {r["word"]: r["s1"] for r in found if r["word"] in telling or r["word"].endswith("$")}
    whole = sum(n for gram, n in grams.items() if gram.endswith("$"))
    letters = CharacterModel(
        {word: 1000 * n / sum(own.values()) for word, n in own.items()}, {gram: 1000 * n / whole for gram, n in grams.items()}
    )
    return Model(telling, math.log(share / (1 - share)) if 0 < share < 1 else 0.0, letters)


def letter_trigrams(words: DataFrame) -> DataFrame:
    """``(gram, total)``: the trigrams of all words, each with ``^^`` before it, as often as their ``total`` says."""
    own = words.select(F.concat(F.lit("^^"), "word").alias("own"), "total")
    places = F.sequence(F.lit(1), F.length("own") - 2)
    grams = own.select(F.explode(F.transform(places, lambda i: F.col("own").substr(i, F.lit(3)))).alias("gram"), "total")
    return grams.groupBy("gram").agg(F.sum("total").alias("total"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` with ``score``, ``predicted`` and ``toxic_words`` (restored) of their whole ``text``.

    A text without telling words, empty and null ones included, has the share of toxic
    texts as its score.
    """

    def answer(column):
        own, hits = model.score(column)
        return pa.array(own), pa.array((own >= THRESHOLD).astype(np.int32)), pa.array(hits, pa.list_(pa.string()))

    return texts.carry(docs, answer, "score double, predicted int, toxic_words array<string>")
