"""Language of a text by cross-parsing with suffix automata of labelled text.

A text is parsed greedily into the longest phrases that occur in a language's sample;
the language that needs the fewest phrases a byte wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import texts

#: Bytes of labelled text per language; distinct texts with the lowest hashes come first.
SAMPLE_BYTES = 16_000
SAMPLE_ROWS = 64
MOST_BYTES = 16 * SAMPLE_BYTES
#: Texts are parsed in lanes of this many bytes, all lanes of a slice at once; results don't depend on it.
LANE = 512
UNKNOWN = "und"
FOLDS = 5


def _symbols() -> np.ndarray:
    """Bytes to symbols: letters and bytes outside ASCII are themselves, all else is one blank."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_SYMBOL = _symbols()


def normalized(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with single blanks between words, a blank before and after, and where texts begin."""
    closed = [pa.scalar(x, pa.large_string()) for x in (" ", "")]
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    data, places = texts.raw(pc.binary_join_element_wise(closed[1], lower, closed[1], closed[0]))
    data = _SYMBOL[data]
    kept = np.append(True, (data[1:] != 32) | (data[:-1] != 32)) if len(data) else np.zeros(0, bool)
    kept[places[:-1][np.diff(places) > 0]] = True
    return data[kept], np.append(0, np.cumsum(kept))[places]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings, by state."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at >= 0:
            to = moves[at][symbol]
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                split = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(symbol) == to:
                    moves[at][symbol] = split
                    at = link[at]
                link[to] = link[state] = split
        last = state
    return moves


class Languages:
    """Transition tables of all languages behind one another; -1 ends a phrase."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        seen = sorted({b for text in samples.values() for b in text})
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        tables, self.root = [], []
        for name in self.names:
            moves, base = suffix_automaton(samples[name]), sum(map(len, tables))
            table = np.full((len(moves) + 1, self.width), -1, np.int32)
            for state, own in enumerate(moves):
                for symbol, to in own.items():
                    table[state, self.symbol[symbol]] = base + to
            # A symbol that the sample lacks is a phrase of its own: the last state leads nowhere.
            table[0][table[0] < 0] = base + len(moves)
            self.root.append(base)
            tables.append(table)
        self.moves = np.concatenate(tables).ravel() * self.width if tables else np.zeros(0, np.int32)
        self.moves[self.moves < 0] = -1

    def phrases(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) in each language, and the bytes parsed.

        Lanes of a text are parsed at once, each as if a phrase began with it. Then every lane
        goes on into the next ones, and replaces the beginnings of phrases there, until it meets one
        that it agrees with: from there on both are the same. A lane goes on at the same pace as the one
        behind it, so it never meets beginnings that are still to be replaced. Lanes of text agree
        after a few words; where they never do, the last step is as long as the text.
        """
        size = np.diff(places)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        begin = np.repeat(places[:-1], lanes) + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = places[text + 1]
        length = np.minimum(begin + LANE, stop) - begin
        order = np.argsort(-length, kind="stable")
        begin, length, stop = begin[order], length[order], stop[order]
        symbols, starts = self.symbol[data], np.zeros((len(self.names), len(data) + 1), bool)
        starts[:, begin] = True
        root = np.array(self.root, np.int64) * self.width
        state = np.repeat(root[:, None], len(begin), axis=1)
        active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
        for step, n in enumerate(active.tolist()):
            at = begin[:n] + step
            own = symbols[at]
            for k in range(len(root)):
                to = self.moves[state[k, :n] + own]
                ended = np.flatnonzero(to < 0)
                if len(ended):
                    to[ended] = self.moves[root[k] + own[ended]]
                    starts[k, at[ended]] = True
                state[k, :n] = to
        more = begin + length < stop
        for k in range(len(root)):
            self._go_on(root[k], state[k, more], (begin + length)[more], stop[more], symbols, starts[k])
        total = np.concatenate([np.zeros((len(root), 1), np.int64), np.cumsum(starts[:, :-1], axis=1, dtype=np.int64)], axis=1)
        return (total[:, places[1:]] - total[:, places[:-1]]).T, size

    def _go_on(self, root, state, at, stop, symbols, starts) -> None:
        while len(at):
            own = symbols[at]
            to = self.moves[state + own]
            ended = to < 0
            agreed = ended & starts[at]
            starts[at] = ended
            to[ended] = self.moves[root + own[ended]]
            at = at + 1
            left = ~agreed & (at < stop)
            state, at, stop = to[left], at[left], stop[left]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language of each text, and how far its phrases are below the next one's (0 to 1)."""
        data, places = normalized(column)
        total, _ = self.phrases(data, places)
        order = np.argsort(total, axis=1, kind="stable")
        best = total[np.arange(len(total)), order[:, 0]]
        if len(self.names) > 1:
            score = 1 - best / np.maximum(total[np.arange(len(total)), order[:, 1]], 1)
        else:
            score = np.ones(len(total))
        return [self.names[k] for k in order[:, 0]], score


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_rows: int = SAMPLE_ROWS) -> Languages:
    """Automata of up to ``sample_bytes`` of text for each value of ``lang`` in ``docs``.

    Of each language up to ``sample_rows`` distinct texts, those with the lowest hashes, give equal
    stretches, fewer bytes each if there are over 16 languages, so the automata have a fixed
    bound. A stretch begins at a hashed place of the whole text: copies count once, and a common
    header weighs no more than other parts.
    """
    known = docs.filter("lang is not null and text rlike '\\\\p{L}'").select("lang", F.col("text").cast("string").alias("text"))
    distinct = F.approx_count_distinct(F.xxhash64("text")).alias("n")
    counts = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(distinct).toLocalIterator()}
    if not counts:
        return Languages({})
    sample_bytes = min(sample_bytes, MOST_BYTES // len(counts))
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    part = -(-sample_bytes // sample_rows)
    few = known.sparkSession.createDataFrame([(k, min(1.0, 4 * sample_rows / n)) for k, n in counts.items()], "lang string, share double")
    # Room for blanks and signs, which normalizing drops.
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - 4 * part, F.lit(0)) + 1) + 1
    stretch = F.substring("text", place.cast("int"), F.lit(4 * part))
    # One short row per language, made from the counts above.
    drawn = known.withColumn("spot", spot).join(F.broadcast(few), "lang").filter("spot < share")
    drawn = drawn.select("lang", "spot", stretch.alias("text")).groupBy("lang", "spot").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    samples: dict[str, bytes] = {}
    for row in drawn.withColumn("rank", rank).filter(F.col("rank") <= sample_rows).orderBy("lang", "rank").toLocalIterator():
        own = normalized(pa.array([row["text"]], pa.string()))[0].tobytes()
        samples[row["lang"]] = (samples.get(row["lang"], b"") + own[:part])[:sample_bytes]
    return Languages(samples)


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """Rows of ``docs`` with ``lang_pred`` and ``score`` of their whole ``text``.

    A text that is null or has no letter gets ``und`` and 0, as does every text if no
    language was learned. Ties go to the first language in order of names.
    """

    def answer(column):
        names, score = languages.predict(column)
        return pa.array(names, pa.string()), pa.array(score)

    if not languages.names:
        return docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return texts.carry(docs, answer, "lang_pred string, score double").withColumns(
        {
            "lang_pred": F.when(lettered, F.col("lang_pred")).otherwise(F.lit(UNKNOWN)),
            "score": F.when(lettered, F.col("score")).otherwise(F.lit(0.0)),
        }
    )
