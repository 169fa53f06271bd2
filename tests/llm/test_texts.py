import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from catalogkit.llm import texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\x1c Z", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(rows):
    words = texts.split_words(pa.array(rows, pa.string()))
    for i, row in enumerate(rows):
        assert bytes(words.joined(i)) == b" ".join(WORD.findall((row or "").encode()))
    numbers, distinct = words.numbered()
    assert [distinct[int(n)].as_py()[:-1] for n in numbers] == [w for r in rows for w in WORD.findall((r or "").encode())]


def test_hashes_depend_on_content_only():
    a = texts.split_words(pa.array(["x yy zzz", "yy"])).hashes()[1]
    b = texts.split_words(pa.array(["zzz", "yy x"])).hashes()[1]
    assert [a[0], a[1], a[2], a[3]] == [b[2], b[1], b[0], b[1]]
    runs = texts.hash_runs(np.array([5, 6, 5, 6], np.uint64), np.array([0, 2, 1]), np.array([2, 4, 3]))
    assert runs[0] == runs[1] != runs[2]


def test_slices_keep_all_rows_and_split_by_bytes():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 30, "", "c" * 10])], ["text"])
    parts = list(texts.slices([batch, batch.slice(0, 0)], "text", 20))
    assert [r for p in parts for r in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert len(parts) > 1
