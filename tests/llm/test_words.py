import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsmith.llm.common import pieces, utf8
from tabsmith.llm.words import shingles, word_hashes

TEXT = st.one_of(st.none(), st.text(st.sampled_from("aB c\n\té。 x"), max_size=30))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_and_shingles_follow_the_pattern(texts):
    hashes, rows = word_hashes(*utf8(pa.array(texts, pa.string())))
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for t in texts]
    assert np.diff(rows).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert all((a == b) == (x == y) for a, x in zip(flat, hashes) for b, y in zip(flat, hashes))
    found, at = shingles(hashes, rows, 3)
    expected = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else []) for w in words]
    assert np.diff(at).tolist() == [len(x) for x in expected]
    runs = [s for x in expected for s in x]
    assert all((a == b) == (x == y) for a, x in zip(runs, found) for b, y in zip(runs, found))


def test_pieces_keep_rows_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 50, None, "", "y" * 500, "z"], "id": [1, 2, 3, 4, 5]})
    parts = list(pieces(iter([batch]), limit=60))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and len(parts) > 1
    data, bounds = utf8(batch.slice(2, 3).column("text"))
    assert bytes(data) == b"y" * 500 + b"z" and bounds.tolist() == [0, 0, 500, 501]
