import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith.llm.common import utf8
from tabsmith.llm.fim import RankIndex, Rule, fill_in_middle, line_boundaries, restored

LONG = "".join(f"line {i} é\n" * (i % 3) for i in range(4000))
TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "é\nü ñ\n\n漢字\r\nlast", "x<P>y\nz", "a<\nS>b\n<", "<S", "<P\nM>\n<M>", "tab\tand\x0bvt\nend", LONG, "word " * 30_000, "z\n" * 5000,
]


def plain(doc_id, text, rule):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rule.cut_percent:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < rule.spm_percent:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rule", [Rule(), Rule(3, 60, 20)])
def test_matches_plain_version_and_restores(docs, rule):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(None, "null\nid\n"), (5, "one"), (5, "one")]
    got = fill_in_middle(docs(rows), ["doc_id", "text"], rule).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((d, t, *plain(d, t, rule)) for d, t in rows), key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_clashing_names_and_empty_table(docs):
    table = docs([(1, "a\nb")]).withColumnRenamed("lang", "output").withColumn("n", F.lit("x")).withColumn("__text", F.lit(1))
    got = fill_in_middle(table, ["doc_id", "output", "n", "__text"])
    assert got.columns == ["doc_id", "__text", "n", "form", "prefix_chars", "middle_chars", "output"] and got.first().n == 2
    assert fill_in_middle(table, []).count() == 1
    assert fill_in_middle(table.limit(0), ["doc_id"]).collect() == []


@pytest.mark.parametrize("epsilon", [0, 5, 127])
def test_index_is_exact_and_error_bounded(epsilon):
    rng = random.Random(epsilon)
    texts = ["".join("x" * rng.choice([0, 3, 40, 2000]) + "\n" for _ in range(rng.randrange(300))) for _ in range(40)] + ["", "\n", "a"]
    data, bounds = utf8(pa.array(texts))
    offsets, rows = line_boundaries(data, bounds)
    for i, t in enumerate(texts):
        want = np.cumsum([0, *(len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", t))])
        assert offsets[rows[i] : rows[i + 1]].tolist() == want.tolist()
    index = RankIndex.fit(offsets, rows, epsilon)
    assert (index.select(np.arange(len(offsets))) == offsets).all()
    assert np.abs(index.residual).max() <= epsilon and len(index.first) < len(offsets)


def test_regular_lines_need_one_segment():
    data, bounds = utf8(pa.array(["abc\n" * 10_000]))
    assert len(RankIndex.fit(*line_boundaries(data, bounds)).first) == 1
