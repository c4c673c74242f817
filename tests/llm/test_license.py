import math
import random
import re
import textwrap
from collections import Counter

import numpy as np

from tabsmith.llm.license import TEMPLATES, license_scan, window_norms
from tabsmith.llm.license_texts import FULL_TEXTS, HEADERS

FILES = [
    ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("a/b/x.py", "# code\nprint(1)"), ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0\nimport z"),
    ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3"), ("a/b/c/d/e.c", "int x;"),
    ("q/none.txt", "the license of the dog is under the table"), (None, "Released under the MIT License."), ("r/f", None), ("r/LICENSE", ""),
    ("a/b/x.py", "# code\nprint(1)"), ("LICENSE.md", "Licensed under CC BY-NC 4.0"), ("r/s/<b>", "<p>Licensed under CC BY 4.0.</p> other words here"),
    ("long/f", "word " * 50_000 + "\nReleased under the MIT License.\n"),
]


def cosine(text, n, df):
    tok = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]
    vocabulary = {w for _, t in TEMPLATES for w in tok(t)}
    idf = lambda w: math.log((n + 1) / ((df[w] if w in vocabulary else 0) + 1)) + 1
    vec = lambda t: {w: c * idf(w) for w, c in Counter(tok(t)).items()}
    parts = re.split(r"<[^>]*>|\n|[.!?] ", text or "")
    best = 0.0
    for part in parts:
        a = vec(part)
        for _, t in TEMPLATES:
            b = vec(t)
            dot = sum(x * b.get(w, 0) for w, x in a.items())
            if dot:
                best = max(best, dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
    return best


def test_scores_and_inheritance(spark):
    rows = [(i, p, t) for i, (p, t) in enumerate(FILES)]
    table = spark.createDataFrame(rows, "near long, path string, text string").repartition(3)
    got = {r.id: r for r in license_scan(table.withColumnRenamed("near", "id"), ["id"]).collect()}
    assert len(got) == len(rows)
    tok = lambda t: {w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")}
    df = Counter(w for _, t in FILES for w in tok(t))
    for i, (p, t) in enumerate(FILES):
        assert math.isclose(got[i].score, cosine(t, len(FILES), df), rel_tol=1e-9, abs_tol=1e-12), (p, got[i].score)
    name = {i: (r.license, r.basis, r.inherited_from) for i, r in got.items()}
    assert name[0][:2] == ("MIT", "own") and name[1] == ("MIT", "inherited", "a") == name[9]
    assert name[2][:2] == ("Apache-2.0", "own") and name[3][:2] == ("GPL-3.0", "own")
    assert name[4] == ("GPL-3.0", "inherited", "a/b/c")
    assert name[5] == ("CC-BY-NC-4.0", "inherited", "") and name[7] == name[5] == name[8]
    assert name[6][:2] == ("MIT", "own") and name[11][:2] == ("CC-BY-4.0", "own") and name[12][:2] == ("MIT", "own")


def test_empty_table(spark):
    table = spark.createDataFrame([], "id long, path string, text string")
    assert license_scan(table, ["id"]).collect() == []


def test_wrapped_headers_linked_notices_and_full_texts_in_long_files(spark):
    rng = random.Random(6)
    body = lambda n: " ".join(f"id{rng.randint(0, 4000)}" for _ in range(n))
    wrap = lambda t: "\n".join("// " + x for x in textwrap.wrap(" ".join(t.split()), 60))
    rows, want = [], {}
    for k, (name, text) in enumerate([*HEADERS, *FULL_TEXTS]):
        rows.append((f"f{k}/x.c", f"// Copyright 2020 A. Author\n{wrap(text)}\n\n{body(900)}"))
        want[f"f{k}/x.c"] = name
    rows += [("page/a", f"<p>{body(400)}</p><p>Released under the <a href='/mit'>MIT License</a></p><p>{body(400)}</p>"), ("none/b", body(2000))]
    rows.append(("gpl/c", body(800) + "\n" + wrap(HEADERS[1][1].replace("software;", "software:") + ". If not, see <https://www.gnu.org/licenses/>.") + "\n" + body(900)))
    want |= {"page/a": "MIT", "none/b": None, "gpl/c": "GPL-3.0"}
    got = license_scan(spark.createDataFrame(rows, "path string, text string").repartition(4), []).collect()
    assert {r.path: r.own_license for r in got} == want


def test_window_norms_match_counts():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 9, 60)
    weight = rng.random(9)[words]
    for length in (1, 7, 60):
        plain = [sum((n * weight[list(words).index(w)]) ** 2 for w, n in Counter(words[i : i + length]).items()) for i in range(61 - length)]
        assert np.allclose(window_norms(words, weight, length), plain)
