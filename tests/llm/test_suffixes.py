import random

import numpy as np
import pytest
from collections import defaultdict
from pyspark.sql import functions as F

from tabsmith.llm import suffixes
from tabsmith.llm.suffixes import gram_hashes, merged, remove_repeats, repeated_windows, runs


def brute(texts, w):
    places = defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for i, t in enumerate(raw):
        for p in range(len(t) - w + 1):
            places[t[p : p + w]].append((i, p))
    gone = [np.zeros(len(t), bool) for t in raw]
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                gone[i][p : p + w] = True
    out = []
    for t, g in zip(raw, gone):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(int), [0]])))
        out.append((len(t), int(g.sum()), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(np.frombuffer(t, np.uint8)[~g])))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randint(10, 60)) for _ in range(6)]
    out = [None, "", "short", "x" * 700, "ab" * 300, "-" * 199, "-" * 200]
    for _ in range(n):
        parts = [text(rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        if rng.random() < 0.2:
            parts += [parts[0]] * 2
        out.append("\n".join(parts))
    return out + rng.choices(out, k=12) + ["-" * 200]


def got(table, **more):
    return {r.doc_id: (r.n_bytes, r.n_removed, [(s.a, s.b) for s in r.spans], bytes(r.kept)) for r in remove_repeats(table, ["doc_id"], **more).collect()}


@pytest.mark.parametrize("seed, more", [(1, {}), (2, {"hot": 3, "bucket_bytes": 4000}), (3, {"hot": 0}), (4, {"window": 64}), (5, {"window": 33, "bucket_bytes": 1000}), (6, {"window": 256})])
def test_matches_every_window_compared(docs, seed, more):
    texts = corpus(seed)
    want = brute(texts, more.get("window", 200))
    assert sum(w[1] for w in want) > 1000
    assert got(docs(list(enumerate(texts))), **more) == dict(enumerate(want))


def test_slices_of_long_texts_and_small_flushes(docs, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(30_000))
    texts = [long, long[5000:7000] + "q" + long[:300], "z" + long[29_000:], long[9000:9199], long[9000:9200]]
    monkeypatch.setattr(suffixes, "SLICE", 700)
    data = np.frombuffer(long.encode(), np.uint8)
    whole, cut = (np.concatenate([s + np.arange(c) for _, s, c, _, _ in parts for s, c in zip(s, c)]) for parts in ([runs(data, np.array([0, len(data)]), 200)], suffixes._sliced(data, np.array([0, len(data)]), 200)))
    assert (np.sort(cut) == whole).all() and len(whole) == len(data) - 199
    assert got(docs(list(enumerate(texts)))) == dict(enumerate(brute(texts, 200)))


def test_equal_ids_clashing_names_and_empty_table(docs):
    text = "".join(random.Random(4).choice("abcdef ") for _ in range(500))
    table = docs([(1, text), (1, text), (None, text + "x"), (2, "y" * 10)]).withColumnRenamed("lang", "kept").withColumn("k", F.lit(0)).withColumn("spans", F.lit(0))
    out = remove_repeats(table, ["doc_id", "kept", "k", "spans"])
    assert out.columns == ["doc_id", "k", "n_bytes", "n_removed", "spans", "kept"]
    assert sorted((r.n_bytes, r.n_removed) for r in out.collect()) == [(10, 0), (500, 500), (500, 500), (501, 500)]
    assert remove_repeats(table.limit(0), ["doc_id"]).collect() == []
    assert remove_repeats(docs([(1, "a")]), []).count() == 1
    with pytest.raises(ValueError):
        remove_repeats(table, ["doc_id"], window=32)


def test_equal_windows_have_equal_anchors():
    rng = np.random.Generator(np.random.PCG64(3))
    part = rng.integers(97, 100, 400).astype(np.uint8)
    rows = [np.concatenate([rng.integers(97, 100, n).astype(np.uint8), part, rng.integers(97, 100, 50).astype(np.uint8)]) for n in (0, 17, 333)]
    seen = []
    for r, n in zip(rows, (0, 17, 333)):
        text, start, count, off, anchor = runs(r, np.array([0, len(r)]), 200)
        flat = {int(s + i - n): (int(o - i), int(h)) for s, c, o, h in zip(start, count, off, anchor) for i in range(c)}
        seen.append([flat[p] for p in range(201)])
    assert seen[0] == seen[1] == seen[2]


def test_gram_hashes_tell_strings_apart_and_spans_merge():
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    for n in (1, 2, 3, 5, 7, 12, 13):
        h = gram_hashes(data, n)
        grams = [bytes(data[i : i + n]) for i in range(len(data) - n + 1)]
        assert len(h) == len(grams) and all((h[i] == h[j]) == (grams[i] == grams[j]) for i in range(len(h)) for j in range(len(h)))
    assert merged(np.array([9, 0, 5, 30]), np.array([12, 5, 6, 40])) == [(0, 6), (9, 12), (30, 40)]


def test_radix_passes_keep_exactly_the_repeated(docs):
    rng = np.random.Generator(np.random.PCG64(8))
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    begin, count = np.array([0, 1500]), np.array([900, 1200])
    at = repeated_windows(np.zeros(2, np.uint64), data, begin, count, np.zeros(2, np.int64), 200)
    assert len(at) == 0  # the anchor's place differs, so they start in different groups
    at = repeated_windows(np.zeros(2, np.uint64), data, np.array([100, 2000]), np.array([101, 150]), np.zeros(2, np.int64), 200)
    assert sorted(at.tolist()) == [*range(100, 201), *range(2000, 2101)]
