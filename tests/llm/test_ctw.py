import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabsmith.llm import ctw


def brute(train, texts, depth):
    """Context-tree weighting by dictionaries and math.lgamma."""
    pad = b"\n" * depth
    counts = {}
    for t in train:
        b = pad + code(t)
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                for bit in range(8):
                    node = (1 << bit) | (b[i] >> (8 - bit))
                    counts.setdefault((d, b[i - d : i], node), [0, 0])[(b[i] >> (7 - bit)) & 1] += 1
    kt = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    log, weight = {}, {}
    for d in range(depth, -1, -1):
        below = Counter()
        for (dd, c, node) in counts:
            if dd == d + 1:
                below[(d, c[1:], node)] += log[(dd, c, node)]
        for k in counts:
            if k[0] == d:
                s = below[k] if d < depth else 0
                log[k] = kt[k] if d == depth else np.logaddexp(kt[k], s) - math.log(2)
                weight[k] = 1.0 if d == depth else 1 / (1 + math.exp(min(700, s - kt[k])))
    out = []
    for t in texts:
        total, b = 0.0, pad + code(t)
        for i in range(depth, len(b)):
            for bit in range(8):
                node, one, p = (1 << bit) | (b[i] >> (8 - bit)), (b[i] >> (7 - bit)) & 1, None
                for d in range(depth, -1, -1):
                    k = (d, b[i - d : i], node)
                    if k in counts:
                        own = (counts[k][one] + 0.5) / (sum(counts[k]) + 1)
                        p = own if p is None else weight[k] * own + (1 - weight[k]) * p
                total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def code(t):
    return " ".join(words(t)).encode() + b"\n"


def corpus():
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "The", "cat", "sat", "on", "mät", f"x{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, " \n\t"), (63, "unseen ŵords zz"), (63, "unseen ŵords zz"), (None, "the cat"), (70, "the cat sat " * 2000)]


def test_code_bytes():
    data, bounds = ctw.streams(pa.array(["The  cat\n", None, "", "a"]))
    assert [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:])] == [b"the cat\n", b"\n", b"\n", b"a\n"]


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3.5, 20, 1e4 + 0.5, 1e9])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_scores_match_dictionaries(docs, monkeypatch):
    monkeypatch.setattr(ctw, "OWNER", 2000)  # many owners
    rows = corpus()
    held = F.col("doc_id") % 5 == 0
    got = ctw.lm_scores(docs(rows).withColumnRenamed("lang", "block"), held).collect()
    train = [t for d, t in rows if d is None or d % 5]
    count = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    want = {}
    for (d, t), s in zip(rows, brute(train, [t for _, t in rows], ctw.DEPTH)):
        tokens = [*words(t), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[d] = (d is not None and d % 5 == 0, len(tokens), sum(count[w] > 0 for w in tokens), n, base, s)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9) and math.isclose(r.score, w[5], rel_tol=1e-5, abs_tol=1e-6)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    from tabsmith.llm.langid import windows

    window, n = np.unique(windows(data, np.array([0, 3000]), ctw.DEPTH + 1), return_counts=True)
    levels = ctw.subtrees(window, n.astype(float))
    two = levels[-1]
    node, at = np.unique(two.keys & np.uint64(0xFFFF), return_inverse=True)
    levels += ctw.top_levels(node, *(np.bincount(at, x, len(node)) for x in (two.n0, two.n1, two.log)))
    for context in (window[5] >> np.uint64(8), window[40] >> np.uint64(8), np.uint64(0x7A7A7A7A7A)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** ctw.log10_probabilities(every, levels)).sum() - 1) < 1e-9


def test_empty_tables(docs):
    assert ctw.lm_scores(docs([(1, "a")]).limit(0), F.lit(False)).collect() == []
    alone = ctw.lm_scores(docs([(1, "a b")]), F.lit(True)).collect()[0]
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isclose(alone.score, 32 * math.log10(0.5), rel_tol=1e-6)
