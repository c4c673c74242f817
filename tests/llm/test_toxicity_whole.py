"""Operator 5 learns from every labelled text: training parts, thresholds and the mean of the shards."""

import numpy as np
import pyarrow as pa
import pytest

from tabsmith.llm import toxicity


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_every_labelled_text_trains_or_sets_thresholds(spark, monkeypatch, broadcast):
    rows = [(i, f"w{i} " * (9000 if i % 50 == 0 else 3), "en") for i in range(300)] + [(7, "w7 w7 w7 ", "en"), (8, "other", "en"), (301, None, "en"), (302, "no label", "en")]
    labels = [(i, int(i % 4 == 0)) for i in range(300)] + [(5, 0), (301, 1), (999, 1), (9, None)]
    seen = {"train": [], "check": []}
    found, counts = toxicity.one_round, toxicity.odds_counts

    def one_round(train, *rest):
        seen["train"].append(sorted((r["text"], r["__toxic"]) for r in train.collect()))
        if len(seen["train"]) == 1:
            found(train, *rest)

    def odds_counts(texts, classifier):
        seen["check"] += [(r["text"], r["__toxic"]) for r in texts.collect()]
        return counts(texts, classifier)

    monkeypatch.setattr(toxicity, "one_round", one_round)
    monkeypatch.setattr(toxicity, "odds_counts", odds_counts)
    monkeypatch.setattr(toxicity, "BROADCAST", broadcast)
    monkeypatch.setattr(toxicity, "SEGMENT", 1000)
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"), sample=40, steps=4)
    label = {}
    for i, mark in labels:
        if mark is not None:
            label[i] = max(mark, label.get(i, 0))
    wanted = sorted({(i, t): (t, label[i]) for i, t, _ in rows if t is not None and i in label}.values())
    assert len(wanted) == 301 and sorted(seen["train"][0] + seen["check"]) == wanted
    assert len(seen["train"]) == toxicity.ROUNDS and all(x == seen["train"][0] for x in seen["train"])
    assert 0.1 < len(seen["check"]) / len(wanted) < 0.3


def test_threshold_counts_hold_every_text(spark):
    texts = [(f"word{i % 90} other{i % 7}", i % 3 == 0) for i in range(500)] + [("", 0)]
    classifier = toxicity.Classifier(toxicity.Network(), {"": 0.0}, toxicity.langid.fit(spark.createDataFrame([("a b c", "en")], "text string, lang string")))
    lang, odds, label, n = toxicity.odds_counts(spark.createDataFrame([(t, int(y)) for t, y in texts], "text string, __toxic int").repartition(5), classifier)
    real = classifier.network.log_odds(*toxicity.tokens(pa.array([t for t, _ in texts])))
    on_grid = np.rint(real * toxicity.GRID) / toxicity.GRID
    y = np.array([float(y) for _, y in texts])
    assert n.sum() == len(texts) and set(lang) == {"en", "und"}
    assert {(o, c): n[(odds == o) & (label == c)].sum() for o, c in zip(odds, label)} == {(o, c): ((on_grid == o) & (y == c)).sum() for o, c in zip(on_grid, y)}


def test_no_threshold_between_equal_odds():
    rng = np.random.default_rng(6)
    for _ in range(50):
        odds, label, weight = rng.integers(0, 4, 30).astype(float), rng.integers(0, 2, 30).astype(float), rng.random(30) + 0.1
        label[0] = 1
        f1 = lambda cut: 2 * (weight * label)[odds > cut].sum() / (weight[odds > cut].sum() + (weight * label).sum())
        goal = np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
        cut = goal - toxicity.best_shift(odds, label, weight)
        assert abs(odds - cut).min() >= 0.5 - 1e-9  # in the middle between two values
        assert f1(cut) == pytest.approx(max(f1(c) for c in odds - 0.5))


def test_shards_are_averaged_over_those_that_met_a_row():
    rng = np.random.default_rng(2)
    step, held = np.zeros((5, toxicity.BLOCK, 3)), np.zeros((5, toxicity.BLOCK))
    parts = []
    for k in range(5):
        at = np.sort(rng.choice(toxicity.BLOCK, 200, replace=False))
        step[k, at], held[k, at] = rng.normal(size=(200, 3)).astype(np.float32), rng.random(200).astype(np.float32) + 0.1
        parts.append(toxicity._changes(3, at, step[k, at], held[k, at]))
    one, other = (next(toxicity.mean_changes((pa.scalar(3),), iter(x))) for x in (parts, parts[::-1]))
    assert one.equals(other)
    at, mean, more = toxicity._read_changes(one.to_pylist()[0])
    met = (held > 0).sum(axis=0)
    assert (at == np.flatnonzero(met)).all()
    assert np.allclose(mean, step.sum(axis=0)[at] / met[at][:, None], atol=1e-6)
    assert np.allclose(more[:, 0], held.sum(axis=0)[at] / met[at], atol=1e-6)


def test_winners_do_not_depend_on_slices(monkeypatch):
    words, rows = toxicity.tokens(pa.array(["a b c d a b c d", "", "e", "a b", "x y z " * 40]))
    net = toxicity.Network()
    top, place = net.winners(words, rows)
    emb = net.embed(words)
    for t, c in zip(*np.nonzero(place >= 0)):
        k, f = divmod(c, toxicity.FILTERS)
        at, filt = place[t, c], net.filters[k]
        value = lambda a: sum(emb[a + j] @ filt[j, :, f] for j in range(len(filt))) + net.bias[k][f]
        assert rows[t] <= at and at + len(filt) <= rows[t + 1] and value(at) == pytest.approx(top[t, c], abs=1e-5)
        assert all(value(a) < top[t, c] + 1e-5 for a in range(rows[t], rows[t + 1] - len(filt) + 1))
    assert ((place < 0) == (top <= 0)).all()
    monkeypatch.setattr(toxicity, "SLICE", 5)
    again, _ = net.winners(words, rows)
    assert np.allclose(again, top, atol=1e-5)
