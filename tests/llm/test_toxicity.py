import random

import numpy as np
import pyarrow as pa
import pytest

from tabsmith.llm import toxicity

WORDS = [f"w{i}" for i in range(300)]


def text(rng, bad):
    words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
    if bad:
        words.insert(rng.randrange(len(words)), rng.choice(["lowei", "chlla"]) + rng.choice(["ab", "cd", "ef", "gh"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, i % 5 == 0), "en") for i in range(900)]
    labels = [(i, int(i % 5 == 0)) for i in range(900)] + [(3, None), (4, 0), (99_999, 1), (None, 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return toxicity.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"), steps=300)


def test_finds_unseen_texts(docs, model):
    rng = random.Random(8)
    rows = [(i, text(rng, i % 2 == 0)) for i in range(300)]
    got = {r.doc_id: r for r in toxicity.score(docs(rows), model, ["doc_id"]).collect()}
    right = [got[i].predicted == (i % 2 == 0) for i in range(300)]
    assert np.mean(right) > 0.95


def test_edges(docs, model):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "w1"), (4, "w1"), (None, "w2"), (6, "w1 w2 " * 60_000 + "loweiab")]
    got = toxicity.score(docs(rows).withColumnRenamed("lang", "predicted_"), model, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score and by[1].predicted == 0
    assert by[6].predicted == 1  # the last word of a long text
    assert toxicity.score(docs(rows).limit(0), model, ["doc_id"]).collect() == []


def test_without_labels_of_both_classes(docs, spark):
    one = toxicity.fit(docs([(1, "a b", "en")]), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs([(1, "a")]), one, ["doc_id"]).collect()] == [0.0]


def test_pooling_matches_loops():
    net = toxicity.Network()
    words, rows = toxicity.tokens(pa.array(["a b c d", "", "e", "a b"]))
    top, _ = net.pooled(net.embed(words), rows)
    emb = net.embed(words)
    for i in range(4):
        own = emb[rows[i] : rows[i + 1]]
        for k, width in enumerate(toxicity.WIDTHS):
            best = np.zeros(toxicity.FILTERS)
            for at in range(len(own) - width + 1):
                best = np.maximum(best, sum(own[at + j] @ net.filters[k][j] for j in range(width)) + net.bias[k])
            assert np.allclose(top[i, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], best, atol=1e-5)


@pytest.mark.parametrize("every, strangers", [(3, 20_000), (60, 0)])
def test_sample_is_filled_from_usable_documents_of_both_classes(docs, spark, every, strangers):
    rng = random.Random(12)
    rows = [(i, text(rng, i % every == 0), "en") for i in range(9000)]
    labels = [(i, int(i % every == 0)) for i in range(9000)] + [(10_000 + i, i % 2) for i in range(strangers)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels, sample=400, steps=300)
    unseen = [(i, text(rng, i % 4 == 0)) for i in range(400)]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs(unseen), model, ["doc_id"]).collect()}
    hit = sum(got[i] for i in range(0, 400, 4))
    assert hit > 70 and sum(got.values()) - hit < 15, (hit, sum(got.values()))


def test_slices_do_not_change_scores(monkeypatch):
    rng = random.Random(2)
    texts = pa.array([text(rng, i % 3 == 0) for i in range(30)] + ["", None, "one", "x" * 900, "a,b" * 300])
    net = toxicity.Network()
    words, rows = toxicity.tokens(texts)
    whole = net.log_odds(words, rows)
    for n, size in ((1, 1), (5, 40), (64, 700)):
        monkeypatch.setattr(toxicity, "SLICE", n)
        monkeypatch.setattr(toxicity, "SLICE_BYTES", size)
        again, same = toxicity.tokens(texts)
        assert (again == words).all() and (same == rows).all()
        assert np.allclose(net.log_odds(words, rows), whole, atol=1e-5)


def test_step_follows_the_gradient():
    words, rows = toxicity.tokens(pa.array(["a b c d", "e f", "a g h i j"]))
    label = np.array([1, 0, 1], np.float32)

    def loss(net):
        p = 1 / (1 + np.exp(-net.log_odds(words, rows)))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    net, memory = toxicity.Network(), {}
    kinds = {"o": lambda n: n.out, ("f", 1): lambda n: n.filters[1], ("b", 0): lambda n: n.bias[0]}
    net.step(words, rows, label, 0.0, memory)  # no rate: memory holds squared gradients alone
    for name, part in kinds.items():
        for at in list(np.ndindex(part(net).shape))[:12]:
            slope = []
            for h in (1e-3, -1e-3):
                part(net)[at] += h
                slope.append(loss(net))
                part(net)[at] -= h
            slope = (slope[0] - slope[1]) / 2e-3
            assert abs(abs(slope) - (memory[name][at] - 1e-6) ** 0.5) < 5e-3, (name, at)


def test_best_shift_matches_every_threshold():
    rng = np.random.default_rng(4)
    for _ in range(20):
        odds, label, weight = rng.normal(size=40), rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.1
        label[0] = 1
        f1 = lambda cut: 2 * (weight * label)[odds > cut].sum() / (weight[odds > cut].sum() + (weight * label).sum())
        best = max(f1(c) for c in np.append(odds - 1e-9, -9))
        goal = np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
        assert f1(goal - toxicity.best_shift(odds, label, weight)) == pytest.approx(best)


def test_long_texts_teach_and_are_scored(docs, spark):
    rng = random.Random(5)
    long = lambda between: between.join(text(rng, False) for _ in range(300))
    rows = [(i, long(" loweiab chllacd ") if i % 5 == 0 else long(" ") if i % 5 < 3 else text(rng, False), "en") for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")
    assert min(len(t) for i, t, _ in rows if i % 5 == 0) > 32 << 10
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels, steps=300)
    assert model.network is not None
    clean = " ".join(text(rng, False) + " w1 w2 w3 w4 w5 w6 w7 w8 w9" for _ in range(50))
    huge = (clean + " ") * 2500
    assert len(huge) > 8_000_000
    got = {r.doc_id: r.score for r in toxicity.score(docs([(1, huge + "loweiab chllacd " + clean), (2, huge + clean), (3, clean)]), model, ["doc_id"]).collect()}
    assert got[1] > got[2] and got[2] == pytest.approx(got[3], abs=0.05)  # one toxic run in 8 MB counts, repetition doesn't


def test_clashing_names_and_warning(docs, spark, model):
    table = docs([(1, "w1")]).withColumnRenamed("lang", "score").selectExpr("*", "'x' as predicted", "1 as words")
    assert toxicity.score(table, model, ["doc_id", "score", "predicted", "words"]).columns == ["doc_id", "words", "score", "predicted"]
    with pytest.warns(UserWarning, match="nothing is learned"):
        toxicity.fit(docs([(1, "a b", "en")]), spark.createDataFrame([], "doc_id long, toxic int"))
