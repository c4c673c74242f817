import math

import pyarrow as pa

from tabsmith.llm import langid


def brute_cost(train, text, order):
    """PPM code length in bits by dictionaries."""
    pad = b"\n" * order
    counts = {}
    for t in train:
        b = pad + t.lower().encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts.setdefault((k, b[i - k : i]), {}).setdefault(b[i], 0)
                counts[(k, b[i - k : i])][b[i]] += 1
    bits, b = 0.0, pad + text.lower().encode()
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            seen = counts.get((k, b[i - k : i]))
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                bits += math.log2((n + d) / seen[b[i]])
                break
            bits += math.log2((n + d) / d)
        else:
            bits += 8
    return bits


TRAIN = [(i, f"the cat and the dog number {i} sat on that mat", "en") for i in range(8)] + [(100 + i, f"der Hund und die Katze {i} sind auf der Matte", "de") for i in range(8)]


def test_code_lengths_match_dictionaries(docs):
    model = langid.fit(docs(TRAIN))
    assert model.names == ["de", "en"]
    texts = ["the dog", "die Katze", "ünbekannt xyz", "", "a" * 40]
    bits, size = model.code_lengths(pa.array(texts))
    for i, text in enumerate(texts):
        for j, name in enumerate(model.names):
            want = brute_cost([t for _, t, x in TRAIN if x == name], text, langid.ORDER)
            assert abs(bits[i, j] - want) < 1e-3 * max(1, want)


def test_edges(docs, spark):
    model = langid.fit(docs(TRAIN))
    rows = [(1, None), (2, ""), (3, "12 !? 34"), (4, "und der Hund"), (4, "und der Hund"), (None, "the cat"), (6, "the cat " * 40_000)]
    got = langid.identify(docs(rows).withColumnRenamed("lang", "score_"), model, ["doc_id"]).collect()
    by = {(r.doc_id): r for r in got}
    assert len(got) == len(rows)
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == "de" and by[None].lang_pred == "en" and by[6].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    empty = langid.fit(docs([(1, "x", None)]))
    assert [r.lang_pred for r in langid.identify(docs([(1, "text")]), empty, ["doc_id"]).collect()] == ["und"]
    assert langid.identify(docs([(1, "a")]).limit(0), model, ["doc_id"]).collect() == []


def test_held_out_accuracy(spark):
    from tabsmith.llm import QUERIES

    from tests.conftest import SMOKE

    got = QUERIES["op1_language_id"](spark, SMOKE).join(spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.95


def test_learns_languages_of_long_texts_and_of_copies(docs):
    long = "\n".join(f"рядок номер {i} про кота і собаку" for i in range(300))
    rows = TRAIN + [(200 + i, f"{i} {long}", "uk") for i in range(3)]
    model = langid.fit(docs(rows), sample_text=1000)
    assert model.names == ["de", "en", "uk"]
    assert model.predict(pa.array(["кіт і собака", long, "the dog"]))[0] == ["uk", "uk", "en"]
    assert model.trees[2].levels[0][0].max() < 0xF0  # no broken characters
    assert 0xEF not in model.trees[2].levels[0][0]


def test_sample_is_full_in_a_table_of_copies(docs):
    from tabsmith.llm.common import bounded_sample

    rows = [(i, f"text {i}", "en") for i in range(400)] + [(1000 + i, "copy", "en") for i in range(20_000)]
    got = bounded_sample(docs(rows).select("text", "lang"), 300, 11, ["text"], "lang")
    assert got.count() == got.distinct().count() == 300


def test_slices_do_not_change_code_lengths(docs, monkeypatch):
    import pyarrow as pa

    model = langid.fit(docs([(1, "the cat sat on the mat", "en"), (2, "die Katze saß auf der Matte", "de")]))
    text = pa.array(["the cat", "", None, "die Matte é" * 40, "x", "the mat on the cat " * 30])
    whole, size = model.code_lengths(text)
    for n in (1, 3, 7, 64):
        monkeypatch.setattr(langid, "SLICE", n)
        got, same = model.code_lengths(text)
        assert abs(got - whole).max() < 1e-3 and (same == size).all()


def test_ties_and_clashing_names(docs):
    model = langid.fit(docs([(1, "abc abc", "b"), (2, "abc abc", "a")]))
    table = docs([(1, "abc"), (2, "abc")]).withColumnRenamed("lang", "score").withColumnRenamed("doc_id", "bits_per_byte")
    got = langid.identify(table.selectExpr("*", "7 as id"), model, ["id", "score", "bits_per_byte"])
    assert got.columns == ["id", "lang_pred", "score", "bits_per_byte"] and {r.lang_pred for r in got.collect()} == {"a"}
