import random

import numpy as np
import pyarrow as pa
import pytest

from tabsmith.llm import decontaminate as D


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h.max()


def test_alignment_matches_the_plain_table(monkeypatch):
    monkeypatch.setattr(D, "CELLS", 300)  # several groups
    rng = random.Random(1)
    a = [np.array([rng.randint(1, 6) for _ in range(rng.randint(1, 15))]) for _ in range(40)]
    b = [np.array([rng.randint(1, 6) for _ in range(rng.randint(1, 40))]) for _ in range(40)]
    score, start, end = D.align(a, b)
    for i in range(40):
        assert score[i] == smith_waterman(a[i], b[i])
        assert 0 <= start[i] <= end[i] <= len(b[i])
        if score[i]:
            assert smith_waterman(a[i], b[i][start[i] : end[i]]) >= 0.5 * score[i]


def words(rng, n):
    return [f"v{rng.randint(0, 3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    items = [(i, words(rng, rng.randint(15, 50))) for i in range(12)]
    rows, leaks = [], set()
    for d in range(300):
        body = words(rng, rng.randint(0, 200))
        if d % 10 == 0:
            i, item = items[(d // 10) % 12]
            copy = [w if rng.random() > (0.0 if d % 20 else 0.12) else rng.choice(["edited", ""]) for w in item]
            at = rng.randint(0, len(body))
            body[at:at] = copy
            leaks.add((d, i))
        rows.append((d, " ".join(body).upper() if d % 3 else ", ".join(body)))
    rows += [(500 + k, " ".join(["the of and"] * 40)) for k in range(5)]
    rows += [(600, None), (601, ""), (None, " ".join(items[3][1])), (602, " ".join(items[4][1])), (602, " ".join(items[4][1])), (603, " ".join(words(rng, 30_000) + items[5][1]))]
    leaks |= {(None, 3), (602, 4), (603, 5)}
    benchmark = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "two words"), (93, "the of and the of and the of and")]
    return rows, benchmark, leaks


def found(docs, spark, rows, benchmark):
    items = spark.createDataFrame(benchmark, "item_id long, text string").withColumnRenamed("x", "y")
    return D.contaminated(docs(rows).withColumnRenamed("lang", "words"), items).collect()


def test_finds_exact_and_edited_copies_alone(docs, spark, tables):
    rows, benchmark, leaks = tables
    got = found(docs, spark, rows, benchmark)
    pairs = [(r.doc_id, r.item_id) for r in got if r.item_id != 93]
    assert sorted(pairs, key=str) == sorted(leaks, key=str)
    assert all(D.THRESHOLD <= r.score <= 1 and r.start < r.end for r in got)
    assert {(r.doc_id, r.score) for r in got if r.item_id == 4 and r.doc_id == 602} == {(602, 1.0)}


def test_empty_sides(docs, spark, tables):
    rows, benchmark, _ = tables
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs(rows), none).collect() == []
    assert D.contaminated(docs(rows).limit(0), spark.createDataFrame(benchmark, "item_id long, text string")).collect() == []


def test_repeated_edited_copies_are_found_beside_an_exact_one(docs, spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)  # several blocks of items
    rng = random.Random(4)
    items = [words(rng, 40) for _ in range(4)]
    edited = [w if i % 5 else f"other{i}" for i, w in enumerate(items[0])]
    rows = [(0, " ".join(items[0]))] + [(1 + k, " ".join(words(rng, k) + edited + words(rng, 9))) for k in range(30)]
    rows += [(100 + k, " ".join(words(rng, 30) + items[0][3:6] + words(rng, 30))) for k in range(30)]  # a seed alone
    rows += [(200, " ".join(items[0][3:6] * 4000 + edited)), (201, " ".join(items[1] * 50))]
    got = found(docs, spark, rows, [(i, " ".join(w)) for i, w in enumerate(items)])
    assert sorted((r.doc_id, r.item_id) for r in got) == [*((k, 0) for k in range(31)), (200, 0), (201, 1)]
    by = {r.doc_id: r for r in got}
    score = smith_waterman(items[0], edited) / 80
    assert score > D.THRESHOLD and all(by[k].score >= score for k in range(1, 31)) and by[0].score == by[201].score == 1


def test_bound_is_never_below_the_alignment():
    rng = random.Random(9)
    texts = [[rng.randint(1, 30) for _ in range(rng.randint(3, 120))] for _ in range(60)]
    lists = [[rng.randint(1, 30) for _ in range(rng.randint(6, 12))] for _ in range(8)]
    items = D.Items(pa.table({"item_id": list(range(8)), "words": pa.array(lists, pa.list_(pa.int64()))}), "bigint", D.THRESHOLD)
    flat, rows = np.array(sum(texts, []), np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    got = {}
    for row, item, start, end in items.passages(flat, rows):
        score, _, _ = D.align([items.words[i] for i in item], [flat[a:b] for a, b in zip(start, end)])
        for r, i, s in zip(row, item, score):
            got[r, i] = max(got.get((r, i), 0), s)
    for r, text in enumerate(texts):
        for i, own in enumerate(lists):
            shared = {tuple(own[k : k + 3]) for k in range(len(own) - 2)} & {tuple(text[k : k + 3]) for k in range(len(text) - 2)}
            best = smith_waterman(own, text)
            if best < items.least[i]:
                assert got.get((r, i), 0) < items.least[i]
            elif shared and (r, i) in got:
                assert got[r, i] <= best
            assert (r, i) not in got or shared


def test_short_items_and_unspaced_scripts(docs, spark):
    han = "关于北京的问题,哪一个答案是正确的呢。请选择最合适的一项"
    thai, kana = "ประเทศไทยมีเมืองหลวงชื่ออะไร", "日本の首都はどこですか、答えてください"
    benchmark = [(1, "four words in all"), (2, han), (3, thai), (4, kana), (5, "two words"), (6, "a b c")]
    edited = han.replace(",", ",").replace("正确", "准确").replace("合适", "适当")
    rows = [(1, "so Four, words in ALL here"), (2, "four words in none all"), (3, "前言很长。" + edited + "后记也长。"), (4, "คำนำ" + thai), (5, "はい" + kana + "。")]
    rows += [(6, "两个不同的句子在这里"), (7, "two words"), (8, "x a b c y"), (9, "a b d c"), (10, ""), (11, "é 中"), (12, "𠀀𠀁" + han)]
    got = found(docs, spark, rows, benchmark)
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (3, 2), (4, 3), (5, 4), (7, 5), (8, 6), (12, 2)]
    assert all(r.score == 1 for r in got if r.doc_id != 3)


def test_spaces_go_around_single_characters():
    texts = ["ab中c", "", "é𠀀", "中", "。x", "plain", "文"]
    data, bounds = D.spaced(*D.utf8(pa.array(texts)))
    cut = [data[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])]
    assert cut == ["ab 中 c", "", "é 𠀀 ", " 中 ", "   x", "plain", " 文 "]


def test_items_of_one_and_two_words_match_whole_copies(docs, spark):
    benchmark = [(1, "Zyzzyva"), (2, "two words"), (3, "a b c d e f g h"), (4, ""), (5, "zyzzyva")]
    rows = [(1, "the zyzzyva!"), (2, "zyzzyvas"), (3, "Two, WORDS"), (4, "words two"), (5, "two other words"), (6, "x a b c d e f y"), (7, "x a b c d e y"), (8, "two"), (9, None)]
    got = found(docs, spark, rows, benchmark)
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(1, 1, 1.0), (1, 5, 1.0), (3, 2, 1.0), (6, 3, 0.75)]
