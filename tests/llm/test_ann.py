import numpy as np
from pyspark.sql import functions as F

from tabsmith.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k):
    use = {(i, tuple(np.float32(v).astype(float) for v in x)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all() and any(x)}
    use = [(i, x) for i, x in use if len(x) == 6]
    out = {}
    for i, x in use:
        if is_query(i):
            near = sorted((-float(np.dot(x, y)), j) for j, y in use if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def rows():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 6)).astype(np.float32) * rng.uniform(0.5, 3, size=(400, 1)).astype(np.float32)
    out = [(int(i), [float(v) for v in x]) for i, x in enumerate(vectors)]
    out += [(1000 + i, out[7][1]) for i in range(120)]  # one very common vector
    out += [(2000, None), (2020, [0.0] * 6), (2040, [None] + [1.0] * 5), (2060, [float("nan")] * 6), (2080, [1.0, 2.0]), (None, [1.0] * 6), out[3]]
    return out


def test_exact_where_all_leaves_are_visited(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "checked_visits", lambda *a: 10_000)
    data = rows()
    table = spark.createDataFrame([(*r, 0) for r in data], SCHEMA).repartition(4).withColumnRenamed("label", "cid")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(data, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 32)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6))
    data = [(i, [float(np.float32(v)) for v in centres[i % 12] + rng.normal(size=6) * 0.3]) for i in range(3000)]
    table = spark.createDataFrame([(*r, 0) for r in data], SCHEMA)
    want = brute(data, lambda i: i % 100 == 0, 20)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_visits_match_ranks():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5))
    old = ann.LEAF
    ann.LEAF = 100
    try:
        forest = ann.Forest(x, len(x), float((x * x).sum(axis=1).max()))
    finally:
        ann.LEAF = old
    q = x[3]
    leaves, ranks = forest.leaves(x), forest.ranks(q, x)
    for n in (1, 5, 40):
        seen = set(forest.visit(q, n))
        met = np.array([any((t, leaf) in seen for t, leaf in enumerate(row)) for row in leaves])
        assert (met == (ranks <= n)).all()


def test_few_and_no_rows(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 1.0)]
    assert ann.nearest(two.limit(0), F.col("vec_id") % 20 == 0).collect() == []
