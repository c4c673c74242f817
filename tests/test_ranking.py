"""Skew-safe running sums and top-k against brute force, with one hot group."""

import random

from pyspark.sql import functions as F

from tabsmith.operators.ranking import row_number_within, running_sum, top_k_within


def _frame(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else f"g{i % 17}"  # two thirds of the rows in one group
        rows.append((i, g, rnd.randint(0, 50)))
    return spark.createDataFrame(rows, "id long, g string, w long"), rows


def test_row_number_matches_brute_force(spark):
    df, rows = _frame(spark)
    got = {r["id"]: r["rn"] for r in row_number_within(df, ["g"], [F.asc("w"), F.asc("id")], out="rn", partitions=16).collect()}
    expect = {}
    for g in {r[1] for r in rows}:
        members = sorted([r for r in rows if r[1] == g], key=lambda r: (r[2], r[0]))
        for k, r in enumerate(members, 1):
            expect[r[0]] = k
    assert got == expect


def test_running_sum_weighted(spark):
    df, rows = _frame(spark)
    got = {r["id"]: r["cum"] for r in running_sum(df, ["g"], [F.desc("id")], "w", out="cum", partitions=16).collect()}
    for g in {r[1] for r in rows}:
        acc = 0
        for r in sorted([r for r in rows if r[1] == g], key=lambda r: -r[0]):
            acc += r[2]
            assert got[r[0]] == acc


def test_top_k_exact(spark):
    df, rows = _frame(spark)
    got = sorted((r["g"], r["rank"], r["id"]) for r in top_k_within(df, ["g"], [F.desc("w"), F.asc("id")], 5, "id", salt_buckets=8).collect())
    expect = []
    for g in {r[1] for r in rows}:
        members = sorted([r for r in rows if r[1] == g], key=lambda r: (-r[2], r[0]))[:5]
        expect += [(g, k, r[0]) for k, r in enumerate(members, 1)]
    assert got == sorted(expect)
