from pyspark.sql import functions as F

from tabsmith.operators import importance as I
from tabsmith.operators.ranking import row_number_within


def test_formula_pairs_move_packed_and_make_no_copies(spark, monkeypatch):
    monkeypatch.setattr(I, "CODES", 10)
    rows = [(i, float(i % 5) if i % 7 else None, "ab"[i % 2], i * 1.5, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, few double, word string, many double, y int")
    names = ["few", "word", "many"]
    assert set(I._value_lists(df, names)) == {"few", "word"}  # sixty values don't fit a byte here
    order = [F.xxhash64(F.col("repeat"), F.col("_idx")), F.col("_idx")]
    said = lambda c: F.concat_ws("|", c["few"], c["word"], c["many"])
    got = I.predicted_rows(df, said, "y", names, ["k"], 2, order)
    copies = I.shuffled_rows(df, "y", names, ["k"], 2, order).select("repeat", "feature", "actual", said({n: F.col(n) for n in names}).alias("predicted"))
    assert sorted(map(str, got.select(*copies.columns).collect())) == sorted(map(str, copies.collect()))
    whole = sorted(r["predicted"] for r in got.where("feature = '' AND repeat = 1").collect())
    assert whole == sorted(r["p"] for r in df.select(said({n: F.col(n) for n in names}).alias("p")).collect())
    # a pair has the features once on each side; before, the array of copies held every feature once a copy
    assert "few" not in got.columns and got.count() == 60 * 2 * 4


def test_numbering_of_few_groups_moves_rows_once(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id", F.lit("x" * 50).alias("wide"))
    out = row_number_within(df, ["g"], [F.desc("id")], out="n", keep=["id"], few_groups=True)
    assert set(out.columns) == {"g", "id", "n"}
    assert all(r.n == (99 - r.id) // 2 + 1 for r in out.collect())
