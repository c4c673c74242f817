import numpy as np

from tabsmith.operators.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy_linear(spark):
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 40, 997).astype(float)
    b = rnd.normal(size=501)
    rows = [(float(x), None) for x in a] + [(None, float(y)) for y in b]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {(r["column_name"], r["prob"]): r["value"] for r in exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75]).collect()}
    for col, vals in (("a", a), ("b", b)):
        for p in (0.25, 0.5, 0.75):
            assert abs(got[(col, p)] - np.quantile(vals, p)) < 1e-9
