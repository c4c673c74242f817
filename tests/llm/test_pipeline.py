import corpus_pipeline as P
from tabsmith.llm.neardup import Rule

from tests.conftest import SMOKE
from tests.llm.test_neardup import brute


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    extra = docs.selectExpr("*", "doc_id as score", "'x' as cls", "1 as `predicted`")
    columns = extra.columns
    n = extra.count()
    for name, stage in P.STAGES[:4]:
        after = P.written(stage(spark, extra, SMOKE), "test")
        assert after.columns == columns and after.count() <= n, name
        n, extra = after.count(), after
    last = P.STAGES[4][1](spark, extra, SMOKE)
    assert last.count() == n and last.where("not round_trip").count() == 0


def test_near_duplicate_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    table = spark.createDataFrame(rows + [(None, "alone in the world it is"), rows[0], (9_999, "")], "doc_id long, text string")
    want = sorted(d for d, _, c in brute(rows, Rule(5, 80, 100)) if d == c)
    got = sorted((r.doc_id for r in P.drop_near_duplicates(spark, table, SMOKE).collect()), key=str)
    assert got == sorted([*want, None, 9_999], key=str)


def test_unknown_language_goes(spark):
    rows = [(i, "the cat and the dog sat on that mat", "en") for i in range(5)] + [(10, "1234 !!", None), (11, None, None), (12, "Жизнь прекрасна и удивительна " * 5, None), (13, "a cat", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(r.doc_id for r in P.drop_unknown_language(spark, table, SMOKE).collect())
    assert got == [0, 1, 2, 3, 4, 13]


def test_run_is_registered(spark):
    import __spark_entry__ as E

    got = E.queries()["pipeline"](spark, SMOKE)
    assert got.columns == ["doc_id", "ids", "n_ids", "round_trip"] and got.count() > 0 and "pipeline" not in E.oracle_sql()


def test_empty_table_and_long_texts(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    long = docs.where("doc_id % 50 = 0").selectExpr("doc_id + 100000 as doc_id", "repeat(text, 3000) as text", "lang", "source", "n_chars")
    assert long.selectExpr("max(octet_length(text))").first()[0] > 1_000_000
    for table in (docs.limit(0), docs.unionByName(long)):
        n = table.count()
        for name, stage in P.STAGES:
            after = P.written(stage(spark, table, SMOKE), "test")
            assert after.count() <= n, name
            table = after
        assert (n == 0) == (table.count() == 0)
