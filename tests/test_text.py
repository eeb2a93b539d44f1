
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.functions import scores, text, vectors

SAMPLE = "getHTTPServer_name foo-bar src/a.ts ABCd"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokenizers_differ_as_documented(spark):
    assert one(spark, text.common_terms(F.lit(SAMPLE))) == "get http server_name foo bar src ts ab cd".split()
    assert one(spark, text.camel_terms(F.lit(SAMPLE))) == "get http server name foo bar src/a.ts ab cd".split()
    assert one(spark, text.exact_terms(F.lit(SAMPLE))) == "get http server_name foo-bar src/a.ts ab cd".split()
    assert one(spark, text.lookup_tokens(F.lit("verifyToken"))) == ["verifytoken", "verify", "token"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAB1_ -./é\n", max_size=20), min_size=1, max_size=20))
def test_driver_terms_match_column_terms(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.common_terms(F.col("t")).alias("x"))
    for t, x in df.collect():
        assert list(dict.fromkeys(x)) == text.query_terms(t)


def test_sql_functions(spark):
    text.register(spark)
    assert spark.sql("SELECT common_terms('aB c_d xYz')").first()[0]
    assert spark.sql(f"SELECT exact_terms('{SAMPLE}')").first()[0] == "get http server_name foo-bar src/a.ts ab cd".split()


def test_prototype_names_are_plain_terms():
    assert text.query_terms("constructor __proto__") == ["constructor", "__proto__"]


@pytest.mark.parametrize(
    ("paths", "pattern"),
    [(["a/b/x.ts", "a/b/y.ts"], "a/b/*"), (["a/x.ts", "b/x.ts"], "*/x.ts"), (["a/m/x.ts", "a/n/x.ts"], "a/x.ts"), (["a/x.ts", "b/y.ts"], None), (["a/x.ts"], None)],
)
def test_path_pattern(spark, paths, pattern):
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert rows.agg(text.path_pattern(F.col("path"))).first()[0] == pattern


def test_vectors(spark):
    a, b = vectors.array_of([1, 0, 0]), vectors.array_of([1, 1, 0])
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(2**-0.5)
    assert one(spark, vectors.cosine(a, vectors.array_of([0, 0, 0]))) == 0
    assert one(spark, vectors.mock_vector(F.lit("hello"))) == pytest.approx(vectors.mock_embed("hello"))
    assert one(spark, vectors.clamp01(F.lit(float("nan")))) == 0
    with pytest.raises(Exception, match="different lengths"):
        one(spark, vectors.cosine(a, vectors.array_of([1.0])))
    merged = vectors.merge_pieces(F.array(a, b), F.array(F.lit(1), F.lit(3)))
    assert one(spark, merged) == pytest.approx([1, 0.75, 0])


def test_scores(spark):
    assert one(spark, scores.combined_score(F.lit(-1.0), F.lit(1.0))) == pytest.approx(0.28)
    assert one(spark, scores.combined_score(F.lit(0.4), F.lit(1.0), 0, 0)) == pytest.approx(0.4)
    assert scores.fraction(35, 0) == 0.35 and scores.fraction(None, 0.1) == 0.1 and scores.fraction(-1, 0) == 0
    assert one(spark, scores.fuse(*(F.lit(1.0),) * 4)) == pytest.approx(1)
    assert one(spark, scores.change_risk(F.lit(0), F.lit(0), F.lit(4))) == "medium"


def test_embed_column_uses_any_provider(spark):
    df = spark.createDataFrame([("a",), ("bb",), (None,)], "t string")
    got = df.select(vectors.embed_column(F.col("t"), lambda ts: [[float(len(t))] for t in ts], 2).alias("v")).collect()
    assert [r.v for r in got] == [[1.0], [2.0], [0.0]]
