from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import align, dependencies, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_code_tokens_keep_the_empty_token(spark):
    code = "import pandas as pd\ndf=pd.read_csv('a.csv',x=.5)"
    assert set(one(spark, text.code_tokens(F.lit(code)))) == {"import", "pandas", "as", "pd", "df", "read_csv('a", "csv'", "x", "", "5)"}


def test_jaccard_of_empty_is_zero(spark):
    assert one(spark, text.token_jaccard(F.lit(""), F.lit("a"))) == 0
    assert one(spark, text.token_jaccard(F.lit(None).cast("string"), F.lit("a"))) == 0
    assert one(spark, text.token_jaccard(F.lit("a b"), F.lit("b c"))) == pytest.approx(1 / 3)


def test_jaccard_is_symmetric_and_bounded(spark):
    rows = [("a b c", "b c d"), ("", "x"), ("a=b,c", "c b a"), (None, None), ("x x x", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select(text.token_jaccard("a", "b").alias("x"), text.token_jaccard("b", "a").alias("y")).collect():
        assert r["x"] == r["y"] and 0 <= r["x"] <= 1


def test_line_jaccard_ignores_blanks(spark):
    assert one(spark, text.line_jaccard(F.lit("a  =\t1\n\nb"), F.lit("a = 1\nc"))) == pytest.approx(1 / 3)


def test_cosine(spark):
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0)))) == pytest.approx(1)
    assert one(spark, text.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0


@pytest.mark.parametrize(
    ("name", "want"),
    [("k-means-versus-hierarchical-on-indian-food.ipynb", "shierarchicalonindianfood"), ("a/b_c/d-e.ipynb", "bcde"), ("x", "x")],
)
def test_clean_notebook_name(spark, name, want):
    assert one(spark, text.clean_notebook_name(F.lit(name))) == want


@pytest.mark.parametrize(
    ("code", "want"),
    [("from sklearn.svm import SVC", ["SVC"]), ("import numpy as np", ["numpy"]), ("import numpy as np, pandas as pd", ["numpyasnp", "pandas"]), ("import os # c", ["os"]), ("x = 1", [])],
)
def test_imports(spark, code, want):
    assert one(spark, text.imports(F.lit(code))) == want


def test_column_and_node_names(spark):
    assert text.clean_column_name("a (b) %c") == "abc"
    got = [one(spark, text.node_type(F.lit(t))) for t in ("<class 'pandas.DataFrame'>", "<class 'module'>", "<class 'int'>")]
    assert got == ["Var", "Module", "NotTableVar"]
    assert [one(spark, text.is_index_column(F.lit(c))) for c in ("Unnamed: 0", "my_index", "x")] == [True, True, False]
    assert one(spark, text.notebook_of(F.lit("3_df_nb1"))) == "nb1"


def plain_alignment(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = max(0, m[i][j] + (1 if x == y else -1), m[i][j + 1] - 1, m[i + 1][j] - 1)
    return m[-1][-1] / min(len(a), len(b)) if a and b else 0.0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_suffix_alignment_equals_the_plain_matrix(a, b):
    assert align.suffix_alignment(a, b) == pytest.approx(plain_alignment(a, b))


def test_suffix_udf(spark):
    df = spark.createDataFrame([("abc", "xabc"), (None, "a"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(align.suffix_similarity("a", "b")).collect()] == [1.0, 0.0, 0.0]


CODE = "import pandas as pd\ndf = pd.read_csv('a')\nx = df['a'] + df.b\ny, z = f(x), [x, 1]\nx += y"


def test_assignments():
    got = dependencies.assignments(CODE)
    assert [(line, left) for line, left, _ in got] == [(2, ["df"]), (3, ["x"]), (4, ["y", "z"]), (5, ["x"])]
    reads = {line: set(r) for line, _, r in got}
    assert reads[2] == {("pd", "read_csv")} and reads[3] == {("df", "Index"), ("df", "b")} and reads[4] == {("x", "f"), ("x", "List")}


def test_flow_edges_use_the_latest_definition():
    edges = dependencies.flow_edges("a = 1\nb = a * 2\na = b\nc = a > b")
    assert ("var_a_1", "var_b_2", "Mult") in edges and ("var_a_3", "var_c_4", "Gt") in edges and ("var_b_2", "var_c_4", "Gt") in edges
    assert dependencies.flow_edges("b = unknown + 1") == [("var_unknown_1", "var_b_1", "Add")]
    assert dependencies.flow_edges("not code (") == [] and dependencies.flow_edges("") == []


def test_bad_lines_and_magics_are_left_out():
    assert dependencies.assignments("%matplotlib inline\nx = 1\nthis is no code\n!ls\ny = x")[-1][1:] == (["y"], [("x", "Assign")])


def test_star_stops():
    edges = [(f"n{i}", f"n{i + 1}", "op") for i in range(500)]
    assert len(dependencies.star(edges, "n0")) <= dependencies.STAR_STEPS
    assert Counter(dependencies.star([("a", "b", "x"), ("c", "a", "y")], "a")["a"]) == Counter(["+x", "-y"])


def test_variables_table_function(spark):
    dependencies.register(spark)
    spark.createDataFrame([(CODE,)], "code string").createOrReplaceTempView("src")
    assert {r["var"] for r in spark.sql("SELECT v.var FROM src, LATERAL code_variables(src.code) v").collect()} == {"df", "x", "y", "z"}


def test_assignments_in_functions_do_not_count():
    from weftline.functions.dependencies import assignments

    code = "def f(x):\n    y = x + 1\n    return y\nfor i in z:\n    a = f(i)\nclass C:\n    k = 1\nif a:\n    b = a"
    assert [(line, left) for line, left, _ in assignments(code)] == [(5, ["a"]), (9, ["b"])]
