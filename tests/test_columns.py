import pytest
from pyspark.sql import functions as F

from commitlens.functions import history_text, names, predicates
from commitlens.operators import report

ID = "0123456789abcdef0123456789abcdef01234567"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("path, prefixes, want", [
    ("./src/a.rs", ["./src"], True), ("./src2/a.rs", ["./src"], False), ("./src", ["./src"], True), ("./src/a.rs", ["./sr"], False),
    ("./src/a.rs", ["./src/"], True), ("./src/a.rs", ["./src//./a.rs"], True), ("./src/a.rs", ["./lib", "./src"], True),
    ("./a", [], True), ("./a", ["."], True), ("./a", [""], True), ("/x/a", ["/x"], True), ("/x/a", ["./x"], False)])
def test_prefix(spark, path, prefixes, want):
    assert one(spark, path, lambda c: predicates.has_prefix(c, prefixes)) is want


@pytest.mark.parametrize("text, terms, want", [("abc", [], True), ("abc", ["b"], False), ("abc", ["B"], True), ("abc", ["x", "c"], False), ("abc", [""], False), ("a%c", ["%"], False)])
def test_contains_none(spark, text, terms, want):
    assert one(spark, text, lambda c: predicates.contains_none(c, terms)) is want


@pytest.mark.parametrize("path, want", [("./a", True), ("./.a", False), ("./.git/config", True), (".a", False)])
def test_visible(spark, path, want):
    assert one(spark, path, predicates.is_visible) is want


@pytest.mark.parametrize("path, want", [("./a.rs", "rust"), ("./a.go", "go"), ("./a.b.lua", "lua"), ("./a.txt", "undefined"), ("./go", "undefined"), ("./x.rs/y", "undefined"), ("./a.RS", "undefined")])
def test_lang(spark, path, want):
    assert one(spark, path, names.lang_of) == want


@pytest.mark.parametrize("receiver, want", [("(x)", "(x) F"), ("(*x)", "(*x) F"), ("(f *x)", "(*x) F"), ("(g *G[K, V])", "(*G[K, F"), ("(f  x)", "( F"), ("(G[K, V])", "(V]) F"), (None, "F")])
def test_qualified_name(spark, receiver, want):
    assert one(spark, receiver, lambda c: names.qualified_name(c, F.lit("F"))) == want


@pytest.mark.parametrize("log, want", [
    ("", []), (None, None), ("commit 123", []), (f"commit {ID}", [ID]), (f"commit {ID}\n+commit {ID}\n    commit {ID}\ncommit {ID[::-1]}\n", [ID, ID[::-1]]),
    (f"x\rcommit {ID} commit {ID}", []), (f"commit {ID}extra", [ID])])
def test_commit_ids(spark, log, want):
    assert one(spark, log, history_text.commit_ids) == want
    assert one(spark, log, history_text.commit_count) == len(want or [])


def test_report(spark):
    el = spark.createDataFrame([("a.rs", "rust", 1, "f"), ("a.rs", "rust", 9, "f"), ("b.go", "go", 2, "g"), ("c.lua", "lua", 3, "h")], "file string, lang string, line long, name string")
    logs = spark.createDataFrame([("a.rs", "f", f"commit {ID}\n", "ok"), ("b.go", "g", f"commit {ID}\n", "ok"), ("zz", "f", f"commit {ID}\n", "ok")], "file string, name string, log string, status string")
    rows = report.with_frequency(el, logs)
    everything = [("b.go", 2, "g", 1), ("a.rs", 1, "f", 1), ("a.rs", 9, "f", 1), ("c.lua", 3, "h", 0)]
    assert [tuple(r) for r in report.ranked(rows).collect()] == everything
    assert [tuple(r) for r in report.ranked(rows, 1, 2).collect()] == everything[1:3]
    assert report.ranked(rows, 0, 0).collect() == [] and report.ranked(rows, 9, 5).collect() == []


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("./src/a.rs", "rust")], "path string, lang string").write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    df = df.where(predicates.contains_none(F.col("path"), ["x"])).where(predicates.is_supported(F.col("lang"))).select("path")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains" in plan and "In(lang" in plan
