import pytest
from conftest import as_set
from pyspark.sql import functions as F

from factloom.functions import names, rules, spans


def S(text):
    (a, b), (c, d) = (map(int, p.split(":")) for p in text.split(","))
    return spans.make(*(F.lit(x) for x in (a, b, c, d)))


@pytest.mark.parametrize(
    ("self_", "other", "want"),
    [("1:2,1:3", "2:2,2:3", False), ("1:2,5:10", "5:11,10:13", False), ("1:2,5:10", "5:8,10:13", True), ("5:10,5:20", "5:0,5:3", True), ("5:0,5:3", "5:10,5:20", False), ("3:4,6:2", "1:0,3:4", True), ("3:4,6:2", "1:0,3:3", False)],
)
def test_touching_spans(spark, self_, other, want):
    assert spark.range(1).select(spans.touches(S(self_), S(other))).first()[0] is want


@pytest.mark.parametrize(("line", "want"), [(8, False), (9, True), (19, True), (20, False)])
def test_lines_count_one_further(spark, line, want):
    s = S("10:0,20:5")
    assert spark.range(1).select(spans.has_line(s, line), spans.has_any_line(s, [0, line]), spans.has_any_line(s, [])).first()[:] == (want, want, False)


def test_null_spans(spark):
    none = F.lit(None).cast(spans.SPAN)
    r = spark.range(1).select(spans.touches(none, S("0:0,9:9")), spans.rows_overlap(none, S("0:0,9:9")), spans.has_line(none, 1), spans.text(none), spans.rows(S("3:0,5:1")), spans.text(S("3:0,5:1"))).first()
    assert r[:] == (False, False, False, None, [3, 4, 5], "3:0,5:1")


def test_keys(spark):
    df = spark.createDataFrame([(None, "*P", "f", [("int", "a"), (None, "b")], None, "a/b.go")], "namespace string, receiver string, name string, parameters array<struct<type:string,name:string>>, returns array<struct<type:string,name:string>>, path string")
    r = df.select(names.signature(), names.path_prefixes("path"), names.directory("path"), names.dot_text(F.lit("a|b:c\\d")), names.directory(F.lit("x"))).first()
    assert r[:] == ("|*P|f|int,|", ["a", "a/b.go"], "a", "a/bc\\\\d", ".")
    r = df.select(names.relative_path(F.lit("/x/y\\z.py"), "/x"), names.relative_path(F.lit("/x"), "/x"), names.call_index(F.lit("s"), F.lit("c"))).first()
    assert r[:] == ("y/z.py", ".", "s->c")


def test_workspace_needs_both_parts(spark):
    df = spark.createDataFrame([("r", "v")], "repo_id string, rev_hash string").select(names.workspace().alias("w"))
    assert df.select(*names.workspace_parts("w")).first()[:] == ("r", "v")
    with pytest.raises(Exception, match="must be given"):
        spark.createDataFrame([("r", "")], "repo_id string, rev_hash string").select(names.workspace()).collect()


@pytest.mark.parametrize(("pattern", "text", "want"), [("a$", "a\n", False), ("a.b", "a\rb", True), ("a.b", "a\nb", False), ("[$]", "$", True), ("[]a]", "]", True), ("b", "abc", True), (".*", "", True), ("\\$", "$", True), ("[[]", "[", True)])
def test_patterns(spark, pattern, text, want):
    assert spark.range(1).select(rules.matches(F.lit(text), pattern)).first()[0] is want


@pytest.mark.parametrize("bad", ["(?=a)", "(?!a)", "(?<=a)", "(?<!a)", r"(a)\1", "a\\", "a++"])
def test_patterns_that_need_backtracking_are_refused(bad):
    with pytest.raises(ValueError):
        rules.java_pattern(bad)


def test_fields(spark):
    df = spark.createDataFrame([(1, [("int", "a")], '{"a":{"b":[1,2]},"n":null}', ["x", "y"])], "def_line int, parameters array<struct<type:string,name:string>>, extras string, calls array<string>")
    want = {"defLine": "1", "parameters.#": "1", "parameters.0.type": "int", "parameters.#.name": '["a"]', "extras.a.b.1": "2", "extras.n": "", "extras.none": "", "calls": '["x","y"]', "calls.#": "2", "calls.9": "", "nothing": ""}
    assert df.select(*(rules.field(df, p).alias(str(i)) for i, p in enumerate(want))).first()[:] == tuple(want.values())
    for bad in ("parameters.@reverse", "extras.a*"):
        with pytest.raises(ValueError):
            rules.field(df, bad)
    with pytest.raises(ValueError):
        rules.condition(df, {})
    assert as_set(df.filter(rules.condition(df, {"calls": "x", "defLine": lambda c: c.cast("int") > 0})).select("def_line")) == {(1,)}
