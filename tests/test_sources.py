import json
import subprocess
import sys

import pytest
from conftest import as_set
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factloom.functions import spans
from factloom.operators import facts, history, tree
from factloom.sources import extract as ext
from factloom.sources import files, patches
from factloom.sources.extract import Facts, extract, extract_text
from factloom.sources.parsing import Node, ParseError, Source

GO = """
package shop

type Till struct {
	*Drawer
	total, tax int `json:"x"`
	log   func(string) error
}

type Price interface { Of(x int) int }

func Open(name string, opts ...Option) string {
	t := NewTill(name)
	return t.Label(name, 3)
}

func (t *Till) Add(a, b int, f func(n int) bool) (sum int, err error) {
	return helper(a, b), nil
}

func Ptr(m map[string]int) *Till { return nil }

func raw() []int {
	_ = `not "code" { func x() {} `
	return nil
}
"""
JAVA = """
package a.b.c;

import x.Y;

@Entity
@Table(name = "t}")
public class Shop<T> extends Base<T> implements Open, Close<T> {
    private static final int MAX = 1;
    @Inject private Map<String, List<T>> byName, other;

    public Shop(int n) { super(n); }

    @Override
    @Retry(times = 3)
    public <R> List<R> find(final String key, int[] sizes, Object... rest) throws IOException {
        String s = "} class Fake {";
        return store.get(key, sizes);
    }

    abstract void none();

    enum Kind { A, B { void odd() {} }; int rank() { return 1; } }
    interface Inner { void call(); }
}
"""
KOTLIN = """
package p.q
fun top(a: Int): Int = a + 1
class Box(val n: Int) : Base(n) {
    override fun open(x: String) { println("}") }
    fun <T> List<T>.second(): T { return this[1] }
    companion object { fun make() = Box(1) }
}
interface Shape { fun area(): Double }
object Single { fun get() {} }
"""
JS = """
export default class Pen extends Base {
  constructor(color = 'a', size) { super(color); }
  static async draw(x) { return /}"/.test(x); }
  get width() { return 1; }
  handler = () => {}
}
async function load(url, n) { function inner() {} return fetch(url); }
const f = function named() {};
"""
PYTHON = '''
import x

@cached
@retry(3)
def top(a, b=1):
    """doc"""
    return x.y(a)

class Box(Base):
    size = 1

    @property
    def wide(self):
        def nested(): pass
        return nested

    async def go(self): pass
'''


def funcs(text, lang):
    return {f["signature"]: f for f in Facts(text, lang).functions()}


def span(s):
    return s and f"{s['start']['row']}:{s['start']['column']},{s['end']['row']}:{s['end']['column']}"


def test_go():
    f = funcs(GO, "GOLANG")
    assert list(f) == ["shop||Open|string|string", "shop|*Till|Add|int,func(n int) bool,int|int,error", "shop||Ptr|map[string]int|", "shop||raw||"]
    assert span(f["shop||Open|string|string"]["body_span"]) == "11:46,14:1" and f["shop||Open|string|string"]["def_line"] == 12
    c = list(Facts(GO, "GOLANG").classes())
    assert [x["signature"] for x in c] == ["shop.Till"]
    assert json.loads(c[0]["extras"])["fields"] == [{"type": "Drawer", "name": ""}, {"type": "int", "name": "total"}, {"type": "func(string) error", "name": "log"}]
    calls = [(x["src"].split("|")[2], x["caller"], x["arguments"]) for x in Facts(GO, "GOLANG").calls()]
    assert calls == [("Open", "NewTill", ["name"]), ("Open", "t.Label", ["name"]), ("Add", "helper", ["a", "b"])]


def test_java():
    f = funcs(JAVA, "JAVA")
    assert list(f) == ["a.b.c|a.b.c.Shop|find|String,int[]|List<R>", "a.b.c|a.b.c.Shop|none||void", "a.b.c|a.b.c.Kind|rank||int", "a.b.c|a.b.c.Inner|call||void"]
    find = f["a.b.c|a.b.c.Shop|find|String,int[]|List<R>"]
    assert json.loads(find["extras"]) == {"annotations": ["@Override", "@Retry(times = 3)"], "classInfo": {"packageName": "a.b.c", "className": "Shop", "annotations": ["@Entity", '@Table(name = "t}")']}}
    assert span(find["span"]) == "13:4,18:5" and find["def_line"] == 16 and f["a.b.c|a.b.c.Shop|none||void"]["body_span"] is None
    c = {x["name"]: json.loads(x["extras"]) for x in Facts(JAVA, "JAVA").classes()}
    assert list(c) == ["Shop", "Kind", "Inner"]
    assert c["Shop"]["extends"] == "Base<T>" and c["Shop"]["implements"] == ["Open"] and c["Shop"]["modifiers"] == ["public"]
    assert c["Shop"]["fields"][1] == {"name": "byName", "type": "Map<String, List<T>>", "annotations": ["@Inject"], "modifiers": ["private"]}
    assert [(x["caller"], x["arguments"]) for x in Facts(JAVA, "JAVA").calls()] == [("store.get", None)]


def test_kotlin():
    assert list(funcs(KOTLIN, "KOTLIN")) == ["p.q||top||", "p.q|p.q.Box|open||", "p.q|p.q.Box|second||", "p.q|p.q.Box|make||", "p.q|p.q.Shape|area||", "p.q||get||"]
    assert [x["name"] for x in Facts(KOTLIN, "KOTLIN").classes()] == ["Box", "Shape"]


def test_javascript():
    assert list(funcs(JS, "JAVASCRIPT")) == ["|Pen|constructor||", "|Pen|draw||", "|Pen|width||", "||load||", "||inner||"] or list(funcs(JS, "JAVASCRIPT"))[:3] == ["|Pen|constructor||", "|Pen|draw||", "|Pen|width||"]
    names = [s.split("|")[2] for s in funcs(JS, "JAVASCRIPT")]
    assert names == ["constructor", "draw", "width", "load", "inner"]
    assert funcs(JS, "JAVASCRIPT")["|Pen|draw||"]["def_line"] == 0 and [p["name"] for p in funcs(JS, "JAVASCRIPT")["|Pen|draw||"]["parameters"]] == ["x"]


def test_python():
    f = funcs(PYTHON, "PYTHON")
    assert list(f) == ["||top||", "|Box|wide||", "|Box|nested||", "|Box|go||"]
    assert json.loads(f["||top||"]["extras"]) == {"decorators": ["@cached", "@retry(3)"]}
    assert (span(f["||top||"]["span"]), span(f["||top||"]["body_span"]), f["||top||"]["def_line"]) == ("5:0,7:17", "6:4,7:17", 6)
    with pytest.raises(NotImplementedError):
        list(Facts(PYTHON, "PYTHON").calls())


@pytest.mark.parametrize("lang", ["GOLANG", "JAVA", "KOTLIN", "JAVASCRIPT"])
@pytest.mark.parametrize("text", ["", "}}}})))", "func (", "class", "fun x(", "type X struct {", "/* open", '"open', "@", "package", "class A { void f( {", "ﬁ ünïcode 한국어 {", "\r\n\t", "function f(a,{b}) {"])
def test_broken_texts_do_not_crash(lang, text):
    f = Facts(text, lang)
    assert [list(m()) is not None for m in (f.functions, f.classes, f.symbols, f.units)]


def test_columns_count_bytes():
    f = Facts("/* é */ function ü1() {}", "JAVASCRIPT")
    assert span(next(f.functions())["body_span"]) == "0:24,0:26"


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "PYTHON", "def f(:"), (2, "PYTHON", PYTHON), (3, "COBOL", "x"), (4, "PYTHON", None), (5, "PYTHON", ""), (2, "PYTHON", PYTHON)], "doc_id bigint, lang string, text string")
    got = extract(df, "func", ["doc_id"])
    assert sorted((r["doc_id"], r["name"], r["error"] is not None) for r in got.select("doc_id", "name", "error").collect() if r["doc_id"] != 2) == [(1, None, True), (3, None, True)]
    assert got.filter("doc_id = 2").count() == 8
    assert extract(df.limit(0), "unit", ["doc_id"]).count() == 0
    assert extract_text(spark, GO, "GOLANG", "symbol").count() > 10
    with pytest.raises(ValueError):
        extract_text(spark, GO, "GOLANG", "class")
    with pytest.raises(ParseError):
        Facts("", "COBOL")


def parse_toy(text):
    """Lines ``unit a.b``, ``type T``, ``fun name(p, q)`` and, indented, ``name(x)``."""
    src, root, at, inside = Source(text), Node("file", 0, len(text)), 0, None
    for line in text.split("\n"):
        end = at + len(line)
        word = line.split(" ")[-1]
        name = end - len(word)
        if line.startswith("unit "):
            root.add(Node("unit_clause", at, end).add(Node("unit_name", name, end)))
        elif line.startswith("type "):
            root.add(Node("type_declaration", at, end).add(Node("identifier", name, end)))
        elif line.startswith("fun "):
            opened = text.index("(", at)
            inside = Node("function_declaration", at, end).add(Node("identifier", at + 4, opened))
            parameters, p = Node("parameter_list", opened, end, "parameters"), opened + 1
            for x in text[opened + 1 : end - 1].split(", "):
                parameters.add(Node("parameter", p, p + len(x)).add(Node("identifier", p, p + len(x), "name")))
                p += len(x) + 2
            root.add(inside.add(parameters, body := Node("block", end, end)))
        elif line.startswith("  "):
            body.add(Node("call_expression", at + 2, end).add(Node("identifier", at + 2, text.index("(", at), "function")))
            body.end = inside.end = end
        elif line == "boom":
            raise ParseError("boom")
        at = end + 1
    return src, root


def toy_calls(facts):
    for n, above in facts.nodes:
        if n.kind == "call_expression":
            yield {"src": facts.src.of(above[-2].child("identifier")), "caller": facts.src.of(n.child("identifier"))}


def test_a_registered_language_goes_all_the_way(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
    toy = ext.Language(("function_declaration",), ("type_declaration",), "block", ("unit_clause", ("unit_name",)), parser=parse_toy)
    (tmp_path / "a.toy").write_text("unit a.b\ntype T\nfun run(p, q)\n  help(p)\nfun help(x)\n")
    (tmp_path / "b.toy").write_text("boom")
    ext.register_language("TOY", ".toy", toy)
    try:
        ext.register_extractor("TOY", "call", toy_calls)
        for wrong in (lambda: ext.register_language("TOY", ".t", toy), lambda: ext.register_language("GOLANG", ".t", toy), lambda: ext.register_language("NEW", ".t", ext.Language()), lambda: ext.register_extractor("TOY", "call", toy_calls), lambda: ext.register_extractor("JAVA", "call", toy_calls), lambda: ext.register_extractor("TOY", "x", toy_calls)):
            with pytest.raises(ValueError):
                wrong()
        src = files.scan(spark, str(tmp_path))
        assert as_set(src.select("path", "lang")) == {("a.toy", "TOY"), ("b.toy", "TOY")}
        got = extract(src, "func", ["path"])
        assert as_set(got.select("path", "signature", "error")) == {("a.toy", "a.b||run|,|", None), ("a.toy", "a.b||help||", None), ("b.toy", None, "boom")}
        assert as_set(extract(src, "class", ["path"]).filter("error is null").select("signature", "lang")) == {("a.b.T", "TOY")}
        assert as_set(extract(src, "call", ["path"]).filter("error is null").select("src", "caller")) == {("run", "help")}
        assert {"run", "help", "p", "q", "T"} <= {r[0] for r in extract(src, "symbol", ["path"]).select("symbol").collect()}
        func = got.filter("error is null").withColumns({"repo_id": F.lit("r"), "func_id": F.xxhash64("signature")})
        symbols = extract(src, "symbol", ["path"]).filter("symbol is not null").select(F.lit("r").alias("repo_id"), "path", "symbol", "span")
        from factloom.operators import graph

        ctx = graph.contexts(func, graph.call_edges(func, symbols))
        assert as_set(ctx.select("name", F.array_join("calls", ","))) == {("run", "a.b||help||"), ("help", "")}
    finally:
        ext.unregister_language("TOY")
    assert files.scan(spark, str(tmp_path)).count() == 0
    with pytest.raises(ParseError):
        Facts("", "TOY")


def test_tree_queries_equal_the_tree(spark):
    units = extract_text(spark, JAVA, "JAVA", "unit").filter("error is null").cache()
    q = tree.TreeQuery(units, ["path"])
    calls = units.filter("kind = 'method_invocation'")
    owner = q.up().kind("class_declaration", "enum_declaration").first(calls)
    assert owner.count() == calls.count() and owner.first()["content"].startswith("@Entity")
    classes = units.filter("kind = 'class_declaration'")
    first = q.down().dfs().kind("method_declaration").first(classes).first()
    assert "find" in first["content"] and q.bfs().kind("identifier").first(classes).first()["content"] == "Shop"
    assert q.of_field("name").kind("identifier").all(classes).count() > 3
    assert as_set(tree.children(units, classes, ["path"], fields=["body"]).select("kind")) == {("class_body",)}
    up = {r["kind"] for r in q.up().all(calls).collect()}
    assert {"program", "class_declaration", "class_body", "method_declaration", "block", "method_invocation"} <= up


PATCH = """diff --git a/a.py b/a.py
--- a/a.py
+++ b/a.py
@@ -1,4 +1,4 @@
 one
-two
+TWO
 three
+four
-five
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/old.py b/new.py
rename from old.py
rename to new.py
diff --git a/pic.png b/pic.png
Binary files a/pic.png and b/pic.png differ
diff --git a/c.py b/c.py
--- a/c.py
+++ b/c.py
@@ -10,2 +12,3 @@ def f
 x
+y
 z
@@ -40 +43 @@
-p
+q
"""


def test_patches():
    assert patches.parse(PATCH, exact=True) == {"a.py": [1, 3], "new.py": [], "c.py": [12, 42]}
    assert patches.parse(PATCH) == {"a.py": [2, 4], "new.py": [], "c.py": [12, 43]}
    assert patches.parse("") == {} == patches.parse("no patch\n+x\n")
    assert patches.parse("--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n a\n+b\n\\ No newline at end of file\n", exact=True) == {"x": [1]}


def test_affected_functions(spark):
    docs = spark.createDataFrame([(1, "r", PATCH), (2, "r", None)], "doc_id bigint, repo_id string, text string")
    lines = patches.affected_lines(docs, ["doc_id", "repo_id"])
    func = spark.createDataFrame([("r", "c.py", 1, "s", 10, 20), ("r", "c.py", 2, "t", 60, 61)], "repo_id string, path string, func_id bigint, signature string, a int, b int").withColumn("span", spans.make("a", F.lit(0), "b", F.lit(0)))
    assert as_set(history.patched(func, lines).select("path", "func_id")) == {("a.py", None), ("new.py", None), ("c.py", 1)}


def test_scan_and_language(spark, tmp_path):
    for name, text in (("a/x.py", "def f(): pass"), ("a/y.go", "package p"), ("z.py", "x"), ("n.txt", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.scan(spark, str(tmp_path))
    assert as_set(got.select("path", "lang")) == {("a/x.py", "PYTHON"), ("a/y.go", "GOLANG"), ("z.py", "PYTHON")}
    assert as_set(files.scan(spark, str(tmp_path), "PYTHON", include="^a/").select("path", "text")) == {("a/x.py", "def f(): pass")}
    assert facts.guess_lang(got).first()["lang"] == "PYTHON"
    tie = spark.createDataFrame([("a.js",), ("b.java",), ("c.txt",)], "path string")
    assert facts.guess_lang(tie).first()["lang"] == "JAVA" and facts.guess_lang(tie.filter("path = 'c.txt'")).first()["lang"] == "UNKNOWN"


@pytest.fixture()
def git(tmp_path):
    d = tmp_path / "repo"
    d.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(d), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for k, text in enumerate(("def first():\n    pass\n", "def first():\n    pass\n\n\ndef second():\n    first()\n    return 1\n")):
        (d / "m.py").write_text(text)
        (d / "blob.py").write_bytes(b"\0\1")
        run("add", "-A")
        run("commit", "-qm", f"c{k}", "--date", f"2024-01-0{k + 1}T00:00:00")
    return str(d)


def test_git_and_command_line(spark, git, tmp_path):
    from factloom.__main__ import diff, history_graphs, main, upload
    from factloom.api import Engine

    assert files.commits(spark, git).count() == 2 and files.commits(spark, git, 1).count() == 1
    assert as_set(files.tree(spark, git).select("path")) == {("m.py",)}
    e = Engine(spark, str(tmp_path / "store"))
    upload(spark, e, git, "r", 2)
    rev = files.commits(spark, git, 1).first()["rev_hash"]
    assert as_set(e.context("r", rev, "||second||").select(F.array_join("calls", ","))) == {("||first||",)}
    assert as_set(diff(spark, git, "HEAD~1", "HEAD", True).select("path", "signature", "reference_count")) == {("m.py", "||second||", 1)}
    dot = {}
    for r in history_graphs(spark, git, None).orderBy("part", "line").collect():
        dot.setdefault(r["rev_hash"], []).append(r["line"])
    assert len(dot) == 2 and all('"m.py"->"//first//";' in x and x[0].startswith("digraph") and x[-1] == "}" for x in dot.values())
    filled = {x for x in dot[rev] if "fillcolor" in x}
    assert {x.split(" [")[0] for x in filled} == {'"m.py"', '"//second//"'}
    assert not any("fillcolor" in x for r, ls in dot.items() if r != rev for x in ls)
    assert main(["history", "--src", git, "--output", str(tmp_path / "dots")]) == 0
    assert spark.read.text(str(tmp_path / "dots") + f"/rev_hash={rev}").count() == len(dot[rev])
    assert main(["extract", "--src", git, "--output", str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out")).filter("name = 'second'").count() == 1


def test_python_with_a_syntax_error_keeps_its_facts(spark):
    broken = PYTHON + "\ndef open_(a, (b:\n    print 'old'\n\nclass After:\n    def kept(self, x=f'{y.z}'):\n        return call(k=1\n\nasync def last(): pass\n"
    got = extract(spark.createDataFrame([(1, "PYTHON", broken)], "doc_id bigint, lang string, text string"), "func", ["doc_id"]).collect()
    assert [(r["name"], r["receiver"]) for r in got] == [("top", ""), ("wide", "Box"), ("nested", "Box"), ("go", "Box"), ("kept", "After"), ("last", "")]
    assert all(r["error"] for r in got) and json.loads(got[0]["extras"])["decorators"] == ["@cached", "@retry(3)"]
    f = Facts(broken, "PYTHON")
    assert [c["name"] for c in f.classes()] == ["Box", "After"]
    assert {("y", ""), ("z", "attribute"), ("k", "name"), ("last", "name")} <= {(x["symbol"], x["field_name"]) for x in f.symbols()}


def test_python_scanner_equals_the_compiler(monkeypatch):
    from factloom.sources import parsing

    text = PYTHON + "\nif x:\n\tclass T(Base, metaclass=M):\n\t\t'd' 'e'\n\t\tdef f(self, *a: int, k: str = '''(\n''') -> dict[str, int]:  # é\n\t\t\treturn [f\"{e!r:>{w}}\", lambda q: q,\n 1]\n"

    def facts():
        f = Facts(text, "PYTHON")
        return f.src.error, [sorted(map(str, m())) for m in (f.functions, f.classes, f.symbols)]

    def fail(*_):
        raise SyntaxError("no")

    error, whole = facts()
    monkeypatch.setattr(parsing.ast, "parse", fail)
    assert error is None and facts() == ("no", whole)


@pytest.mark.parametrize("text", ["", "async", "@", "def", "def f(:", "class", "'''open", 'f"{', "f'{a:{b}", "def f(x)\n  y\n z", "}}}])", "\0", "\r\n\t(", "@a\n@b\n  def f(): pass\n x"])
def test_broken_python_does_not_crash(text):
    f = Facts("1 +\n" + text, "PYTHON")
    assert f.src.error and [list(m()) is not None for m in (f.functions, f.classes, f.symbols, f.units)]


def test_analysed_keeps_files_with_a_syntax_error(spark, capsys):
    from factloom.__main__ import analysed

    src = spark.createDataFrame([("r", "a.py", "PYTHON", "def kept(): pass\nprint 'x'\n")], "repo_id string, path string, lang string, text string")
    assert [r["name"] for r in analysed(src, ["repo_id"]).collect()] == ["kept"]
    assert "a.py: " in capsys.readouterr().err


def test_upload_and_diff_take_large_files(spark, git, tmp_path):
    from pathlib import Path

    from factloom.__main__ import diff, history_graphs, upload
    from factloom.api import Engine

    (Path(git) / "large.py").write_text("def large():\n    pass\n" + "# x\n" * 300_000)
    for a in (["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "large"]):
        subprocess.run(["git", "-C", git, *a], check=True, capture_output=True)
    e = Engine(spark, str(tmp_path / "store"))
    upload(spark, e, git, "r", 1)
    rev = files.commits(spark, git, 1).first()["rev_hash"]
    assert e.context("r", rev, "||large||").count() == 1
    assert ("large.py", "||large||") in as_set(diff(spark, git, "HEAD~1", "HEAD", True).select("path", "signature"))
    assert not any("large" in r["line"] for r in history_graphs(spark, git, 1).collect())


def test_a_content_is_parsed_once(spark, git, tmp_path, monkeypatch):
    """Two revisions and two files of one content: one blob is read and parsed."""
    from pathlib import Path

    from factloom.sources import extract as module

    (Path(git) / "copy.py").write_text((Path(git) / "m.py").read_text())
    for a in (["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "copy"]):
        subprocess.run(["git", "-C", git, *a], check=True, capture_output=True)
    seen, real = [], module.extract
    monkeypatch.setattr(module, "extract", lambda f, *a: seen.append(f) or real(f, *a))
    listed = files.index(spark, git, ["HEAD", "HEAD~1"])
    got = files.facts_of(listed, git, "func")
    assert seen[0].filter("text like '%second%'").count() == 1
    assert got.filter("name = 'second'").count() == 3 and got.select("rev_hash").distinct().count() == 2


STATEMENTS = {
    "GOLANG": ("package p\nfunc f(a []int) int {\n\tfor i := 0; i < n(a); i++ {\n\t\tif ok(i) {\n\t\t\treturn g(i)\n\t\t} else if b {\n\t\t\tdefer h()\n\t\t} else { k() }\n\t}\n\tswitch x { case 1: go m() }\n\treturn 0\n}\n",
        [("for_statement", "for i"), ("if_statement", "if ok"), ("return_statement", "return g(i)"), ("if_statement", "if b"), ("defer_statement", "defer h()"), ("expression_switch_statement", "switch x"), ("go_statement", "go m()"), ("return_statement", "return 0")]),
    "JAVA": ("class A { int f(int a) { try (R r = o()) { while (a > 0) a = g(a); } catch (E e) { throw new X(e); } finally { h(); } do { k(); } while (a < 3); if (a == 1) return 2; else return 3; } }",
        [("try_statement", "try (R"), ("while_statement", "while (a > 0) a = g(a);"), ("throw_statement", "throw new X(e);"), ("do_statement", "do {"), ("if_statement", "if (a == 1)"), ("return_statement", "return 2;"), ("return_statement", "return 3;")]),
    "KOTLIN": ("fun f(a: Int): Int {\n    val x = if (a > 1) g(a) else h()\n    when (x) { 1 -> k() }\n    for (i in 1..2) { m(i) }\n    return x\n}\n",
        [("if_expression", "if (a > 1) g(a) else h()"), ("when_expression", "when (x)"), ("for_statement", "for (i"), ("jump_expression", "return x")]),
    "JAVASCRIPT": ("function f(a) {\n  for (const x of a) { if (x.if) g(x)\n  else h() }\n  try { k() } catch { throw m() }\n  return a\n}\n",
        [("for_statement", "for (const"), ("if_statement", "if (x.if) g(x)\n  else h()"), ("try_statement", "try {"), ("throw_statement", "throw m()"), ("return_statement", "return a")]),
    "PYTHON": ("def f(a):\n    for x in a:\n        if g(x):\n            return h(x)\n    with o() as r:\n        y = k(r)\n    raise E\n",
        [("for_statement", "for x"), ("if_statement", "if g"), ("call", "g(x)"), ("return_statement", "return h(x)"), ("call", "h(x)"), ("with_statement", "with o"), ("call", "o()"), ("assignment", "y = k(r)"), ("call", "k(r)"), ("raise_statement", "raise E")]),
}


@pytest.mark.parametrize("lang", sorted(STATEMENTS))
def test_statements_are_nodes(lang):
    text, want = STATEMENTS[lang]
    f = Facts(text, lang)
    kinds = {k for k, _ in want}
    got = [(n.kind, f.src.of(n)) for n, _ in f.nodes if n.kind in kinds]
    assert [k for k, _ in got] == [k for k, _ in want] and all(g.startswith(w) for (_, g), (_, w) in zip(got, want))
    for n, above in f.nodes:  # inside what is above
        assert not above or above[-1].start <= n.start <= n.end <= above[-1].end
    # a call knows the statements around it
    names = {f.src.of(n): [x.kind for x in above if x.kind in kinds] for n, above in f.nodes if n.kind.endswith("identifier")}
    assert names["g"][0] == want[0][0] or lang == "KOTLIN"


@pytest.mark.parametrize("lang", ["GOLANG", "JAVA", "KOTLIN", "JAVASCRIPT"])
@pytest.mark.parametrize("text", ["if", "if (", "for {", "do while", "try catch finally", "else else", "if (a) if (b) if (c)", "return", "switch ((((", "for ;;", "while () do {", "if x {} else", "return {", "a.if(b)", "try { } catch"])
def test_broken_statements_do_not_crash(lang, text):
    for whole in (text, f"func f() {{ {text} }}", f"class A {{ void f() {{ {text} }} }}", f"fun f() {{ {text}", f"function f() {{ {text} }}"):
        assert [list(m()) is not None for m in (Facts(whole, lang).functions, Facts(whole, lang).symbols, Facts(whole, lang).units)]
