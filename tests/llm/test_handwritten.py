import pytest

from factloom.llm import handwritten

HAND = "import logging\n\ndef total(rows):\n    out = 0\n    for r in rows:\n        if r.price > 3:\n            out += r.price\n    return out\n\nclass Till:\n    def add(self, x):\n        self.x = x\n        return [self.x, 1, 'a']\n"
LIB = "\n".join(f"def step_{w}(a, b):\n    value = a.{w}(b)\n    if not value:\n        return {w!r}\n    return value + {i}" for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("# Code generated by tool v1. DO NOT EDIT.\n" + HAND, "generated"),
        (HAND + "\n// @generated from x.schema", "generated"),
        ("/*\n * AUTO-GENERATED FILE - rebuild\n */\n" + HAND, "generated"),
        ("package p;\n\n@Generated(\"tool\")\npublic class A {}\n", "generated"),
        ("# Automatisch erzeugt durch tool, nicht von Hand ändern.\r\n" + HAND, "generated"),
        ("# Helpers for the stub generator: they write the files that say \"do not edit\".\n" + HAND, None),
        (HAND + "\n# the daily report is generated by cron every night, don't edit it by hand", None),
        (HAND.replace("out = 0", "head = '# Code generated by tool'"), None),
        (HAND * 5 + "# Code generated by tool\n" + HAND * 5, None),
        ("".join(f"t[{i}] = ({i * 7}, {i % 5}, _r{i})\n" for i in range(40)), "generated"),
        ("!function(e,t){" + "var a=e(1),b=!0;if(void 0===a)b=[];" * 40 + "}", "minified"),
        ("/*! kit v1 */\n" + "a.b(c);d=e?f:g;" * 60, "minified"),
        (HAND + "QUERY = '" + "select name, value from table where x = 1 and " * 10 + "'", None),
        ("rows = [\n" + "  0x3f, 0x5c, 0x17, 0x3d,\n" * 50 + "]\n", "data"),
        ("export const t = [\n" + '  "YYSB38IVKFeNvrsYkfn85aExJu",\n' * 50 + "]", "data"),
        ("# This file is part of kit 1.2.\n# See the NOTICE shipped with kit for terms.\n" + HAND, "vendored"),
        (HAND, None),
        ("", None),
        ("  \n", None),
        ("x", None),
    ],
)
def test_kind_of_a_text(text, kind):
    assert handwritten.text_kind(text) == kind


PATHS = {
    "vendor/a/b.go": "vendored", "src/vendors/b.go": None, "node_modules/x/i.js": "vendored", "third_party/x.py": "vendored", "third_party_billing/x.py": None, "Godeps/_workspace/a.go": "vendored",
    "gen/x.go": "generated", "src/generator/x.go": None, "src/generated_reports/a.js": None, "a_pb2.py": "generated", "a_gen_test.go": None, "a_gen.go": "generated", "x.pb.go": "generated", "x.minimal.js": None, "x.min.js": "minified",
    "a/yarn.lock": "data", "data_loader.py": None, "lib/minify/a.py": None, "tools/codegen/a.py": None, "dist_matrix/a.py": None, None: None, "": None,
}


def test_kind_of_a_path(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string").withColumn("kind", handwritten.path_kind("path"))
    assert {r["path"]: r["kind"] for r in df.collect()} == PATHS


def files(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, path string, text string, shingles string, row int")


def libs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "lib_id int, text string")


@pytest.mark.parametrize("limit", [16 << 20, -1])
def test_copies_of_published_files(spark, monkeypatch, limit):
    monkeypatch.setattr(handwritten, "BROADCAST_BYTES", limit)
    adapted = "# our header\n" + LIB.replace("step_alpha", "first").replace("return value + 9", "return 9")
    rows = [(1, "a.py", LIB), (2, "b.py", adapted), (3, "c.py", HAND), (4, None, None), (5, "vendor/x.py", None), (6, "d.py", ""), (1, "a.py", LIB), (None, "e.py", HAND), (None, "e.py", LIB), (7, "f.py", LIB[:300] + HAND * 3)]
    got = sorted((r["doc_id"] or 0, r["kind"] or "") for r in handwritten.classify(files(spark, rows), libs(spark, LIB, None, "", HAND[:40])).collect())
    assert got == [(0, ""), (0, "vendored"), (1, "vendored"), (1, "vendored"), (2, "vendored"), (3, ""), (4, ""), (5, "vendored"), (6, ""), (7, "")]


def test_empty_tables(spark):
    assert handwritten.classify(files(spark, []), libs(spark, LIB)).count() == 0
    assert [r["kind"] for r in handwritten.classify(files(spark, [(1, "a.py", LIB)]), libs(spark)).collect()] == [None]


def test_long_texts(spark):
    assert handwritten.text_kind("x = 1\n" * 200_000) is None
    assert handwritten.text_kind("word another third\n" * 3 + "a " * 500_000) is None
    assert handwritten.text_kind("# " + "licence text " * 100_000 + "\n# Code generated by protoc. DO NOT EDIT.\n" + HAND) == "generated"


def test_functions_of_hand_written_files(spark):
    docs = spark.createDataFrame([(1, "r", "a.py", "src_file", LIB), (2, "r", "b.py", "src_file", HAND), (3, "r", "b.py", "review", LIB)], "doc_id bigint, repo_id string, path string, source string, text string")
    func = spark.createDataFrame([(1, "r", "a.py"), (2, "r", "b.py"), (3, "r", "vendor/c.py"), (4, "q", "a.py"), (5, "r", None)], "func_id bigint, repo_id string, path string")
    kept = handwritten.functions_by_hand(func, docs, libs(spark, LIB))
    assert {r["func_id"] for r in kept.collect()} == {2, 4, 5}  # no path, no evidence
