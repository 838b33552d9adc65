from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from seekframe.sources import diffs, parsers, records, walk
from seekframe.streaming import watch

PYTHON = '''"""Doc."""
import os
from a.b import c

LIMIT = 3


class Box(Base):
    """A box."""

    def open(self, key: Key):
        key.turn(1)
        return helper(LIMIT)


def helper(n):
    total = n
    return total
'''


def test_python_parser():
    out, error = parsers.parse_one(PYTHON, "python")
    assert error is None
    assert [(s["qualified_name"], s["kind"]) for s in out.symbols] == [("module", "module"), ("LIMIT", "constant"), ("Box", "class"), ("Box.open", "method"), ("helper", "function")]
    assert {"caller": "Box.open", "callee_name": "turn", "hint": "Key", "line": 12} in out.calls
    assert out.types == [{"from_symbol": "Box", "to_type_name": "Base", "edge_kind": "extends"}]
    assert [i["imported_from"] for i in out.imports] == ["os", "a.b"]
    assert ("total", 17, 18, "use") in parsers.def_use(PYTHON)
    assert any(c["granularity"] == "statement" for c in parsers.sub_chunks(PYTHON))


@pytest.mark.parametrize(
    ("language", "text", "names"),
    [
        ("javascript", "import x from './x'\nexport class A extends B {\n  run(a) {\n    go(a)\n  }\n}\nconst f = (x) => x\n", ["A", "run", "f"]),
        ("typescript", "export interface P { a: string }\nexport enum E { A }\n", ["P", "E"]),
        ("go", "package m\n\ntype S struct {\n}\n\nfunc (s *S) Run() {\n\tgo1()\n}\n\nfunc main() {}\n", ["S", "Run", "main"]),
        ("rust", "pub struct S;\nimpl S {\n    pub fn new() -> S {\n        make()\n    }\n}\n", ["S", "new"]),
        ("java", "import a.b.C;\npublic class A extends B {\n    public int run(int x) {\n        return x;\n    }\n}\n", ["A", "run"]),
        ("ruby", "class A < B\n  def run\n    go(1)\n  end\nend\n", ["A", "run"]),
        ("c", "#define N 3\nstruct s {\n};\nint main(void) {\n  go();\n}\n", ["N", "s", "main"]),
        ("markdown", "# A\ntext\n## B\n", ["A", "B"]),
        ("json", '{"a": {"b": 1}, "dependencies": {"left-pad": "1"}}', ["a", "b", "dependencies", "left-pad"]),
        ("toml", "[tool]\nx = 1\n", ["tool", "x"]),
        ("yaml", "a:\n  b: 1\n", ["a", "b"]),
        ("css", ".a { color: red }\n--v: 1;\n@media print {\n", [".a", "--v", "@media print"]),
        ("html", '<main id="m"><x-y></x-y></main><script src="a.js"></script>', ["m", "x-y"]),
        ("shell", "echo\n" * 130, ["section_1", "section_2", "section_3"]),
        ("python", "def broken(:\n", ["section_1"]),
    ],
)
def test_parsers(language, text, names):
    assert [s["name"] for s in parsers.parse_one(text, language)[0].symbols] == names


def test_parse_table_with_nulls(spark):
    files = spark.createDataFrame([("a.py", "python", PYTHON), ("b.py", "python", None), ("c", "unknown", "")], "rel_path string, language string, text string")
    assert {r["rel_path"]: len(r["symbols"]) for r in parsers.parse(files).collect()} == {"a.py": 5, "b.py": 0, "c": 0}
    ids = parsers.symbols(parsers.parse(files)).select("id").distinct().count()
    assert ids == 5


def test_walk(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("*.log\nout/\n")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "x.log").write_text("")
    for d in ("out", "node_modules", "sub"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "b.md").write_text("# b\n")
    (tmp_path / "sub" / ".gitignore").write_text("!keep.log\n")
    (tmp_path / "sub" / "keep.log").write_text("")
    (tmp_path / "Dockerfile.prod").write_text("FROM x\n")
    (tmp_path / "sub" / "loop").symlink_to(tmp_path)
    assert walk.listing(str(tmp_path)) == [".gitignore", "Dockerfile.prod", "a.py", "sub/.gitignore", "sub/b.md", "sub/keep.log"]
    got = {r["rel_path"]: r["language"] for r in walk.repository(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "sub/b.md": "markdown", "Dockerfile.prod": "dockerfile"}


def test_diff_hunks(spark):
    text = "+++ b/f.py\n@@ -1 +1,2 @@\n-a\n+b\n+c\n@@ -5,2 +6 @@\n same\n@@ -9 +9 @@\n same\n"
    got = [(r["hunk"], r["old_count"], r["new_count"], r["added"], r["removed"]) for r in diffs.hunks(spark.createDataFrame([(1, text)], "id bigint, text string")).orderBy("hunk").collect()]
    assert got == [(1, 1, 2, "b\nc", "a"), (2, 2, 1, "", "")]


def test_records(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("\x1eh1\x1ffix AB-1\x1f\na.py\nb.py\n\x1eh2\x1fnone\x1f\n")
    assert [(r["commit_id"], r["files"]) for r in records.git_log(spark, str(log)).orderBy("commit_id").collect()] == [("h1", ["a.py", "b.py"]), ("h2", [])]
    report = tmp_path / "report.json"
    report.write_text(json.dumps({"results": [{"check_id": "r", "path": "a.py", "start": {"line": 3}, "extra": {"metadata": {"severity": "warning"}}}]}))
    r = records.findings(spark, str(report)).first()
    assert (r["severity"], r["source_file"], r["sink_line"]) == ("WARNING", "a.py", 3)
    golden = tmp_path / "golden.jsonl"
    golden.write_text('{"query": "q", "relevant_files": ["a.py"]}\n')
    assert records.golden_set(spark, str(golden)).count() == 1
    golden.write_text('{"query": ""}\n{"query": "q", "relevant_files": ["/abs"]}\n')
    with pytest.raises(ValueError, match="2 bad lines"):
        records.golden_set(spark, str(golden))
    pages = tmp_path / "pages"
    pages.mkdir()
    body = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "hello"}]}]}
    (pages / "1.json").write_text(json.dumps({"issues": [{"key": "AB-1", "self": "u", "fields": {"summary": "s", "description": body, "status": "open"}}]}))
    spark.dataSource.register(records.ArtifactSource)
    r = spark.read.format("tickets").load(str(pages)).first()
    assert (r["source_ref"], r["body"], r["metadata"]) == ("ticket:AB-1", "hello", {"status": "open"})
    with pytest.raises(LookupError):
        records.replay_plans(spark.createDataFrame([("Q ",)], "query string"), spark.createDataFrame([("z", "p")], "query string, plan string"))


def test_stream_index_is_idempotent(spark, tmp_path):
    data = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v bigint, t string")
    data.where("v = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        watch.index(watch.files(spark, str(tmp_path / "in"), data.schema, 1), str(tmp_path / "t"), str(tmp_path / "c"), ["k"], "v").awaitTermination()
        data.where("v = 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = sorted((r["k"], r["v"], r["t"]) for r in watch.generation(spark, str(tmp_path / "t")).collect())
    assert got == [("a", 2, "y"), ("b", 1, "z")]


def test_stream_debounce(spark, tmp_path):
    at = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s / 10.0)"
    spark.createDataFrame([("p", 0, "a"), ("p", 3, "b"), ("p", 30, "c"), ("q", 10000, "d")], "path string, s bigint, e string").withColumn("ts", F.expr(at)).drop("s").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = watch.drain(watch.debounced(watch.files(spark, str(tmp_path / "in"), schema), "path", "ts", late="1 second"), f"file://{tmp_path}/out")
    assert sorted((r["path"], r["e"], r["events"]) for r in out.collect()) == [("p", "b", 2), ("p", "c", 1)]


@pytest.mark.parametrize(
    ("pattern", "hits", "misses"),
    [
        ("*.log", ["a.log", "x/a.log"], ["a.log.txt"]),
        ("/a/*.py", ["a/b.py"], ["a/b/c.py", "x/a/b.py"]),
        ("**/tmp", ["tmp", "a/b/tmp"], ["tmpx"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["ab", "x/a/b"]),
        ("out/**", ["out/x", "out/x/y"], ["out"]),
        ("doc/", ["doc", "x/doc"], ["docs"]),
        ("f?[!a-c].txt", ["fxd.txt"], ["fxa.txt", "f/d.txt"]),
        (r"\#x", ["#x"], ["x"]),
    ],
)
def test_ignore_patterns(pattern, hits, misses):
    regex = walk.pattern_regex(pattern)
    assert all(regex.fullmatch(h) for h in hits) and not any(regex.fullmatch(m) for m in misses)


def test_conditional_folders_and_odd_names(spark, tmp_path):
    for name in ("packages/a.py", "bin/b.py", "js/packages/c.py", "js/bin/d.py", "js/bin2/e[1] {x}+%20.py", "net/packages/f.py", "node_modules/g.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    (tmp_path / "js/package.json").write_text(json.dumps({"workspaces": [], "bin": {"t": "./bin/d.py"}}))
    (tmp_path / "net/lerna.json").write_text("{}")
    (tmp_path / "net/A.csproj").write_text("<x/>")
    found = ["js/bin/d.py", "js/bin2/e[1] {x}+%20.py", "js/package.json", "js/packages/c.py", "net/A.csproj", "net/lerna.json"]
    assert walk.listing(str(tmp_path)) == found
    assert sorted(r["rel_path"] for r in walk.repository(spark, str(tmp_path)).collect()) == found
    (tmp_path / "none").mkdir()
    assert walk.repository(spark, str(tmp_path / "none")).count() == 0


def test_registry(spark, tmp_path):
    path = tmp_path / "repos.json"
    assert records.registry(spark, str(path)).count() == 0
    path.write_text(json.dumps({"repos": [{"alias": "a", "path": "/a"}, {"alias": "b", "path": "/b", "weight": 0.5}]}))
    assert sorted((r["alias"], r["weight"]) for r in records.registry(spark, str(path)).collect()) == [("a", 1.0), ("b", 0.5)]
    path.write_text("not json")
    assert records.registry(spark, str(path)).count() == 0
    path.write_text(json.dumps({"repos": [{"alias": "a", "path": "/a"}] * 2}))
    with pytest.raises(ValueError, match="twice"):
        records.registry(spark, str(path))
