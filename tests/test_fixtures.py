"""Small source trees and hand-written tables: extraction, resolution, file graph, reconciliation, views, sources."""

import itertools
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from strandline import api
from strandline.functions import paths as P
from strandline.functions import text as T
from strandline.operators import filegraph, fold, graph, notes, resolve, search, traversal, view
from strandline.sources import analyze, extract, files, git, project

FOUR = {
    "src/util.ts": "export function greet(n: string) {\n  return n;\n}\n",
    "src/app.ts": "import { greet } from './util';\nimport './styles.css';\nexport function main() {\n  greet('x');\n}\n",
    "src/styles.css": "a { color: red }\n",
    "index.html": "<link rel=stylesheet href=src/styles.css>\n",
}


def tree(tmp_path, spec):
    for path, text in spec.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{tmp_path}"


def facts_of(spark, spec):
    return extract.extract(spark.createDataFrame(list(spec.items()), "path string, content string"))


def named(nodes, edges, key="name"):
    name = {r["id"]: f"{r['path']}:{r['name']}" if key == "name" else r["k"] for r in nodes.collect()}
    return {(r["type"], name[r["src"]], name[r["dst"]]): r for r in edges.collect()}


def test_four_file_tree(spark, tmp_path):
    root = tree(tmp_path, FOUR)
    fn, fe, _ = api.scan_files(spark, root)
    sn, se, _ = api.scan_symbols(spark, root)
    ids = {r["id"] for r in fn.collect()}
    assert all(r["src"] in ids and r["dst"] in ids for r in fe.collect())
    via = lambda name: {(r.via, r.path) for r in api.impact(sn, se, fn, fe, name).collect()}
    assert via("src/styles.css") == {("file", "src/app.ts")}
    assert via("index.html") == set()
    assert ("symbol", "src/app.ts") in via("src/util")
    assert ("symbol", "src/app.ts") in via("greet")
    with pytest.raises(LookupError):
        api.impact(sn, se, fn, fe, "nowhere.ts").count()
    n, e, counts = fold.fold(fn, fe, sn, se)
    chain = named(n, e, "k")
    assert ("part-of", "src/util.ts#greet", "src/util.ts") in chain and ("calls", "src/app.ts#main", "src/util.ts#greet") in chain
    assert {r["origin"] for r in counts.collect()} <= {"both", "files", "symbols"}


def test_python_facts():
    f = extract.extract_file("a.py", '"""First.\n\nMore."""\nfrom .x import y as z\nimport os.path\n@app.route("/p", methods=["POST"])\n@app.route("/q", methods=["GET", "PUT"])\ndef f(a, *, b: int = 1) -> str:\n    """Does."""\n    z()\nclass _C(m.B):\n    def g(self): return self.h()\n')
    assert f["moduleSummary"] == "First." and [d["name"] for d in f["defs"]] == ["f", "_C", "g"]
    assert [d["kind"] for d in f["defs"]] == ["function", "class", "method"] and [d["exported"] for d in f["defs"]] == [True, False, True]
    assert f["defs"][0]["sig"] == "f(a, *, b: int=1) -> str" and f["defs"][0]["summary"] == "Does." and f["defs"][2]["ownerKey"] == "d2"
    assert [(i["spec"], i["level"]) for i in f["imports"]] == [("x", 1), ("os.path", 0)] and f["heritage"] == [{"defKey": "d2", "rel": "extends", "name": "m.B"}]
    assert [(r["verb"], r["path"], r["defKey"]) for r in f["routes"]] == [("POST", "/p", "d1")]
    assert extract.extract_file("bad.py", "def (")["defs"] == []


def test_other_grammars():
    go = extract.extract_file("m.go", 'package m\nimport (\n u "x/util"\n)\ntype I interface {\n  Do(x int) error\n}\ntype S struct {}\nfunc (s *S) Do(x int) error { return u.Go(x) }\n')
    assert [(d["kind"], d["name"], d["exported"]) for d in go["defs"]] == [("interface", "I", True), ("class", "S", True), ("method", "Do", True)]
    assert go["defs"][0]["ifaceMethods"] == ["Do"] and go["defs"][2]["receiverType"] == "S" and go["imports"][0]["ns"] == "u"
    rs = extract.extract_file("l.rs", "use crate::{a::b, c as d, e::*};\npub struct P {}\nimpl Tr for P {\n  fn go(&self) { self.x() }\n}\n#[get(\"/r\")]\npub async fn h() { b() }\n")
    assert [(i["spec"], i["ns"], i["wildcard"]) for i in rs["imports"]] == [("crate::a::b", None, False), ("crate::c", "d", False), ("crate::e", None, True)]
    assert rs["routes"][0]["defKey"] == next(d["key"] for d in rs["defs"] if d["name"] == "h") and rs["heritage"][0]["name"] == "Tr"
    java = extract.extract_file("T.java", 'package p;\nimport static a.D.e;\n@RequestMapping("/api")\npublic class T extends U implements V {\n  @GetMapping("/g")\n  public String g(int a) { return e(a); }\n  private void h() { }\n}\n')
    assert java["packageName"] == "p" and [d["exported"] for d in java["defs"]] == [True, True, False] and java["routes"][0]["path"] == "/api/g"
    cs = extract.extract_file("x.cs", 'using Xunit;\nnamespace N {\n [Route("api/[controller]")]\n public class FooController : Base, IThing {\n  [HttpGet("{id}")]\n  public int Get(int id) { return Help(id); }\n }\n}\n')
    assert cs["namespace"] == "N" and cs["testFramework"] and cs["routes"][0]["path"] == "/api/Foo/{id}" and {h["rel"] for h in cs["heritage"]} == {"extends", "implements"}
    ts = extract.extract_file("a.tsx", "export class A<T> extends B {\n  run(x: number): void {\n    this.go(x);\n  }\n}\nconst r = require('./x');\nconst v = pick('./y');\nexport interface I<T> { a: T }\n")
    assert [(d["kind"], d["sig"]) for d in ts["defs"]] == [("class", "A<T>"), ("method", "run(x: number): void"), ("interface", "I<T>")]
    assert [i["spec"] for i in ts["imports"]] == ["./x"] and {x["name"] for x in ts["locals"]} == {"v"}  # only require is a require
    rough = extract.extract_file("z.zig", "struct Foo {\n a\n}\nhello(a, b) {\n x\n}\n")
    assert [(d["kind"], d["name"]) for d in rough["defs"]] == [("symbol", "Foo"), ("symbol", "hello")]


def test_comment_blanking():
    text = "a // x\nb /* y\nz */ '//' \"/*\" c"
    code = extract.blank_comments(text, "c")
    assert len(code) == len(text) and code.count("\n") == 2 and "x" not in code and "y" not in code and "'//'" in code
    assert extract.comments_only(text, "c").split() == ["//", "x", "/*", "y", "z", "*/"]
    assert extract.header_doc("/**\n * One two.\n *\n * Three.\n */\n", "ts") == "One two." and extract.header_doc("# T\n\nBody.\n", "md") == "Body."


def barrel(depth):
    spec = {"m0.ts": "export function f() { }\n"}
    for i in range(1, depth + 1):
        spec[f"m{i}.ts"] = f"export * from './m{i - 1}';\n"
    spec["use.ts"] = f"import {{ f }} from './m{depth}';\nexport function g() {{\n  f();\n}}\n"
    return spec


@pytest.mark.parametrize("depth,confidence", [(5, "exact"), (6, "heuristic")])
def test_barrels(spark, depth, confidence):
    nodes, edges, counters = resolve.build_symbol_graph(facts_of(spark, barrel(depth)))
    calls = {k: r for k, r in named(nodes, edges).items() if k[0] == "call"}
    (key, row), = calls.items()
    assert row["confidence"] == confidence and key[1] == "use.ts:g"
    assert key[2] == ("m0.ts:f" if depth == 5 else "m0.ts:m0")
    assert dict(map(tuple, counters.collect()))["barrelOverflows"] == int(depth == 6)


def test_resolution(spark):
    spec = {
        "pkg/__init__.py": "from .a import f\n", "pkg/a.py": "def f(): pass\nclass B:\n  def m(self): return self.n()\n  def n(self): pass\n",
        "pkg/sub/c.py": "from ..a import f as k\ndef t():\n  k()\n", "main.py": "from pkg import f\nfrom pkg import a\nclass C(a.B): pass\ndef go(f2):\n  f()\n  a.f()\n  f2()\ndef shadow(f):\n  f()\n",
        "m/x.go": "package m\ntype I interface {\n  Do()\n}\ntype S struct { }\nfunc (s *S) Do() { help() }\nfunc help() {}\n", "m/x_test.go": "package m\nfunc TestDo() { help() }\n",
        "n/y.go": 'package n\nimport "ex.com/mod/m"\nfunc Run() { m.help() }\n',
        "src/main/java/p/q/A.java": "package p.q;\npublic class A {\n  public void a() { }\n}\n", "src/main/java/p/B.java": "package p;\nimport p.q.A;\npublic class B extends A {\n  public void b() { A.a(); }\n}\n",
        "src/main/java/p/D.java": "package p;\npublic class D extends B {\n}\n", "src/test/java/p/BTest.java": "package p;\npublic class BTest {\n}\n",
        "X.cs": "namespace N;\npublic class X {\n}\n", "Y.cs": "using N;\npublic class Y : X {\n}\n",
        "src/lib.rs": "mod k;\nuse crate::k::go;\npub fn run() { go() }\n", "src/k.rs": "pub fn go() { }\n",
    }
    nodes, edges, _ = resolve.build_symbol_graph(facts_of(spark, spec), "ex.com/mod")
    got = {k: r["confidence"] for k, r in named(nodes, edges).items()}
    want = {
        ("call", "pkg/sub/c.py:t", "pkg/a.py:f"): "exact", ("call", "main.py:go", "pkg/a.py:f"): "exact", ("call", "pkg/a.py:m", "pkg/a.py:n"): "heuristic", ("extends", "main.py:C", "pkg/a.py:B"): "exact",
        ("implements", "m/x.go:S", "m/x.go:I"): "heuristic", ("tests", "m/x_test.go:m/x_test", "m/x.go:m/x"): "heuristic", ("call", "n/y.go:Run", "m/x.go:help"): "exact",
        ("extends", "src/main/java/p/B.java:B", "src/main/java/p/q/A.java:A"): "exact", ("call", "src/main/java/p/B.java:b", "src/main/java/p/q/A.java:a"): "exact", ("extends", "src/main/java/p/D.java:D", "src/main/java/p/B.java:B"): "exact",
        ("tests", "src/test/java/p/BTest.java:src/test/java/p/BTest", "src/main/java/p/B.java:src/main/java/p/B"): None, ("extends", "Y.cs:Y", "X.cs:X"): "exact", ("call", "src/lib.rs:run", "src/k.rs:go"): "exact",
    }
    for key, conf in want.items():
        assert key in got and conf in (None, got[key]), key
    assert not any(k[1] == "main.py:shadow" for k in got if k[0] == "call")


def test_file_graph(spark):
    spec = FOUR | {"src/app.test.ts": "import { main } from './app';\n// docs/adr/0001-x.md\n", "docs/adr/0001-x.md": "# T\n\nSee src/util.ts\n", "web/a.ts": "import '@lib/b';\n", "lib/b.ts": "export const b = 1;\n", "x/Only.java": "class Only {}\n", "y/Use.java": "import q.Only;\nclass Use {}\n", "go/p/p.go": "package p\n", "go/q/q.go": 'package q\nimport "ex/go/p"\n', "go/p/r.go": "package p\n"}
    df = spark.createDataFrame(list(spec.items()), "path string, content string").withColumn("lang", P.file_lang("path"))
    found = analyze.analyze_files(df)
    nodes, edges = filegraph.build_file_graph(found, go_module="ex", ts_rules=[("", "@lib/", "", "lib/*", 0)])
    got = set(named(nodes, edges, "k"))
    for e in (("imports", "src/app.ts", "src/styles.css"), ("imports", "web/a.ts", "lib/b.ts"), ("imports", "y/Use.java", "x/Only.java"), ("imports", "go/q/q.go", "go/p"), ("part-of", "go/p/p.go", "go/p"), ("tested-by", "src/app.ts", "src/app.test.ts"), ("documents", "docs/adr/0001-x.md", "src/util.ts"), ("documents", "docs/adr/0001-x.md", "src/app.test.ts")):
        assert e in got, e
    assert {r["t"] for r in nodes.collect()} >= {"file", "entry", "adr", "mod"}
    sym, calls = filegraph.expand(found, df)
    assert {("exports",), ("calls",)} >= {(r["type"],) for r in calls.collect()} and sym.filter("k = 'src/app.ts#main'").count() == 1


def test_expanded_symbols_keep_their_own_ids(spark):
    """Keys that share six digits differ in longer ids; a name told twice is one symbol of its first line."""
    kind = "path string, loc int, anchors array<struct<name:string,line:int,exported:boolean>>, content string"
    rows = [(f"src/f{k}.ts", 5, [(f"a{k}", 1, True), (f"b{k}", 4, False)], f"function a{k}() {{\n  b{k}();\n}}\nfunction b{k}() {{\n}}") for k in (140, 1517)]
    rows.append(("src/z.ts", 6, [("p", 1, False), ("q", 3, False), ("p", 5, True)], "function p() {\n}\nfunction q() {\n}\nfunction p() {\n}"))
    df = spark.createDataFrame(rows, kind)
    sym, edges = filegraph.expand(df.drop("content"), df.select("path", "content"))
    nodes = {r["k"]: r for r in sym.collect()}
    key = {r["id"]: k for k, r in nodes.items()}
    assert len(key) == len(nodes) == sym.count() == 6
    assert nodes["src/f140.ts#b140"]["id"] == "yb18081" and len(nodes["src/f1517.ts#b1517"]["id"]) == 8
    assert {(nodes[f"src/z.ts#{n}"]["line"], nodes[f"src/z.ts#{n}"]["end"]) for n in "pq"} == {(1, 2), (3, 6)}
    assert sorted((key[r["src"]], key[r["dst"]]) for r in edges.filter("type = 'calls'").collect()) == [("src/f140.ts#a140", "src/f140.ts#b140"), ("src/f1517.ts#a1517", "src/f1517.ts#b1517"), ("src/z.ts#q", "src/z.ts#p")]
    assert sorted(key[r["dst"]] for r in edges.filter("type = 'exports'").collect()) == ["src/f140.ts#a140", "src/f1517.ts#a1517", "src/z.ts#p"]


def test_listing_drops(spark, tmp_path):
    root = tree(tmp_path, {"a/x.py": "x = 1\n", "sk/SKILL.md": "s", "sk/y.py": "y", "node_modules/z.js": "z", "big.txt": "b" * 600_000, "bin.dat": b"a\0b", "w.min.js": "m", "data.json": "{}", "odd.zig": "fn", ".hid/q.py": "q"})
    ls = files.listing(spark, root)
    kept, dropped = files.scan_listing(ls)
    assert {r["reason"]: r["n"] for r in dropped.collect()} == {"skill": 2, "ignored": 2, "big": 1, "binary": 1}
    assert {r["path"] for r in kept.select("path").collect()} == {"a/x.py", "data.json", "odd.zig"}  # Spark's reader skips hidden directories
    assert {r["path"] for r in files.source_files(ls).select("path").collect()} == {"a/x.py", "sk/y.py", "odd.zig"}
    walked = spark.createDataFrame([("a", 1, 1.0, "py"), ("b", 2, 1.0, "py"), ("c", 2_000_000, 1.0, "py"), ("d", 1, 1.0, "py")], "path string, size long, mtime_ms double, lang string")
    prior = spark.createDataFrame([("a", 1, 1.0, "py", "h", "h"), ("b", 1, 1.0, "py", "h", "h"), ("e", 1, 1.0, "py", "h", "h"), ("d", 1, 1.0, "py", "h", "k")], "path string, size long, mtime_ms double, lang string, hash string, facts_hash string")
    assert {r["path"]: r["job"] for r in files.scan_jobs(walked, prior).collect()} == {"a": "reuse", "b": "scan", "c": "oversize", "d": "scan", "e": "vanished"}


def test_stores(spark, tmp_path):
    nodes = spark.createDataFrame([("f1", "file", "a.py", None, [], "h", None, "ok", 1, "scan", None)], "id string, t string, k string, s string, g array<string>, h string, a array<struct<name:string,line:int>>, st string, w int, by string, ts bigint")
    edges = spark.createDataFrame([("f1", "imports", "f2", None)], "src string, type string, dst string, meta map<string,string>")
    files.save_graph(nodes, edges, str(tmp_path / "g"), as_json=True)
    with open(tmp_path / "g/nodes/extra.txt", "w") as f:
        f.write("not json\n")
    n, e, warn = files.load_graph(spark, str(tmp_path / "g/nodes"), str(tmp_path / "g/edges"))
    assert n.collect()[0]["st"] == "ok" and e.count() == 1 and warn.count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "g/nodes"), "id string").collect()
    files.save_snapshot({"nodes": nodes}, str(tmp_path / "s"), "1")
    assert files.read_snapshot(spark, str(tmp_path / "s"), "1", "nodes").count() == 1
    with pytest.raises(ValueError):
        files.read_snapshot(spark, str(tmp_path / "s"), "1", "nodes", version=0)
    log = spark.createDataFrame([(0, "old"), (8_000_000, "new")], "ts_ms bigint, path string")
    assert [r["path"] for r in files.record_impact(log, "now", 9_000_000).collect()] == ["new", "now"]
    posts = spark.createDataFrame([("b", "2"), ("a", "1"), ("a", "3")], "term string, id string")
    files.write_postings(posts, str(tmp_path / "p"))
    assert sorted(map(tuple, files.read_postings(spark, str(tmp_path / "p")).collect())) == [("a", "1"), ("a", "3"), ("b", "2")]


def test_project_metadata(spark):
    assert project.read_jsonc('{"a": "//x", /* c */ "b": [1, 2,], }') == {"a": "//x", "b": [1, 2]} and project.read_jsonc("{") is None
    assert project.ignore_dirs('{"ignoreDirs": ["x", 1]}') == ["x"] and project.ignore_dirs("oops") == []
    assert project.package_entries("p", json.dumps({"main": "./i.js", "bin": {"c": "b.js"}})) == ["p/b.js", "p/i.js"]
    assert project.workspace_packages({"p": json.dumps({"name": "@a/p"})}) == [("@a/p", "p", ".", "p/src/index.ts")]
    configs = {"tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "web/tsconfig.json": '{"extends": "../tsconfig"}'}
    assert [r[:2] for r in project.ts_path_rules(configs)] == [("web", "@/"), ("", "@/")]
    assert project.go_module("// x\nmodule ex.com/m\n") == "ex.com/m"
    m = spark.createDataFrame([("package.json", '{"devDependencies": {"vitest": "1"}}'), ("a/go.mod", ""), ("b/go.mod", ""), ("a/b/c/d/Cargo.toml", "")], "path string, content string")
    assert {tuple(r) for r in project.marker_runners(m).collect()} == {("vitest", "package.json"), ("go-test", "a/go.mod")}
    with pytest.raises(ValueError):
        project.read_meta('{"schemaVersion": 3}', 2)


def test_git(spark, tmp_path):
    raw = "?? new.txt\0 M mod.txt\0R  to.txt\0from.txt\0UU both.txt\0?? dir/\0A  add.txt\0"
    assert git.porcelain_states(raw) == [("new.txt", "untracked"), ("mod.txt", "modified"), ("to.txt", "staged"), ("both.txt", "conflicted"), ("add.txt", "staged")]
    states = spark.createDataFrame([("a", "unpushed"), ("a", "modified"), ("b", "untracked")], "path string, state string")
    worst, counts = git.overlay(states, 5)
    assert {tuple(r) for r in worst.collect()} == {("a", "modified"), ("b", "untracked")} and dict(map(tuple, counts.collect()))["pushed"] == 4
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "x").write_text("1")
    git.register(spark)
    assert [tuple(r)[1:] for r in spark.read.format("git_status").option("roots", str(tmp_path)).load().collect()] == [("x", "untracked")]
    (tmp_path / "p.json").write_text(json.dumps([{"number": 1, "state": "OPEN", "labels": [{"name": "l"}], "blockedBy": [2]}]))
    row = spark.read.format("issue_pages").option("pages", str(tmp_path / "p.json")).load().first()
    assert (row["number"], row["state"], row["labels"], row["blockedBy"]) == (1, "open", ["l"], [2])
    assert git.link_issues(1, 2, lambda a, b: 422) == "already linked"


def test_issues(spark):
    i = spark.createDataFrame([(1, "Blocked by: #2, #9\nPart of #3", [], []), (2, None, [3], [1])], "number int, body string, blockedBy array<int>, subs array<int>")
    got = {r["number"]: (r["blockedBy"], r["parent"]) for r in notes.relations_from_body(i.fillna("", ["body"])).collect()}
    assert got == {1: ([2, 9], 3), 2: ([3], None)}
    c = spark.createDataFrame([("fixes #1", "see #2 and #7", ["a.py"])], "subject string, body string, files array<string>")
    assert {tuple(r) for r in notes.issue_edges(i, c).collect()} == {("i3", "blocks", "i2"), ("i1", "part-of", "i2"), ("a.py", "closes", "i1"), ("a.py", "mentions", "i2")}
    blocks = spark.createDataFrame([(1, 2), (2, 99)], "number int, blocker int")
    states = spark.createDataFrame([(1, "open", False), (2, "open", False), (3, "open", True), (4, "open", False)], "number int, state string, assigned boolean")
    assert [r["number"] for r in notes.issue_frontier(states, blocks).filter("frontier").collect()] == [4]


def test_check(spark):
    node = "id string, path string, name string, kind string, sigHash string, exported boolean, key string"
    old = spark.createDataFrame([("1", "a", "f", "function", "s1", True, "k1"), ("2", "a", "g", "function", "s1", True, "k2"), ("3", "b", "c", "function", "s1", True, "k3"), ("4", "a", "p", "function", "s1", False, "k4")], node)
    new = spark.createDataFrame([("1", "a", "f", "function", "s2", True, "k1"), ("3x", "b", "c", "function", "s1", True, "k3"), ("4", "a", "p", "function", "s2", False, "k4")], node)
    e = spark.createDataFrame([("3", "2", "call")], "src string, dst string, type string")
    of = spark.createDataFrame([("a", "h1"), ("b", "h"), ("z", "h")], "path string, hash string")
    nf = spark.createDataFrame([("a", "h2"), ("b", "h"), ("n", "h")], "path string, hash string")
    pinned = spark.createDataFrame([("n1", "k1", "1"), ("n2", "gone", "9")], "note string, key string, node string")
    got = {(r["state"], r["path"], r["name"]) for r in notes.check(old, new, e, e.limit(0), of, nf, pinned).collect()}
    assert got == {("drift", "a", "f"), ("dangling", "b", "c"), ("orphan", None, "n2")}
    healed = spark.createDataFrame([("3x", "5", "call")], "src string, dst string, type string")
    both = new.unionByName(spark.createDataFrame([("5", "q", "g", "function", "s1", True, "k5")], node))
    assert notes.check(old, both, e, healed, of, nf).filter("state = 'dangling'").count() == 0
    ends = spark.createDataFrame([(1, "bound"), (1, "rebind"), (2, "orphan"), (2, "ambiguous"), (3, "bound")], "note int, status string")
    assert dict(map(tuple, notes.rebind_edges(ends.select("note").distinct(), ends).collect())) == {1: "rebind", 2: "ambiguous", 3: "bound"}


def test_concepts_and_notes(spark):
    n = spark.createDataFrame([("f1", "file", "a/one.py"), ("y1", "sym", "a/one.py#parseThing"), ("y2", "sym", "b.py#twiceThing"), ("y3", "sym", "c.py#twiceThing"), ("i5", "issue", "5")], "id string, t string, k string")
    c = spark.createDataFrame([("c1", "one.py uses parseThing, twiceThing, #5 and thing")], "id string, s string")
    assert {r["dst"] for r in fold.link_concepts(c, n).collect()} == {"f1", "y1", "i5"}
    l = spark.createDataFrame([("k1", "a/one.py", "parseThing", "hi")], "key string, path string, name string, text string")
    assert fold.attach_notes(l, n, spark.createDataFrame([("k1",)], "key string")).first()["stale"] is True


def test_walks_against_brute_force(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 3), (6, 5), (7, 6), (4, 8), (9, 10)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    down = {r["id"]: r["hop"] for r in traversal.reachable(e, spark.createDataFrame([(1,)], "id long"), "down").collect()}
    assert down == {2: 1, 3: 2, 4: 3, 8: 4}
    p = [r["id"] for r in traversal.shortest_path(e, 7, 8).orderBy("step").collect()]
    assert p == [7, 6, 5, 3, 4, 8]
    assert [r["id"] for r in traversal.shortest_path(e, 4, 4).collect()] == [4] and traversal.shortest_path(e, 1, 9).count() == 0
    chains = [[8]]
    best = []
    while chains:
        best += chains
        chains = [[a, *c] for c in chains for a, b in pairs if b == c[0] and a not in c and len(c) < 5]
    want = min(best, key=lambda c: (-(1000 * (c[0] == 5) + len(c)), c))
    got = traversal.longest_up_path(e, 8, spark.createDataFrame([(5,)], "id long"), 5).first()
    assert got["path"] == want
    for a, b in itertools.product((1, 7), repeat=2):
        up = {r["id"] for r in traversal.reachable(e, spark.createDataFrame([(b,)], "id long"), "up").collect()}
        dn = {r["id"] for r in traversal.reachable(e, spark.createDataFrame([(a,)], "id long"), "down").collect()}
        assert (a in up) == (b in dn) or a == b


def test_impact_confidence_is_order_free(spark):
    e = spark.createDataFrame([("a", "t", "call", "heuristic"), ("b", "t", "call", "exact"), ("a", "b", "call", "exact"), ("c", "a", "contains", "exact")], "src string, dst string, type string, confidence string")
    got = {r["id"]: (r["hop"], r["confidence"]) for r in traversal.impact(e, spark.createDataFrame([("t",)], "id string")).collect()}
    assert got == {"a": (1, "exact"), "b": (1, "exact")}


def test_greedy_against_a_loop(spark):
    rows = [("g", i, c) for i, c in enumerate([50, 60, 30, 5, 40, 10])]
    got = graph.greedy_budget(spark.createDataFrame(rows, "g string, i int, c long"), "g", ["i"], "c", 100).collect()
    spent, want = 0, []
    for _, i, c in rows:
        if spent + c <= 100:
            spent += c
            want.append(i)
    assert sorted(r["i"] for r in got) == want


def test_bounded_view(spark):
    n = spark.createDataFrame([(f"n{i}", "function", i, 100) for i in range(200)], "id string, kind string, span_size long, bytes long")
    e = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + 1) % 200}", "tests" if i % 5 == 0 else "call", 50) for i in range(200)], "src string, dst string, type string, bytes long")
    out = view.bounded_view(n, e, 15_000).collect()
    ids = {r["id"] for r in out if r["row"] == "node"}
    shown = [r for r in out if r["row"] == "edge"]
    assert all(r["src"] in ids and r["dst"] in ids for r in shown) and len(ids) * 100 + len(shown) * 50 <= 15_000 - view.MARGIN and shown
    page = view.html_page(n.limit(2).withColumn("x", F.lit("</script>")), e.limit(1))
    assert page.count("</script>") == 1
    assert view.replace_section("p\n", "m", "b") == "p\n\n<!-- m:start -->\nb\n<!-- m:end -->\n"
    assert view.replace_section(view.replace_section("p\n", "m", "b"), "m", "c").count("c") == 1


def test_slices(spark):
    f = spark.createDataFrame([("a.py", "\ufeffl1\r\nl2\r\nl3\r\n")], "path string, content string")
    assert [r["line"] for r in view.slice_of(f, "a.py", 1, 2).orderBy("line_no").collect()] == ["l1", "l2"]
    with pytest.raises(ValueError):
        view.slice_of(f.withColumn("content", F.repeat(F.lit("x"), 9000)), "a.py", 1, 9)
    n = spark.createDataFrame([("1", "class", "a.py", (1, 0, 9, 9)), ("2", "method", "a.py", (2, 0, 5, 5)), ("3", "method", "a.py", (3, 0, 4, 4))], "id string, kind string, path string, span struct<sl:int,sb:int,el:int,eb:int>")
    assert view.container_above(n, "a.py", 3, 4).first()["id"] == "2" and tuple(view.file_section(n, "a.py", 6, 6).first()) == (6, 2147483646)


def test_modules_collapse(spark):
    m = spark.createDataFrame([("r", None, 1), ("a", "r", 0), ("b", "a", 0), ("c", "b", 2), ("d", "r", 0), ("e", "d", 1), ("f", "d", 1)], "id string, parent string, n_files int")
    got = {r["id"]: r["parent"] for r in graph.collapse_pass_through(m).collect()}
    assert got == {"r": None, "c": "r", "d": "r", "e": "d", "f": "d"}
    paths = spark.createDataFrame([(p,) for p in ("a/b/x", "a/b/y", "a/c/d/z", "a/c/e/w", "t")], "path string")
    mods = graph.infer_modules(paths)
    assert {r["dir"] for r in mods.collect()} == {"a/b"}
    assert {r["path"]: r["module"] for r in graph.nearest_module(paths, mods).collect()}["a/b/x"] == "a/b"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.tokenize_key(F.lit("src/parseHTTPCode_v2.ts"))) == ["parsehttpcode_v2.ts", "src", "parsehttpcode", "v2", "ts", "parse", "http", "code"]
    assert one(T.tokenize_bm25(F.lit("parseX9_id"))) == ["parse", "x", "9", "id", "parsex9_id"]
    assert one(T.tokenize_text(F.lit("The getUserName of x"))) == ["getusername", "user", "name"]
    assert one(T.normalized_body(F.lit("\n  a\n    b  \n\n"))) == "a\n  b" and one(T.normalized_body(F.lit(" \n"))) == ""
    assert one(T.issue_numbers(F.lit("fix #3, #4 and #3"))) == [3, 4] and one(T.closing_numbers(F.lit("Fixes #3, see #4"))) == [3]
    assert one(T.short_name(F.lit("a/b/index.ts"))) == "b/index.ts" and one(T.round4(F.lit(0.12345))) == 0.1235
    assert one(P.join_posix(F.lit("a/b"), F.lit("../c/./d"))) == "a/c/d" and one(P.module_id(F.lit("a/__init__.py"), F.lit("python"))) == "a"
    assert one(P.convention_test_target(F.lit("src/test/java/p/ATest.java"), F.lit("java"))) == "src/main/java/p/A.java"
    assert [one(P.is_test_file(F.lit(p))) for p in ("a.test.ts", "t/test_a.py", "a_test.go", "A.Tests.cs", "a.ts")] == [True, True, True, True, False]
    assert one(P.node_type(F.lit("docs/adr/0001-x.md"))) == "adr" and one(P.node_type(F.lit("cmd/x/main.go"))) == "entry" and one(P.file_lang(F.lit("x.unknown"))) == "text"
    crlf = spark.createDataFrame([("a\r\nb",), ("a\nb",)], "t string").select(T.hash_prefix(T.canonicalize("t"), 8).alias("h")).distinct()
    assert crlf.count() == 1
    assert len(one(T.structural_summary(F.lit("x" * 300), F.lit(9), F.lit(2), F.array(F.lit("y")), F.array(F.lit("z"))))) <= 200


def test_search_commands(spark):
    nodes = spark.createDataFrame([("f1", "file", "src/parse.ts", "Parses input", ["src"], None, "ok", 2), ("f2", "entry", "src/main.ts", "Entry point", ["src"], None, "ok", 1), ("f3", "file", "src/old.ts", "parse", ["src"], None, "dead", 1)], "id string, t string, k string, s string, g array<string>, a array<struct<name:string,line:int>>, st string, w int")
    edges = spark.createDataFrame([("f2", "imports", "f1")], "src string, type string, dst string")
    out = search.query_report(nodes, edges, search.build_index(nodes), "parse", k=5).collect()
    assert [r["id"] for r in out] == ["f1"] and (out[0]["n_in"], out[0]["depth"], out[0]["state"]) == (1, 1, "pushed")
    assert api.resolve_node(nodes, "parse.ts") == "f1"
    with pytest.raises(LookupError):
        api.resolve_node(nodes, "none.ts")
    assert {(r["section"], r["key"], r["n"]) for r in api.context(nodes, edges, "f1").collect()} >= {("up", "direct", 1), ("down", "direct", 0)}


def test_streams(spark, tmp_path):
    from strandline.streaming import incremental as S

    (tmp_path / "in").mkdir()
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, True), ("b", 2, False), ("b", 3, True), ("a", 4, False), ("c", 1, False)]
    spark.createDataFrame(rows, "id string, scan long, present boolean").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, scan long, present boolean").parquet(str(tmp_path / "in"))
    q = S.two_phase_death(stream).writeStream.format("memory").queryName("deaths").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("deaths").collect()} == {("a", 1, "ok"), ("a", 2, "dead"), ("a", 3, "deleted"), ("b", 1, "ok"), ("b", 2, "dead"), ("b", 3, "ok")}
    assert S.impact_log(spark.readStream.format("rate").load().selectExpr("timestamp ts", "'p' path")).isStreaming


def test_check_state(spark, tmp_path):
    found = spark.createDataFrame([("drift", "a", "f", None)], "state string, path string, name string, detail string")
    path = str(tmp_path / "c")
    assert files.read_check(spark, path) is None
    files.save_check(found, path)
    assert files.read_check(spark, path).first()["state"] == "drift" and files.read_check(spark, path, 2) is None
    files.init_store(str(tmp_path / "s"))
    files.init_store(str(tmp_path / "s"))
    assert (tmp_path / "s/.gitignore").read_text().count("cache/") == 1


def test_definitions_behind_brackets_of_a_line():
    ts = "class A { foo() { return this.bar(); } static bar(x: number): string { if (x) { return 'a'; } return baz(x); } } export function one() { function inner(y) { return y; } return inner(1); }\n"
    got = [(d["kind"], d["name"], d["ownerKey"]) for d in extract.extract_ts(ts, "typescript")["defs"]]
    assert got == [("class", "A", None), ("method", "foo", "d1"), ("method", "bar", "d1"), ("function", "one", None), ("function", "inner", "d4")]
    rust = "pub struct P; impl P { pub fn new() -> P { P } fn go(&self) {} } mod m { pub fn q() {} }\n"
    assert [d["name"] for d in extract.extract_rust(rust)["defs"]] == ["P", "P", "new", "go", "m", "q"]
