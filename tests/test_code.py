"""Source code: parsing, references, navigation, edits, sessions."""

import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions import locators, paths
from textquarry.functions import text as tx
from textquarry.operators import code, edits, graph, parse, read, search
from textquarry.plans import rpc
from textquarry.plans.model import Query, Request
from textquarry.plans.session import Session
from textquarry.sources import corpus as co
from textquarry.sources import files as fs

REPO = {
    "src/auth/token.rs": "pub fn validate_token(t: &str) -> bool {\n    t.len() > 3\n}\n\nfn refresh(t: &str) {\n    validate_token(t);\n}\n",
    "src/auth/login.rs": "use crate::auth::token::validate_token;\n// validate_token in a comment\nfn login(t: &str) {\n    let s = \"validate_token\";\n    if validate_token(t) { refresh(t); }\n}\n",
    "README.md": "# Demo\ncall validate_token first\n",
    "a.py": "class A:\n    def m(self):\n        return 1\n\nclass B:\n    def m(self):\n        return 2\n",
    "chain.py": "def base():\n    return 1\n\ndef mid():\n    return base()\n\ndef top():\n    return mid()\n\ndef test_top():\n    assert top()\n",
    "web/app.ts": "export function render(x: number) {\n  return `render ${x}`; // render\n}\n",
    "web/main.js": "function go() {\n  render(1);\n}\n",
    "packages/cli/package.json": "{}\n",
    "packages/cli/run.py": "def helper():\n    return 1\n",
    "packages/core/pyproject.toml": "x = 1\n",
    "packages/core/run.py": "def helper():\n    return 2\n\ndef user():\n    return helper()\n",
    "gen/api.pb.go": "package api\nfunc (s *Server) Handle(x int) int {\n\treturn x\n}\n",
}


@pytest.fixture(scope="module")
def corpus(spark):
    files = spark.createDataFrame(sorted(REPO.items()), "path string, text string").withColumn("lang", paths.language(F.col("path"), F.col("text")))
    return co.Corpus(files.cache(), parse.code_symbols(files).cache())


@pytest.fixture
def tree(tmp_path):
    for p, t in REPO.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    return tmp_path


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def value(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


def test_symbols(corpus):
    got = set(rows(corpus.symbols, "path", "kind", "name", "start", "end"))
    assert {("src/auth/token.rs", "fn", "validate_token", 1, 3), ("src/auth/token.rs", "fn", "refresh", 5, 7)} <= got
    assert {("a.py", "class", "A", 1, 3), ("a.py", "def", "m", 2, 3), ("a.py", "def", "m", 6, 7)} <= got
    assert ("gen/api.pb.go", "func", "Handle", 2, 4) in got and ("web/app.ts", "function", "render", 1, 3) in got
    assert dict(rows(corpus.symbols.filter("path = 'a.py'"), "signature", "start")) == {"class A": 1, "class B": 5, "def m(self)": 6}


@pytest.mark.parametrize("lang,line,name", [("kotlin", "fun greet() {", "greet"), ("swift", "func go() {", "go"), ("java", "public class Main {", "class"), ("ruby", "def run;", "run"), ("php", "function f() {", "f"), ("c", "struct node {", "node"), ("csharp", "namespace N {", "N"), ("dart", "class D {", "D"), ("cpp", "namespace n {", "n"), ("tsx", "interface P {", "P"), ("javascript", "async function h() {", "h")])
def test_language_heads(lang, line, name):
    got = parse.parse_symbols(f"{line}\n x\n}}\n", lang)
    assert got and got[0][1] == name and parse.parse_symbols(line, "generic") == []


def test_languages(spark):
    df = spark.createDataFrame([("a.pyi", ""), ("b.TSX", ""), ("c.h", ""), ("bin/run", "#!/usr/bin/env python3\n"), ("d.mts", ""), ("e.txt", "#!node")], "path string, text string")
    assert dict(rows(df.select("path", paths.language(F.col("path"), F.col("text")).alias("l")), "path", "l")) == {"a.pyi": "python", "b.TSX": "tsx", "c.h": "cpp", "bin/run": "python", "d.mts": "typescript", "e.txt": "javascript"}
    assert paths.lang_suffixes("c,cpp")[:2] == [".c", ".h"] and paths.lang_suffixes("klingon") == []


def test_scope_and_globs(spark):
    p = ["src/mytoken.rs", "src/token.rs", "lib/token.rs", "src/a/b.rs"]
    df = spark.createDataFrame([(x,) for x in p], "path string")
    inside = lambda *s: {r["path"] for r in df.filter(paths.in_scope(F.col("path"), list(s))).collect()}
    assert inside("**/token.rs") == {"src/mytoken.rs", "src/token.rs", "lib/token.rs"}  # ** stands for anything
    assert inside("src/*.rs") == {"src/mytoken.rs", "src/token.rs"} and inside("!src") == {"lib/token.rs"}
    assert inside("src", "!**/a/**") == {"src/mytoken.rs", "src/token.rs"} and inside("token.rs") == {"src/token.rs", "lib/token.rs"}


def test_planner():
    assert tx.smart_case("abc") == "(?i)abc" and tx.smart_case("aBc") == "aBc" and tx.line_pattern("a(") == "(?i)a\\("
    assert tx.is_plain_ident("fn_x") and not tx.is_plain_ident("fn") and not tx.is_plain_ident("a-b")
    assert tx.py_subwords("HTTPServer parse_url x") == ["httpserver", "parse", "url"]
    assert tx.required_literals("validate.*id") == [] and tx.required_literals("foo bar") == ["foo", "bar"] and tx.required_literals("a|b") == []
    assert tx.required_literals("colour+s") == ["colou"]
    assert tx.mention_words("What does Licensed return") == ["licensed"]
    assert [locators.parse_line_range(s, 10) for s in ("2-4", "3", "8-", "-3", "~2", "5-99")] == [(2, 4), (3, 3), (8, 10), (8, 10), (9, 10), (5, 10)]
    with pytest.raises(ValueError):
        locators.parse_line_range("9-3", 5)
    assert locators.parse_symbol_query("src/a.rs#f@L1-3 :: sha256=ab") == ("src/a.rs", "f") and locators.parse_symbol_query("f") == (None, "f")


@pytest.mark.parametrize("pattern,text", [("validate_\\w+", "validate_token"), ("foo.bar", "foo_bar"), ("colour+s", "colourrrs"), ("ab+c", "abbc"), ("^fn main$", "fn main"), ("needle", "xNeedle")])
def test_pruning_is_sound(pattern, text):
    assert all(w in text.lower() for w in tx.required_literals(pattern))


def test_locators(spark):
    locators.register(spark)
    r = spark.sql("SELECT locator('a.py', 'f', 1, 3, 'x') AS l, est_tokens('abcdefgh') AS n").first()
    assert r["l"].startswith("a.py#f@L1-3 :: sha256=") and r["n"] == 2
    got = value(spark, locators.parse_locator(F.lit(r["l"])))
    assert (got["path"], got["symbol"], got["start"], got["end"]) == ("a.py", "f", 1, 3)
    assert value(spark, locators.parse_locator(F.lit("no locator"))) is None


def test_lines(spark):
    count = lambda s: len(value(spark, tx.lines(F.col("t")), s))
    assert [count(s) for s in ("", "a", "a\n", "a\n\n", "\n")] == [1, 1, 1, 2, 1]


TRAPS = [
    ("python", "x = 1 # name\n'''name \" '''\nname()", 1),
    ("python", "a // name\nname", 1),
    ("rust", "let a: &'name str = r#\"name \" \"#; 'n'; name", 2),
    ("javascript", "`name` + 'name' + name // name", 1),
    ("go", "`na\nme name` name /* name */", 1),
    ("java", "char c = '\"'; name \"name\\\" name\" name", 2),
    ("python", "\"unclosed name", 0),
]


@pytest.mark.parametrize("lang,text,n", TRAPS)
def test_code_without_comments_and_strings(spark, lang, text, n):
    df = spark.createDataFrame([("f", text, lang)], "path string, text string, lang string")
    idents = df.select(code.code_identifiers(F.col("text"), F.col("lang")).alias("i")).first()["i"]
    assert idents.count("name") == n
    kept = df.select(code.stripped_lines(F.col("text"), F.col("lang")).alias("t")).first()["t"]
    assert kept.count("\n") == text.count("\n") and kept.count("name") == n
    assert edits.replace_word(text, "name", "other", lang)[1] == n


def test_calls(spark):
    df = spark.createDataFrame([("f(x); g (y); h/*c*/(z); k::<T>(w); plain", "rust")], "t string, lang string")
    assert df.select(code.call_identifiers(F.col("t"), F.col("lang")).alias("c")).first()["c"] == ["f", "g", "k"]
    assert value(spark, code.call_sites(F.col("t"), "f"), "f(1) xf(2) f (3)") == 2


def test_references(corpus):
    got = rows(graph.references(corpus, "validate_token"), "path", "line")
    assert got == [("README.md", 2), ("src/auth/login.rs", 1), ("src/auth/login.rs", 5), ("src/auth/token.rs", 6)]


def test_impact_context_callgraph(corpus):
    assert rows(graph.impact(corpus, "base"), "name", "depth") == [("mid", 1), ("test_top", 3), ("top", 2)]
    assert rows(graph.callgraph(corpus, "top"), "name", "depth") == [("base", 2), ("mid", 1)]
    assert ("test", "chain.py", "test_top") in rows(graph.context(corpus, "top"), "role", "path", "name")
    counts = graph.reach_counts(graph.impact(corpus, "base")).first()
    assert (counts["direct"], counts["all"]) == (1, 3)


def test_cycles_end(spark):
    files = spark.createDataFrame([("c.py", "def ping():\n    pong()\n\ndef pong():\n    ping()\n")], "path string, text string").withColumn("lang", F.lit("python"))
    c = co.Corpus(files, parse.code_symbols(files))
    assert rows(graph.callgraph(c, "ping"), "name", "depth") == [("ping", 2), ("pong", 1)]  # the target itself may be reached


def test_pagerank(spark):
    nodes = spark.createDataFrame([("util",), ("a",), ("b",), ("alone",)], "path string")
    edges = spark.createDataFrame([("a", "util"), ("b", "util")], "src string, dst string")
    ranks = dict(rows(graph.pagerank(nodes, edges), "path", "rank"))
    assert max(ranks, key=ranks.get) == "util" and abs(sum(ranks.values()) - 1) < 1e-9
    assert graph.pagerank(nodes.filter("false"), edges).count() == 0


def test_imports_and_packages(corpus):
    wanted = corpus.files.sparkSession.createDataFrame([("render", "web/x/page.ts"), ("base", "pkg/m.py"), ("render", "a.dart"), ("refresh", "src/b.rs"), ("refresh", "x/y.zig"), ("refresh", "x.go")], "name string, target string")
    said = {r["target"]: r["statement"] for r in graph.imports(corpus, wanted).collect()}
    assert said["web/x/page.ts"] == "import { render } from '../app';" and said["pkg/m.py"].startswith("from chain import base")
    assert said["a.dart"] == "import './web/app.ts';" and said["src/b.rs"].startswith("use crate::auth::token::refresh;")
    assert said["x.go"].startswith("// `refresh` is in src/auth/token.rs") and said["x/y.zig"].startswith("// `refresh` is defined in src/auth/token.rs")
    files = corpus.files.sparkSession.createDataFrame([("packages/cli/run.py",), ("packages/cli/deep/er/x.py",), ("a.py",)], "path string")
    assert rows(graph.package_roots(files, corpus.files), "path", "root") == [("a.py", None), ("packages/cli/deep/er/x.py", "packages/cli"), ("packages/cli/run.py", "packages/cli")]


@pytest.mark.parametrize("have,want,out", [("a/b/c.ts", "a/d/e.ts", "../d/e.ts"), ("a.ts", "b.ts", "./b.ts"), ("a/b.ts", "a/b/c.ts", "./b/c.ts"), ("x/y/z.ts", "q.ts", "../../q.ts"), ("a/a/a.ts", "a/b/a/a.ts", "../b/a/a.ts")])
def test_relative(spark, have, want, out):
    assert spark.range(1).select(paths.relative(F.lit(have), F.lit(want)).alias("r")).first()["r"] == out


def test_search_modes(corpus):
    hits = search.enclosing(search.regex_hits(corpus, "validate_token"), corpus)
    assert ("src/auth/token.rs", 6, "refresh") in rows(hits.filter("name is not null"), "path", "line", "name")
    assert rows(hits.filter("path = 'README.md'"), "line", "name") == [(2, None)]
    assert search.structural(corpus, "refresh").orderBy("rank").first()["id"].startswith("src/auth/token.rs#refresh@L5-7")
    assert search.semantic(corpus, corpus, "token validate", 3).orderBy("rank").first()["id"].startswith("src/auth/token.rs#validate_token")
    assert search.search_auto(corpus, "validate_token").first()["id"].startswith("src/auth/token.rs#validate_token")
    assert [r["name"] for r in search.fuzzy_symbols(corpus, "validate_tokn").collect()] == ["validate_token"]
    assert search.no_match_hint(corpus, corpus.scoped(["nowhere"]), "x").code == "SCOPE_NO_MATCH"
    assert len(search.no_match_hint(corpus, corpus.scoped(["src"]), "def mid|zzz Q").hints) == 4 and search.no_match_hint(corpus, corpus, "zz yy").hints
    assert rows(corpus.scoped(lang="py").files, "path") == [("a.py",), ("chain.py",), ("packages/cli/run.py",), ("packages/core/run.py",)]
    assert corpus.scoped(lang="klingon").files.isEmpty()


def test_large_rankings_are_the_same(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("s")).repartition(5)
    small = rows(search.ranked(df, F.desc("s"), "id"), "id", "rank")
    monkeypatch.setattr(search, "SMALL_LIST", 10)
    assert rows(search.ranked(df, F.desc("s"), "id"), "id", "rank") == small


def test_diagnose(spark, corpus):
    blob = "error[E0308]: mismatched types\n  --> src/auth/token.rs:2:5\nauth/login.rs:4:1: warning: unused\n"
    df = spark.createDataFrame(list(enumerate(blob.split("\n"))), "n long, text string")
    got = rows(read.diagnose(df, corpus), "path", "line", "severity", "message", "name")
    assert [round(r["score"], 3) for r in read.diagnose(df, corpus).orderBy("path").collect()] == [0.667, 1.0]
    assert got == [("src/auth/login.rs", 4, "warning", "unused", "login"), ("src/auth/token.rs", 2, "error", "mismatched types", "validate_token")]


def test_packing(spark):
    from textquarry.operators import pack

    rows_ = [(f"s{i}", "x" * (40 * (i % 7 + 1)), float(i % 13)) for i in range(60)]
    df = spark.createDataFrame(rows_, "id string, text string, score double")
    want, used = [], 0
    for i, t, _ in sorted(rows_, key=lambda r: (-r[2], r[0])):
        cost = max(1, len(t) // 4) + 8
        if used + cost <= 500:
            want, used = [*want, i], used + cost
    for size in (4096, 5):
        pack.ROUND, before = size, pack.ROUND
        got = [r["id"] for r in pack.budget_pack(df, 500).orderBy("pos").collect()]
        pack.ROUND = before
        assert got == want
    order = [r["id"] for r in pack.edge_order(df.limit(0).unionByName(spark.createDataFrame([("a", "", 3.0), ("b", "", 2.0), ("c", "", 1.0)], df.schema))).orderBy("place").collect()]
    assert order == ["a", "c", "b"]


def test_edit_functions():
    text = "def a():\n    return 1\n\n# note\ndef b():\n    return 2\n"
    span = edits.resolve_span(text, "python", "a")
    assert edits.replace_body(text, span, "def a():\n    return 9").startswith("def a():\n    return 9\n\n# note")
    assert edits.delete_symbol(text, edits.resolve_span(text, "python", "b")) == "def a():\n    return 1\n"
    assert edits.insert(text, "after", "def c():\n    pass", span).split("\n")[3:5] == ["def c():", "    pass"]
    assert edits.insert(text, "before", "x = 1", edits.resolve_span(text, "python", "b")).split("\n")[3] == "x = 1"
    assert "    y = 2" in edits.insert(text, "into", "y = 2", span)
    assert edits.insert("", "end", "z = 1") == "z = 1\n"
    assert edits.replace_anchor(text, "return 2", "return 3").count("return 3") == 1
    for anchor, error in (("return", "ANCHOR_NOT_UNIQUE"), ("nothing", "ANCHOR_NOT_FOUND")):
        with pytest.raises(edits.EditError) as e:
            edits.replace_anchor(text, anchor, "x")
        assert e.value.code == error
    assert edits.resolve_span(REPO["a.py"], "python", "B.m").start == 6
    with pytest.raises(edits.EditError) as e:
        edits.resolve_span(REPO["a.py"], "python", "m")
    assert e.value.code == "AMBIGUOUS"
    assert parse.balanced("f(a[1]) { \"}\" }") and not parse.balanced("f(a[1)")
    assert parse.python_nodes("x = 1")[0][2] == "Module" and (1, "body", "FunctionDef", "f", 1, 2) in parse.python_nodes("def f():\n  pass")
    assert parse.file_nodes("fn a() {\n  fn b() {\n  }\n}\nfn c() {\n}", "rust") == [(0, "", "fn", "a", 1, 4), (1, "", "fn", "b", 2, 3), (0, "", "fn", "c", 5, 6)]
    assert parse.file_nodes("class A:\n  def f(:\n    x", "python") == [(0, "", "class", "A", 1, 3), (1, "", "def", "f", 2, 3)]  # not readable: its items


def test_scan(spark, tree):
    (tree / "node_modules").mkdir()
    (tree / "node_modules/x.js").write_text("x")
    (tree / "bin.dat").write_bytes(b"a\0b")
    (tree / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tree / "big.txt").write_text("x" * ((1 << 20) + 1))
    (tree / ".gitignore").write_text("*.log\nout/\n")
    (tree / "noise.log").write_text("x")
    (tree / "out").mkdir()
    (tree / "out/y.txt").write_text("y")
    assert {r["path"] for r in fs.scan(spark, str(tree)).collect()} == set(REPO)
    assert rows(fs.skipped_large(spark, str(tree)), "path") == [("big.txt",)]


def test_sandbox(tree):
    box = fs.Sandbox(str(tree))
    assert [box.check(p) for p in ("ok.py", "/etc/x", "../x", "a/../../x", ".git/config", "mcp.json", ".github/w.yml")] == [None, "absolute", "escape", "escape", "blocked", "blocked", "blocked"]
    (tree / "link").symlink_to("/tmp")
    assert box.check("link/x") == "escape"
    (tree / "dos.txt").write_bytes(b"a\r\nb\r\n")
    box.commit([("dos.txt", "a\nc\n"), ("new/n.txt", "n"), ("a.py", None)])
    assert (tree / "dos.txt").read_bytes() == b"a\r\nc\r\n" and (tree / "new/n.txt").exists() and not (tree / "a.py").exists()


def test_session(spark, tree):
    s = Session.from_dir(spark, str(tree))
    assert "validate_token" in s.code("validate_token") and "UNTRUSTED" in s.code("refresh")
    assert "src/auth/login.rs@L5" in s.code({"q": "validate_token", "detail": "refs"})
    assert "depth 2" in s.code({"q": "base", "detail": "impact"}) and "chain.py" in s.code({"detail": "tree"})
    assert '"matches":' in s.code({"q": "validate_token", "detail": "count"}) and "class A" in s.code({"path": "a.py", "detail": "outline"})
    assert "2\t    t.len() > 3" in s.code({"path": "token.rs", "lines": "2-2"}) and "PATH_NOT_FOUND" in s.code({"path": "tokn.rs"})
    long = s.code({"queries": [{"path": "chain.py", "detail": "full"}], "budget_tokens": 70})
    assert "more lines" in long and "def base" in long
    assert "src/auth/login.rs@L5" in s.code({"q": "src/auth/token.rs#validate_token", "detail": "refs"})
    assert "packages/cli" not in s.code({"q": "packages/core/run.py#helper", "detail": "refs"})
    assert "FUZZY" in s.code("refrsh") and "PATTERN_NO_MATCH" in s.code("zzz+qqq")
    assert "import { render }" in s.code({"q": "render", "detail": "import", "path": "web/z.ts"}) and "Module" in s.code({"path": "a.py", "detail": "ast"})
    two = s.code({"queries": ["refresh", {"q": "login", "mode": "structural", "detail": "locate"}], "budget_tokens": 2000})
    assert "refresh" in two and "login" in two
    first = s.code({"queries": [{"q": "run|helper", "k": 1}], "exclude_seen": True})
    assert s.code({"queries": [{"q": "run|helper", "k": 1}], "exclude_seen": True}) != first

    done = s.apply({"locator": "src/auth/token.rs#refresh", "rename": "renew"})
    assert done["files"] == ["src/auth/login.rs", "src/auth/token.rs"] and "renew(t)" in (tree / "src/auth/login.rs").read_text()
    assert "src/auth/token.rs#renew" in s.code({"q": "renew", "mode": "structural"})  # reads see the write
    s.apply([{"locator": "chain.py#mid", "new_body": "def mid():\n    return base() + 1"}, {"locator": "fresh.py@new", "new_body": "x = 1\n"}])
    assert "base() + 1" in (tree / "chain.py").read_text() and (tree / "fresh.py").exists()
    s.apply({"undo": 1})
    assert "base() + 1" not in (tree / "chain.py").read_text() and not (tree / "fresh.py").exists()
    assert "renew" in s.code({"detail": "diff"})

    def refused(edit):
        with pytest.raises(edits.EditError) as e:
            s.apply(edit)
        return e.value.code

    assert refused({"locator": "chain.py#base@delete"}) == "STILL_USED"
    assert refused({"locator": "chain.py#base", "rename": "top"}) == "NAME_TAKEN" and refused({"locator": "chain.py#base", "rename": "class"}) == "BAD_NAME"
    assert refused({"locator": "chain.py#mid", "new_body": "def mid(:"}) == "PARSE_ERROR"
    assert refused({"locator": "gen/api.pb.go#Handle", "new_body": "func Handle() {}"}) == "GENERATED"
    assert refused({"locator": "chain.py#mid :: sha256=0000000000000000", "new_body": "def mid():\n    pass"}) == "STALE"
    assert refused({"locator": "a.py@new", "new_body": ""}) == "EXISTS" and refused({"locator": "x", "lazy_edit": "y"}) == "NOT_ENABLED"
    assert refused({"locator": "a.py@new", "new_body": ""}) == "REPEATED" and refused({"run": "test"}) == "RUN_DISABLED"
    assert refused({"locator": ".git/hooks/x@new", "new_body": "y"}) == "DENIED"
    before = (tree / "chain.py").read_text()
    assert refused([{"locator": "chain.py#top", "new_body": "def top():\n    pass"}, {"locator": "nowhere.py#x", "new_body": ""}]) == "PATH_NOT_FOUND"
    assert (tree / "chain.py").read_text() == before  # all or nothing
    assert "chain.py" in s.apply({"edits": [{"locator": "chain.py#test_top@delete"}], "dry_run": True})["diffs"] and (tree / "chain.py").read_text() == before
    only = s.apply({"locator": "packages/core/run.py#helper", "rename": "assist"})
    assert only["files"] == ["packages/core/run.py"]  # the other package keeps its own
    moved = s.apply({"locator": "chain.py#test_top", "move_to": "tests_top.py"})
    assert moved["files"] == ["chain.py", "tests_top.py"] and "def test_top" in (tree / "tests_top.py").read_text()
    noted = s.apply({"edits": [{"locator": "chain.py#base", "new_body": "def base():\n    return 5"}], "dry_run": True})["notes"]
    assert noted == ["base: 1 references in 1 files"]
    (tree / "late.py").write_text("def late():\n    pass\n")
    (tree / "README.md").unlink()
    assert s.reindex() == {"put": 1, "deleted": 1} and "late.py#late" in s.code({"q": "late", "mode": "structural"})
    assert s.reindex() == {"put": 0, "deleted": 0}
    assert "src/auth/token.rs" in s.repo_map(500) and s.status()["files"] > 5 and s.project() == {"packages/cli/package.json": "npm test", "packages/core/pyproject.toml": "pytest"}


def test_mixed_requests(spark, tree):
    """Every step sees what the ones before it did; guards hold on all ways."""
    s = Session.from_dir(spark, str(tree))
    token = (tree / "src/auth/token.rs").read_text()
    done = s.apply([
        {"locator": "src/auth/token.rs", "anchor": "t.len() > 3", "replace": "t.len() > 4"},
        {"locator": "src/auth/token.rs#refresh", "rename": "renew"},
        {"locator": "", "path_scope": ["src/auth/login.rs"], "anchor": "login", "replace": "log_in"},
        {"locator": "", "path_scope": ["src"], "anchor": "renew", "replace": "redo"},
        {"locator": "more.py@new", "new_body": "y = 1\n"},
        {"locator": "more.py", "anchor": "y = 1", "replace": "y = 2"},
        {"locator": "chain.py@delete"},
    ])
    want = token.replace("t.len() > 3", "t.len() > 4").replace("refresh", "redo")
    assert (tree / "src/auth/token.rs").read_text() == want and "redo" in (tree / "src/auth/login.rs").read_text() and "log_in" in (tree / "src/auth/login.rs").read_text()
    assert (tree / "more.py").read_text() == "y = 2\n" and not (tree / "chain.py").exists()
    assert done["n_files"] == 4 and done["files"] == ["chain.py", "more.py", "src/auth/login.rs", "src/auth/token.rs"]
    s.apply({"undo": 1})
    assert (tree / "src/auth/token.rs").read_text() == token and (tree / "chain.py").exists() and not (tree / "more.py").exists()
    (tree / "gen/api.pb.go").write_text("func Handle() int {\n\treturn 1\n}\n")
    s.reindex()
    for edit in ({"locator": "", "path_scope": ["gen"], "anchor": "return", "replace": "yield"}, {"locator": "gen/api.pb.go#Handle", "rename": "Serve"}, {"locator": "gen/api.pb.go@delete"}):
        with pytest.raises(edits.EditError) as e:
            s.apply(edit)
        assert e.value.code == "GENERATED"
    with pytest.raises(edits.EditError) as e:
        s.apply({"locator": "", "path_scope": ["chain.py"], "anchor": "def ", "replace": "def ("})
    assert e.value.code == "PARSE_ERROR"
    assert s.apply({"locator": "", "path_scope": ["gen"], "anchor": "return 1", "replace": "return 2", "force": True})["n_files"] == 1


def test_syntax_queries(spark, tree):
    for i in range(40):
        (tree / f"p{i:02}.py").write_text(f"x = {i}\n" + ("class Only:\n    pass\n" if i == 39 else ""))
    s = Session.from_dir(spark, str(tree))
    found = s.code({"q": "ClassDef Only", "mode": "ast"})
    assert "p39.py@L2-3" in found and "ClassDef Only" in found  # matches are capped, not files
    assert "src/auth/token.rs@L5-7" in s.code({"q": "fn refresh", "mode": "ast"})
    assert "fn refresh L5-7" in s.code({"path": "src/auth/token.rs", "detail": "ast"}) and "fn refresh" not in s.code({"path": "src/auth/token.rs", "detail": "ast", "lines": "1-3"})


def test_rpc(spark, tree):
    s = Session.from_dir(spark, str(tree))
    call = lambda m, **p: rpc.dispatch(s, {"jsonrpc": "2.0", "id": 1, "method": m, "params": p})
    assert call("ping")["result"] == {} and [t["name"] for t in call("tools/list")["result"]["tools"]] == ["code", "code_apply"]
    shape = call("tools/list")["result"]["tools"][0]["inputSchema"]
    assert shape["required"] == ["queries"] and "semantic" in shape["properties"]["queries"]["items"]["properties"]["mode"]["enum"]
    assert s.audit.table(spark).columns == ["at", "tool", "summary"]
    assert "refresh" in call("tools/call", name="code", arguments={"queries": ["refresh"]})["result"]["content"][0]["text"]
    assert json.loads(call("resources/read", uri="corpus://status")["result"]["contents"][0]["text"])["revision"] == 0
    assert call("nope")["error"]["code"] == -32601 and rpc.dispatch(s, {"method": "notifications/initialized"}) is None
    assert call("tools/call", name="code_apply", arguments={"locator": "x", "lazy_edit": "y"})["error"]["code"] == -32602


def test_requests():
    assert Request.of("x").queries == (Query(q="x"),) and Request.of([{"q": "a"}, "b"]).queries[1].q == "b"
    with pytest.raises(ValueError):
        Query(mode="psychic")
