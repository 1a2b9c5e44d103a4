"""Registered queries over source code: every document as a file of code.

The tables hold prose, so each document becomes a function in one of four languages, its
lines comments in it, which calls the function of the next document."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import SYMBOLS, longs, query
from .functions import paths
from .functions import text as tx
from .functions.locators import parse_locator
from .operators import code, edits, graph, parse, read
from .sources import corpus as co
from .sources import files as fs
from .sources.store import fingerprint, keep

#: By doc_id modulo 4: suffix, language, comment mark, heading word, what opens, what precedes and ends the call, what closes.
FORMS = [
    (".py", "python", "#", "def", ":", "return ", "", ""),
    (".rs", "rust", "//", "fn", " {", "", ";", "\n}"),
    (".js", "javascript", "//", "function", " {", "", ";", "\n}"),
    (".go", "go", "//", "func", " {", "", "", "\n}"),
]
#: The function that the queries ask about.
AT = 10


def _form(i: int, kind: str = "spark"):
    if kind == "spark":
        out = F.lit(FORMS[3][i])
        for k in (2, 1, 0):
            out = F.when(F.col("doc_id") % 4 == k, FORMS[k][i]).otherwise(out)
        return out
    quote = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    return "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {quote(f[i])}" for k, f in enumerate(FORMS)) + " END"


S = {n: _form(i, "sql") for i, n in enumerate(("suffix", "lang", "mark", "word", "opens", "before", "after", "closes"))}
CODE = f"""code AS (
  SELECT doc_id, 'src/f' || doc_id || {S['suffix']} AS path, {S['lang']} AS lang, {S['word']} AS word, 'fun' || doc_id AS name, 'fun' || (doc_id + 1) AS next,
    '    ' || {S['before']} || 'fun' || (doc_id + 1) || '()' || {S['after']} AS call,
    {S['word']} || ' fun' || doc_id || '()' AS signature, len(string_split(coalesce(text, ''), chr(10))) AS n,
    CAST(len(string_split(coalesce(text, ''), chr(10))) + CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 3 END AS BIGINT) AS last
  FROM documents WHERE doc_id IS NOT NULL
)"""


def tree(spark, sf_dir) -> co.Corpus:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    n = F.col("doc_id").cast("string")
    own, called = F.concat(F.lit("fun"), n, F.lit("()")), F.concat(F.lit("fun"), (F.col("doc_id") + 1).cast("string"), F.lit("()"))
    said = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.concat(F.lit("    "), _form(2), F.lit(" "), F.regexp_replace(x, "[^A-Za-z0-9 ]", "")))
    call = F.concat(F.lit("    "), _form(5), called, _form(6))
    text = F.concat(_form(3), F.lit(" "), own, _form(4), F.lit("\n"), F.array_join(said, "\n"), F.lit("\n"), call, _form(7), F.lit("\n"))
    path = F.concat(F.lit("src/f"), n, _form(0))
    files = df.select(path.alias("path"), text.alias("text"), paths.language(path, text).alias("lang"))
    key = f"{fingerprint(spark, f'{sf_dir}/documents.parquet')}-code"
    kept = lambda name, make, order: keep(spark, key, name, make, order)
    return co.Corpus(files, lambda: kept("symbols", lambda: parse.code_symbols(files), "name"), kept)


@query(f"WITH {CODE} SELECT lang, count(*) AS files FROM code GROUP BY lang")
def code_languages(spark, sf_dir):
    return tree(spark, sf_dir).files.groupBy("lang").agg(F.count("*").alias("files"))


@query(f'WITH {CODE} SELECT path, word AS kind, name, signature, CAST(1 AS BIGINT) AS start, last AS "end" FROM code')
def code_symbols(spark, sf_dir):
    s = tree(spark, sf_dir).symbols
    return longs(s.select("path", "kind", "name", "signature", "start", "end"), "start", "end")


@query(f"WITH {CODE} SELECT path, name, ident FROM (SELECT path, name, unnest(list_distinct([word, name, next, CASE WHEN lang = 'python' THEN 'return' ELSE name END])) AS ident FROM code) WHERE length(ident) >= 3")
def code_identifiers(spark, sf_dir):
    return graph.symbol_identifiers(tree(spark, sf_dir)).select("path", "name", "ident")


@query(f"WITH {CODE} SELECT path, unnest([name, next]) AS callee FROM code")
def code_calls(spark, sf_dir):
    files = tree(spark, sf_dir).files
    return files.select("path", F.explode(F.array_distinct(code.call_identifiers(F.col("text"), F.col("lang")))).alias("callee"))


@query(f"WITH {CODE} SELECT path, name, CAST(1 AS BIGINT) AS sites FROM code")
def code_call_sites(spark, sf_dir):
    files = tree(spark, sf_dir).files.withColumn("name", F.concat(F.lit("fun"), F.regexp_extract("path", "([0-9]+)", 1)))
    calls = code.call_identifiers(F.col("text"), F.col("lang"))
    return files.select("path", "name", F.size(F.filter(calls, lambda c: c == F.col("name"))).cast("long").alias("sites"))


@query(f"WITH {CODE} SELECT path, CAST(n + 2 AS BIGINT) AS line, call AS text FROM code WHERE next = 'fun{AT}'")
def code_refs(spark, sf_dir):
    return graph.references(tree(spark, sf_dir), f"fun{AT}")


@query(f"WITH {CODE} SELECT path, CASE WHEN lang = 'rust' THEN CAST(1 AS BIGINT) ELSE CAST(n + 2 AS BIGINT) END AS line, CASE WHEN lang = 'rust' THEN 'lsp' ELSE 'lexical' END AS tier FROM code WHERE next = 'fun{AT}' OR lang = 'rust'")
def code_refs_tiers(spark, sf_dir):
    """A provider that knows the Rust files and names the first line of each."""
    c = tree(spark, sf_dir)
    known = c.files.filter("lang = 'rust'").select("path")
    return graph.tiered_references(c, f"fun{AT}", known.withColumn("line", F.lit(1)), known).select("path", "line", "tier")


@query(f"WITH {CODE} SELECT path, name, CAST(1 AS BIGINT) AS start, CAST({AT} - doc_id AS BIGINT) AS depth FROM code WHERE doc_id BETWEEN {AT} - 5 AND {AT} - 1")
def code_impact(spark, sf_dir):
    return graph.impact(tree(spark, sf_dir), f"fun{AT}").select("path", "name", "start", "depth")


@query(f"WITH {CODE} SELECT CAST(count(*) FILTER (doc_id = {AT} - 1) AS BIGINT) AS direct, count(*) AS \"all\" FROM code WHERE doc_id BETWEEN {AT} - 5 AND {AT} - 1")
def code_reach_counts(spark, sf_dir):
    return graph.reach_counts(graph.impact(tree(spark, sf_dir), f"fun{AT}"))


@query(f"WITH {CODE} SELECT path, name, CAST(1 AS BIGINT) AS start, CAST(doc_id - {AT} AS BIGINT) AS depth FROM code WHERE doc_id BETWEEN {AT} + 1 AND {AT} + 5")
def code_callgraph(spark, sf_dir):
    return graph.callgraph(tree(spark, sf_dir), f"fun{AT}").select("path", "name", "start", "depth")


@query(f"WITH {CODE} SELECT CASE doc_id - {AT} WHEN 0 THEN 'definition' WHEN 1 THEN 'callee' ELSE 'caller' END AS role, path, name, CAST(1 AS BIGINT) AS start FROM code WHERE doc_id BETWEEN {AT} - 1 AND {AT} + 1")
def code_context(spark, sf_dir):
    return graph.context(tree(spark, sf_dir), f"fun{AT}")


@query(f"WITH {CODE} SELECT 'fun' || k AS name, count(*) AS n, count(DISTINCT path) AS files FROM code JOIN (VALUES ({AT}), ({AT + 7})) v(k) ON next = 'fun' || k GROUP BY k")
def code_blast_radius(spark, sf_dir):
    return graph.blast_radius(tree(spark, sf_dir), [f"fun{AT}", f"fun{AT + 7}", "fun0"])


@query(f"WITH {CODE} SELECT path, CAST(1 AS BIGINT) AS occurrences FROM code WHERE doc_id IN ({AT} - 1, {AT})")
def code_rename(spark, sf_dir):
    return edits.rename_preview(tree(spark, sf_dir).files, f"fun{AT}", "other").select("path", "occurrences")


@query(f"""WITH {CODE} SELECT a.path AS target, b.path AS definition, CASE a.lang
  WHEN 'javascript' THEN 'import {{ ' || b.name || ' }} from ''./f' || b.doc_id || ''';'
  WHEN 'python' THEN 'from src.f' || b.doc_id || ' import ' || b.name || '    # best-effort module path — verify'
  WHEN 'rust' THEN 'use crate::f' || b.doc_id || '::' || b.name || ';    // best-effort module path — verify'
  ELSE '// `' || b.name || '` is in ' || b.path || '; Go imports are package-level — import that package path' END AS statement
FROM code a JOIN code b ON b.doc_id = a.doc_id + 1""")
def code_import(spark, sf_dir):
    c = tree(spark, sf_dir)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long") + 1
    wanted = c.files.select(F.concat(F.lit("fun"), number.cast("string")).alias("name"), F.col("path").alias("target"))
    return graph.imports(c, wanted).select("target", "definition", "statement")


@query(f"WITH {CODE} SELECT path, CASE WHEN lang = 'python' THEN 'FunctionDef' ELSE word END AS kind, name, CAST(1 AS BIGINT) AS start, last AS \"end\" FROM code")
def code_syntax(spark, sf_dir):
    nodes = parse.syntax_nodes(tree(spark, sf_dir).files).filter("kind in ('FunctionDef', 'fn', 'function', 'func')")
    return longs(nodes.select("path", "kind", "name", "start", "end"), "start", "end")


@query(f"WITH {CODE} SELECT path, CAST(n + 2 AS BIGINT) AS line, next AS name FROM code WHERE lang = 'python' ORDER BY path LIMIT 50")
def code_syntax_query(spark, sf_dir):
    # calls: a Name node with the called function
    nodes = parse.syntax_nodes(tree(spark, sf_dir).files).filter("kind = 'Name'").orderBy("path").limit(50)
    return nodes.select("path", F.col("start").cast("long").alias("line"), "name")


@query(f"WITH {CODE} SELECT path, word || ' ' || name || ' L1-' || last AS tree FROM code WHERE lang <> 'python'")
def code_syntax_tree(spark, sf_dir):
    return parse.node_tree(tree(spark, sf_dir).files.filter("lang <> 'python'"))


@query(f"""WITH {CODE}, ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS total FROM code)
SELECT path, CAST(1 AS BIGINT) AS line, 'error' AS severity, 'bad ' || doc_id AS message, name, round(1 - i / (total + 1.0), 9) AS score FROM ranked""")
def code_diagnose(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    n = F.col("doc_id").cast("string")
    said = df.select(F.col("doc_id").alias("n"), F.concat(F.lit("src/f"), n, _form(0), F.lit(":1:5: error: bad "), n).alias("text"))
    found = read.diagnose(said, tree(spark, sf_dir))
    return found.select("path", "line", "severity", "message", "name", F.round("score", 9).alias("score"))


@query("""SELECT CASE doc_id % 4 WHEN 0 THEN 'src/f' || doc_id || '.rs' WHEN 1 THEN 'src/f' || doc_id || '.c' WHEN 2 THEN 'lib/f' || doc_id || '.ts' ELSE 'tools/f' || doc_id || '.py' END AS path,
  CAST(CASE doc_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 2 THEN 41 ELSE 9 END AS BIGINT) AS line,
  CASE doc_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' END AS severity, CASE WHEN doc_id % 4 < 3 THEN 'says ' || doc_id END AS message
FROM documents WHERE doc_id IS NOT NULL""")
def diagnose_parse(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    n = F.col("doc_id").cast("string")
    say = lambda *x: F.concat(*[n if i is None else F.lit(i) for i in x])
    k = F.col("doc_id") % 4
    first = F.when(k == 0, say("error[E0308]: says ", None)).when(k == 1, say("src/f", None, ".c:7:3: warning: says ", None)).when(k == 2, say("lib/f", None, ".ts(41,7): error TS2322: says ", None))
    first = first.otherwise(say('  File "tools/f', None, '.py", line 9, in <module>'))
    second = F.when(k == 0, say("  --> src/f", None, ".rs:12:5")).otherwise("")
    rows = df.select("doc_id", F.posexplode(F.array(first, second)).alias("i", "text"))
    return read.diagnostics(rows.select((F.col("doc_id") * 2 + F.col("i")).alias("n"), "text")).select("path", "line", "severity", "message")


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'introduced' ELSE 'fixed' END AS change, 'd' || doc_id AS path, CAST(doc_id % 9 AS BIGINT) AS line, lang AS message FROM documents WHERE doc_id % 3 < 2")
def diagnostics_delta(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    said = df.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 9).cast("long").alias("line"), F.col("lang").alias("message"), "doc_id")
    return read.diagnostics_delta(said.filter("doc_id % 3 <> 0"), said.filter("doc_id % 3 <> 1"))


PLACE = "'pkg' || (doc_id % 7) || '/sub' || (doc_id % 3) || '/d' || doc_id || '.txt'"


@query(f"SELECT {PLACE} AS path, CASE WHEN doc_id % 7 = 0 AND doc_id % 3 = 1 THEN 'pkg0/sub1' WHEN doc_id % 7 IN (0, 2) THEN 'pkg' || (doc_id % 7) END AS root FROM documents WHERE doc_id IS NOT NULL")
def package_roots(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    files = df.select(F.expr(PLACE).alias("path"))
    marks = spark.createDataFrame([("pkg0/package.json",), ("pkg2/go.mod",), ("pkg0/sub1/Cargo.toml",), ("pkg3/readme.md",)], "path string")
    return graph.package_roots(files, files.unionByName(marks))


ODD = "'src/' || CASE doc_id % 5 WHEN 0 THEN 'a.pb.go' WHEN 1 THEN 'generated/x.py' WHEN 2 THEN 'App.Designer.cs' WHEN 3 THEN 'x.generated.ts' ELSE 'generator.py' END"


@query(f"SELECT doc_id, {ODD} AS path, doc_id % 5 < 4 AS generated FROM documents WHERE doc_id IS NOT NULL")
def generated_files(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    return df.select("doc_id", F.expr(ODD).alias("path"), paths.is_generated(F.expr(ODD)).alias("generated"))


@query("SELECT doc_id, unnest(['get', 'url' || doc_id, lang, 'text']) AS subword FROM documents WHERE doc_id IS NOT NULL")
def subword_split(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    name = F.concat(F.lit("getUrl"), F.col("doc_id").cast("string"), F.lit("_"), F.col("lang"), F.lit("Text"))
    return df.select("doc_id", F.explode(tx.subwords(name)).alias("subword"))


@query(f"WITH {SYMBOLS} SELECT id AS locator, path, name AS symbol, CAST(line AS BIGINT) AS first, CAST(line AS BIGINT) AS last, substr(sha256(txt), 1, 16) AS hash FROM located")
def locator_round_trip(spark, sf_dir):
    rows = co.documents(spark, sf_dir).located.select(F.col("id").alias("locator"), parse_locator(F.col("id")).alias("p"))
    return rows.select("locator", "p.path", "p.symbol", F.col("p.start").cast("long").alias("first"), F.col("p.end").cast("long").alias("last"), "p.hash")


DOS = "CASE WHEN doc_id % 2 = 1 THEN replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) ELSE coalesce(text, '') END"


@query(f"""SELECT doc_id, crlf, CASE WHEN crlf THEN 'a' || chr(13) || chr(10) || 'c' ELSE 'a' || chr(10) || 'c' END AS out FROM (
  SELECT doc_id, (length(old) - length(replace(old, chr(13) || chr(10), chr(10)))) * 2 > length(old) - length(replace(old, chr(10), '')) AS crlf FROM (SELECT doc_id, {DOS} AS old FROM documents)
)""")
def line_ends(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("old", F.expr(DOS))
    return df.select("doc_id", fs.is_crlf(F.col("old")).alias("crlf"), fs.with_line_ends(F.lit("a\nc"), F.col("old")).alias("out"))
