"""The registered queries of the engine and their SQL oracles.

Every query runs over whole tables; a limit stands only where it is the operator's
own (a top-k, a page, a cap on a listing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions import text as tx
from .operators import edits, graph, links, pack, read, search
from .sources import corpus as co
from .streaming import refresh as rf

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text, lang FROM documents)"
SPLIT = "SELECT path, lang, text, a, len(a) - CASE WHEN len(a) > 1 AND a[len(a)] = '' THEN 1 ELSE 0 END AS n FROM (SELECT *, string_split(text, chr(10)) AS a FROM files)"
LINES = f"{FILES}, lines AS (SELECT path, lang, unnest(range(1, n + 1)) AS line, unnest(a[1:n]) AS txt FROM ({SPLIT}))"
SYMBOLS = f"""{LINES}, symbols AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS ord, regexp_extract(txt, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS name, txt, line
  FROM lines WHERE regexp_matches(txt, '[A-Za-z_][A-Za-z0-9_]{{2,}}')
), located AS (
  SELECT *, path || '#' || name || '@L' || line || '-' || line || ' :: sha256=' || substr(sha256(txt), 1, 16) AS id FROM symbols
)"""
TURNS = """turns AS (
  SELECT 'chat/' || conv_id || '.md' AS path, turn, role, coalesce(text, '') AS text, len(string_split(coalesce(text, ''), chr(10))) AS n FROM conversations
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY path ORDER BY turn) AS e, sum(n) OVER (PARTITION BY path ORDER BY turn) - n + 1 AS s, row_number() OVER (PARTITION BY path ORDER BY turn) AS ord FROM turns
), clines AS (
  SELECT path, turn, role, s + unnest(range(n)) AS line, unnest(string_split(text, chr(10))) AS txt FROM placed
)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Scans and derived tables.


@query(f"WITH {FILES} SELECT path, lang, strlen(text) AS n_bytes, substr(sha256(text), 1, 16) AS content_hash FROM files")
def files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = co.documents(spark, sf_dir).files
    return f.select("path", "lang", F.octet_length("text").cast("long").alias("n_bytes"), co.content_hash(F.col("text")).alias("content_hash"))


@query(f"WITH {FILES} SELECT lang, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM files GROUP BY lang")
def lang_profile(spark, sf_dir):
    return co.documents(spark, sf_dir).files.groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))


@query("SELECT CASE WHEN url LIKE '%.html' THEN 'page' ELSE 'other' END AS kind, count(*) AS files FROM pages GROUP BY 1")
def path_kinds(spark, sf_dir):
    kind = F.when(F.col("url").endswith(".html"), "page").otherwise("other")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(kind.alias("kind")).agg(F.count("*").alias("files"))


@query(f"WITH {LINES} SELECT path, line, CAST(coalesce(sum(strlen(txt) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines")
def line_index(spark, sf_dir):
    return co.line_starts(co.documents(spark, sf_dir))


@query(f"WITH {SYMBOLS} SELECT f.path, CAST(f.n AS BIGINT) AS lines, strlen(f.text) AS bytes, coalesce(s.c, 0) AS symbols FROM ({SPLIT}) f LEFT JOIN (SELECT path, count(*) AS c FROM symbols GROUP BY path) s USING (path)")
def file_metrics(spark, sf_dir):
    return co.file_metrics(co.documents(spark, sf_dir))


@query(f"WITH {SYMBOLS} SELECT path, CAST(ord AS BIGINT) AS ord, 'para' AS kind, name, txt AS signature, line AS start, id FROM located")
def symbol_table(spark, sf_dir):
    s = co.documents(spark, sf_dir).located
    return longs(s.select("path", "ord", "kind", "name", "signature", "start", "id"), "ord", "start")


@query(f"WITH {SYMBOLS} SELECT path, string_agg(txt || ' @L' || line || '-' || line, chr(10) ORDER BY ord) AS outline FROM symbols GROUP BY path")
def subtree_outline(spark, sf_dir):
    return co.repo_outline(co.documents(spark, sf_dir)).select("path", F.array_join("outline", "\n").alias("outline"))


TOKENS = "tokens AS (SELECT DISTINCT path, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}')) AS token FROM files)"


@query(f"WITH {FILES}, {TOKENS} SELECT * FROM tokens")
def token_index(spark, sf_dir):
    return co.documents(spark, sf_dir).tokens


@query(f"WITH {FILES}, {TOKENS} SELECT token, count(*) AS df FROM tokens GROUP BY token")
def token_df(spark, sf_dir):
    return co.documents(spark, sf_dir).tokens.groupBy("token").agg(F.count("*").alias("df"))


BAGS = f"""{SYMBOLS}, bags AS (
  SELECT id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(name || ' ' || txt, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 2)) AS bag FROM located
)"""


@query(f"WITH {BAGS} SELECT subword, count(*) AS df FROM (SELECT unnest(bag) AS subword FROM bags) GROUP BY subword")
def subword_df(spark, sf_dir):
    return co.subword_frequency(co.documents(spark, sf_dir))


@query("""SELECT regexp_replace(url, '^[a-z]+://', '') || '.' || page_id || '.html' AS path, regexp_extract(h, '[A-Za-z_][A-Za-z0-9_]{2,}') AS name, h AS signature
FROM (SELECT *, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h FROM pages) WHERE regexp_extract(h, '[A-Za-z_][A-Za-z0-9_]{2,}') <> ''""")
def page_symbols(spark, sf_dir):
    return co.pages(spark, sf_dir).symbols.select("path", "name", "signature")


@query(f"WITH {SYMBOLS} SELECT id, 'L' || line || '-' || line || ' ' || txt AS text FROM located")
def locate_lines(spark, sf_dir):
    return read.locate(co.documents(spark, sf_dir))


# Filters, hits and counts.

SCOPE = ["src1*/en/**", "src2", "!**/1*.txt"]


@query(f"WITH {FILES} SELECT path FROM files WHERE (regexp_matches(path, '^src1[^/]*/en/.*$') OR path LIKE 'src2/%') AND NOT regexp_matches(path, '^.*1[^/]*\\.txt$')")
def scope_filter(spark, sf_dir):
    return co.documents(spark, sf_dir).scoped(SCOPE).files.select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT regexp_matches(path, '^src[^/]/[^/]*/[^/]*[02468]\\.txt$')")
def glob_exclude(spark, sf_dir):
    globs = [f"!src?/*/*{d}.txt" for d in "02468"]
    return co.documents(spark, sf_dir).scoped(globs).files.select("path")


@query("SELECT url, page_id FROM pages WHERE (ends_with(url, '.html') OR ends_with(url, '.htm'))")
def lang_filter(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return df.filter(paths.lang_filter(F.col("url"), "html")).select("url", "page_id")


@query(f"WITH {LINES} SELECT path, count(*) AS lines, CAST(sum(len(regexp_extract_all(txt, 'worthless'))) AS BIGINT) AS matches FROM lines WHERE contains(txt, 'worthless') GROUP BY path ORDER BY lines DESC, path LIMIT 200")
def count_literal(spark, sf_dir):
    return search.count_matches(co.documents(spark, sf_dir), "worthless")


@query(f"WITH {LINES} SELECT path, count(*) AS lines, CAST(sum(len(regexp_extract_all(txt, '(?i)worthless|disgusting'))) AS BIGINT) AS matches FROM lines WHERE regexp_matches(txt, '(?i)worthless|disgusting') GROUP BY path ORDER BY lines DESC, path LIMIT 200")
def count_regex(spark, sf_dir):
    return search.count_matches(co.documents(spark, sf_dir), "worthless|disgusting")


BOOL = {"all_of": ["the"], "any_of": ["tion", "ing"], "none_of": ["stupid", "|"]}
BOOL_SQL = "contains(lower(txt), 'the') AND (contains(lower(txt), 'tion') OR contains(lower(txt), 'ing')) AND NOT contains(lower(txt), 'stupid') AND NOT contains(lower(txt), '|')"


@query(f"WITH {LINES} SELECT path, count(*) AS lines FROM lines WHERE {BOOL_SQL} GROUP BY path ORDER BY lines DESC, path LIMIT 200")
def count_boolean(spark, sf_dir):
    return search.count_boolean(co.documents(spark, sf_dir), **BOOL)


@query(f"WITH {LINES}, c AS (SELECT path, count(*) AS lines FROM lines WHERE {BOOL_SQL} GROUP BY path) SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM c")
def count_totals(spark, sf_dir):
    return search.totals(search.count_boolean(co.documents(spark, sf_dir), **BOOL, limit=None))


K = 8
HITS = f"hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM lines WHERE regexp_matches(txt, '(?i)apache|licen[sc]ed')) WHERE r <= {K})"


@query(f"WITH {LINES}, {HITS} SELECT path, line, txt AS text FROM hits")
def lexical_hits(spark, sf_dir):
    return longs(search.regex_hits(co.documents(spark, sf_dir), "apache|licen[sc]ed", K), "line")


@query(f"WITH {SYMBOLS}, {HITS}, c AS (SELECT l.id, count(*) AS hits FROM hits h JOIN located l ON l.path = h.path AND l.line = h.line GROUP BY l.id) SELECT id, hits, row_number() OVER (ORDER BY hits DESC, id) - 1 AS rank FROM c")
def lexical_rank(spark, sf_dir):
    c = co.documents(spark, sf_dir)
    return search.lexical_rank(c, search.regex_hits(c, "apache|licen[sc]ed", K))


@query(f"WITH {LINES} SELECT path, line, text FROM (SELECT path, line, txt AS text, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM lines WHERE {BOOL_SQL}) WHERE r <= {K}")
def boolean_search(spark, sf_dir):
    return longs(search.boolean_hits(co.documents(spark, sf_dir), **BOOL, per_file=K), "line")


@query(f"WITH {TURNS} SELECT path, CAST(line AS BIGINT) AS line, txt AS text, role || '_' || turn AS name, CAST(s AS BIGINT) AS start FROM clines JOIN placed USING (path, turn, role) WHERE contains(lower(txt), 'the')")
def enclosing_symbol(spark, sf_dir):
    c = co.conversations(spark, sf_dir)
    found = search.enclosing(search.regex_hits(c, "the"), c)
    return longs(found.select("path", "line", "text", "name", "start"), "line", "start")


@query(f"WITH {TURNS} SELECT path, 'conversation' AS name, CAST(1 AS BIGINT) AS start, string_agg(split_part(text, chr(10), 1) || ' @L' || s || '-' || e, chr(10) ORDER BY s, ord) AS members FROM placed p WHERE (SELECT count(*) FROM turns t WHERE t.path = p.path) > 1 GROUP BY path")
def container_outline(spark, sf_dir):
    return read.container_outline(co.conversations(spark, sf_dir))


@query(f"WITH {SYMBOLS}, f AS (SELECT DISTINCT id, path, CASE WHEN lower(name) = 'the' THEN 0 WHEN starts_with(lower(name), 'the') THEN 1 ELSE 2 END AS quality FROM located WHERE contains(lower(name), 'the')) SELECT id, path, CAST(quality AS BIGINT) AS quality, row_number() OVER (ORDER BY quality, path, id) - 1 AS rank FROM f")
def structural_search(spark, sf_dir):
    return longs(search.structural(co.documents(spark, sf_dir), "the"), "quality")


SEM = "licensed apache version"
SEM_SQL = f"""{BAGS}, stats AS (SELECT count(*) AS n, count(*) FILTER (list_contains(bag, 'licensed')) AS d1, count(*) FILTER (list_contains(bag, 'apache')) AS d2, count(*) FILTER (list_contains(bag, 'version')) AS d3 FROM bags),
scored AS (
  SELECT id, max(0.0 + CASE WHEN list_contains(bag, 'apache') THEN ln(n / d2) + 1 ELSE 0 END + CASE WHEN list_contains(bag, 'licensed') THEN ln(n / d1) + 1 ELSE 0 END + CASE WHEN list_contains(bag, 'version') THEN ln(n / d3) + 1 ELSE 0 END) AS score
  FROM bags, stats WHERE list_has_any(bag, ['licensed', 'apache', 'version']) GROUP BY id
), sem AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM scored QUALIFY rank < 8)"""


@query(f"WITH {SEM_SQL} SELECT id, round(score, 9) AS score, rank FROM sem")
def semantic_topk(spark, sf_dir):
    c = co.documents(spark, sf_dir)
    return search.semantic(c, c, SEM, K).withColumn("score", F.round("score", 9))


MENTION_SQL = "mention AS (SELECT id, path, ord, row_number() OVER (ORDER BY path, ord, id) - 1 AS rank FROM located WHERE lower(name) IN ('licensed', 'released', 'copyright'))"


@query(f"WITH {SYMBOLS}, {MENTION_SQL} SELECT id, path, CAST(ord AS BIGINT) AS ord, rank FROM mention")
def symbol_mention(spark, sf_dir):
    return longs(search.mentions(co.documents(spark, sf_dir), "what is Licensed, Released or Copyright?"), "ord")


AUTO = "licensed"
AUTO_SQL = f"""{SYMBOLS}, hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM lines WHERE regexp_matches(txt, '(?i){AUTO}')) WHERE r <= {K}),
lex AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) - 1 AS rank FROM (SELECT l.id, count(*) AS c FROM hits h JOIN located l ON l.path = h.path AND l.line = h.line GROUP BY l.id)),
st AS (SELECT id, row_number() OVER (ORDER BY quality, path, id) - 1 AS rank FROM (SELECT DISTINCT id, path, CASE WHEN lower(name) = '{AUTO}' THEN 0 WHEN starts_with(lower(name), '{AUTO}') THEN 1 ELSE 2 END AS quality FROM located WHERE contains(lower(name), '{AUTO}'))),
fused AS (SELECT id, sum(1.0 / (rank + 61)) AS score FROM (SELECT * FROM st UNION ALL SELECT * FROM lex) GROUP BY id)"""


@query(f"WITH {AUTO_SQL} SELECT id, round(score, 9) AS score FROM fused")
def rrf_fusion(spark, sf_dir):
    c = co.documents(spark, sf_dir)
    lex = search.lexical_rank(c, search.regex_hits(c, AUTO, K))
    return search.rrf((1.0, search.structural(c, AUTO)), (1.0, lex)).withColumn("score", F.round("score", 9))


@query(f"WITH {AUTO_SQL} SELECT id, round(score, 9) AS score FROM fused ORDER BY round(score, 12) DESC, id LIMIT {K}")
def search_auto(spark, sf_dir):
    return search.search_auto(co.documents(spark, sf_dir), AUTO, K).withColumn("score", F.round("score", 9))


@query(f"""WITH {SEM_SQL}, named AS (SELECT id, row_number() OVER (ORDER BY path, ord, id) - 1 AS rank FROM located WHERE lower(name) IN ('licensed', 'apache', 'version')),
fused AS (SELECT id, sum(part) AS score FROM (SELECT id, 0.3 / (rank + 61) AS part FROM named UNION ALL SELECT id, 0.2 / (rank + 61) FROM sem) GROUP BY id)
SELECT id, round(score, 9) AS score FROM fused ORDER BY round(score, 12) DESC, id LIMIT {K}""")
def search_second_phase(spark, sf_dir):
    """No line or name is like the query, so mentions and subwords decide."""
    return search.search_auto(co.documents(spark, sf_dir), SEM, K).withColumn("score", F.round("score", 9))


@query(f"WITH {LINES} SELECT 0 AS q_idx, count(*) AS hits FROM lines WHERE contains(lower(txt), 'worthless') HAVING count(*) > 0 UNION ALL SELECT 1, count(*) FROM lines WHERE contains(lower(txt), 'disgusting') HAVING count(*) > 0")
def attribution(spark, sf_dir):
    c = co.documents(spark, sf_dir)
    parts = [search.regex_hits(c, q).withColumn("q_idx", F.lit(i)) for i, q in enumerate(("worthless", "disgusting"))]
    return search.attribution(parts[0].unionByName(parts[1]))


@query(f"WITH {SYMBOLS} SELECT 'FUZZY' AS code, name, path FROM (SELECT DISTINCT name, path, levenshtein(lower(name), 'licencsed') AS distance FROM symbols WHERE abs(length(name) - 9) <= 2 AND levenshtein(lower(name), 'licencsed') BETWEEN 1 AND 2 ORDER BY distance, length(name), path, name LIMIT 5)")
def no_match(spark, sf_dir):
    c = co.documents(spark, sf_dir)
    found = search.no_match_hint(c, c, "licencsed")
    return spark.createDataFrame([(found.code, n, p) for n, p in found.near], "code string, name string, path string")


# Packing.

SPANS = "spans AS (SELECT doc_id AS d, 'd' || doc_id AS id, coalesce(text, '') AS text, ((doc_id * 37) % 101) / 101.0 AS score FROM documents)"


def _spans(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = F.pmod(F.col("doc_id") * 37, F.lit(101)) / F.lit(101.0)
    return df.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), score.alias("score"), "doc_id")


@query(f"""WITH RECURSIVE {SPANS}, ranked AS (SELECT *, greatest(1, strlen(text) // 4) + 8 AS cost, row_number() OVER (ORDER BY score DESC, id) AS r FROM spans),
walk AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, false AS kept
  UNION ALL
  SELECT w.r + 1, CASE WHEN w.used + k.cost <= 8000 THEN w.used + k.cost ELSE w.used END, w.used + k.cost <= 8000 FROM walk w JOIN ranked k ON k.r = w.r + 1
)
SELECT row_number() OVER (ORDER BY k.r) - 1 AS pos, k.id, CAST(k.cost AS BIGINT) AS cost FROM walk w JOIN ranked k USING (r) WHERE w.kept""")
def budget_pack(spark, sf_dir):
    return pack.budget_pack(_spans(spark, sf_dir), 8000).select("pos", "id", "cost")


@query(f"WITH {SPANS}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r, count(*) OVER () AS n FROM spans) SELECT id, CAST(CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - (r - 1) // 2 END AS BIGINT) AS place FROM r")
def edge_order(spark, sf_dir):
    return pack.edge_order(_spans(spark, sf_dir)).select("id", "place")


@query(f"""WITH {SPANS}, q AS (SELECT *, d % 3 AS q_idx, row_number() OVER (PARTITION BY d % 3 ORDER BY score DESC, id) - 1 AS rank FROM spans),
u AS (SELECT *, sum(greatest(1, strlen(text) // 4) + 8) OVER (PARTITION BY q_idx ORDER BY rank, id) AS used FROM q)
SELECT id, CAST(q_idx AS BIGINT) AS q_idx, rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= 2666 OR rank = 0""")
def fair_share(spark, sf_dir):
    from pyspark.sql import Window as W

    s = _spans(spark, sf_dir).withColumn("q_idx", F.pmod("doc_id", F.lit(3)))
    s = s.withColumn("rank", (F.row_number().over(W.partitionBy("q_idx").orderBy(F.desc("score"), "id")) - 1).cast("long"))
    return longs(pack.fair_share(s, 8000, 3), "used").select("id", "q_idx", "rank", "used")


@query("WITH s AS (SELECT lang AS id, CAST(substr(source, 4) AS BIGINT) % 4 AS q_idx, doc_id AS rank FROM documents) SELECT id, q_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q_idx, rank) AS r FROM s) WHERE r = 1")
def dedup_spans(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    q = F.pmod(F.substring("source", 4, 9).cast("long"), F.lit(4))
    return pack.dedup_spans(df.select(F.col("lang").alias("id"), q.alias("q_idx"), F.col("doc_id").alias("rank")))


@query(f"WITH {SPANS} SELECT id, round(score / max(score) OVER (), 9) AS score FROM spans")
def score_normalise(spark, sf_dir):
    return pack.normalise(_spans(spark, sf_dir).select("id", "score")).withColumn("score", F.round("score", 9))


@query(f"WITH {AUTO_SQL} SELECT id, round(score, 9) AS score FROM fused ORDER BY round(score, 12) DESC, id LIMIT {K} OFFSET {K}")
def exclude_seen_page2(spark, sf_dir):
    c = co.documents(spark, sf_dir)
    lex = search.lexical_rank(c, search.regex_hits(c, AUTO, K))
    fused = search.rrf((1.0, search.structural(c, AUTO)), (1.0, lex)).persist()
    seen = fused.orderBy(F.desc("score"), "id").limit(K)
    return search.exclude_seen(fused, seen).orderBy(F.desc("score"), "id").limit(K).withColumn("score", F.round("score", 9))


# Reading.


@query(f"WITH {LINES} SELECT path, line, txt AS text FROM lines WHERE path = (SELECT max(path) FROM files) AND line BETWEEN 2 AND 6")
def read_range(spark, sf_dir):
    c = co.documents(spark, sf_dir)
    return read.read_range(c, c.files.agg(F.max("path")).first()[0], "2-6")


@query(f"WITH {LINES} SELECT path, line, txt AS text FROM lines WHERE line <= 3")
def read_head(spark, sf_dir):
    return read.ends(co.documents(spark, sf_dir), 3)


@query(f"WITH {LINES} SELECT path, line, txt AS text FROM lines JOIN (SELECT path, max(line) AS m FROM lines GROUP BY path) USING (path) WHERE line > m - 2")
def read_tail(spark, sf_dir):
    return read.ends(co.documents(spark, sf_dir), 2, tail=True)


@query(f"""WITH {TURNS}, conv AS (SELECT path, max(e) AS e FROM placed GROUP BY path), hit AS (SELECT path, min(line) AS line FROM clines WHERE contains(lower(txt), 'the') GROUP BY path),
w AS (SELECT path, CASE WHEN e - 1 >= 40 THEN greatest(1, line - 14) ELSE 1 END AS a, CASE WHEN e - 1 >= 40 THEN least(e, line + 14) ELSE e END AS b FROM hit JOIN conv USING (path))
SELECT w.path AS id, w.path, CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS last, string_agg(l.line || chr(9) || l.txt, chr(10) ORDER BY l.line) AS snippet FROM w JOIN clines l ON l.path = w.path AND l.line BETWEEN a AND b GROUP BY w.path, a, b""")
def snippet_window(spark, sf_dir):
    c = co.conversations(spark, sf_dir)
    whole = c.symbols.filter("kind = 'conversation'").select("path", "start", "end")
    hits = search.regex_hits(c, "the").groupBy("path").agg(F.min("line").alias("line")).join(whole, "path").withColumn("id", F.col("path"))
    return read.snippets(hits, c)


@query(f"""WITH {FILES}, t AS (SELECT path FROM files ORDER BY path LIMIT 400), p AS (SELECT path, lag(path) OVER (ORDER BY path) AS prev FROM t)
SELECT path, split_part(path, '/', 3) AS entry, CAST(2 AS BIGINT) AS depth, CAST(CASE WHEN prev IS NULL OR split_part(path, '/', 1) <> split_part(prev, '/', 1) THEN 2 WHEN split_part(path, '/', 2) <> split_part(prev, '/', 2) THEN 1 ELSE 0 END AS BIGINT) AS new_dirs FROM p""")
def tree_listing(spark, sf_dir):
    return read.tree(co.documents(spark, sf_dir).files)


@query(f"WITH {FILES}, h AS (SELECT path FROM files WHERE path = 'en/1.txt' OR ends_with(path, '/en/1.txt')) SELECT min(path) AS path FROM h HAVING count(*) = 1")
def resolve_path(spark, sf_dir):
    return search.resolve_path(co.documents(spark, sf_dir).files, "en/1.txt")


# Graphs.

REF = "Licensed"
MIN = 3
USED, USER = "worthless", "The"


@query(f"WITH {SYMBOLS} SELECT l.path, l.line, l.txt AS text FROM lines l WHERE regexp_matches(l.txt, '(^|[^A-Za-z0-9_])under([^A-Za-z0-9_]|$)') AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.path = l.path AND s.line = l.line AND s.name = 'under')")
def refs(spark, sf_dir):
    return graph.references(co.documents(spark, sf_dir), "under")


@query(f"WITH {SYMBOLS} SELECT path, 'para' AS kind, line AS start, line AS end, id FROM located WHERE name = '{REF}'")
def definition_lookup(spark, sf_dir):
    return graph.definitions(co.documents(spark, sf_dir), REF)


USES = f"""{SYMBOLS}, uses AS (
  SELECT DISTINCT path, name, line, ident FROM (SELECT path, name, line, unnest(regexp_extract_all(txt, '[A-Za-z_][A-Za-z0-9_]*')) AS ident FROM symbols) WHERE length(ident) >= 3
)"""


@query(f"WITH {USES} SELECT DISTINCT path, name AS caller, line AS start FROM uses WHERE ident = 'Apache' AND name <> 'Apache'")
def callers(spark, sf_dir):
    return graph.callers(co.documents(spark, sf_dir), "Apache")


@query(f"WITH {USES}, up AS (SELECT DISTINCT path, name, line FROM uses WHERE ident = '{REF}' AND name <> '{REF}' ORDER BY path, line LIMIT 40) SELECT 'definition' AS role, path, name, line AS start FROM symbols WHERE name = '{REF}' UNION ALL SELECT CASE WHEN starts_with(lower(name), 'test') THEN 'test' ELSE 'caller' END, path, name, line FROM up")
def context_summary(spark, sf_dir):
    return graph.context(co.documents(spark, sf_dir), REF)


LONG_USES = f"{USES}, long AS (SELECT * FROM uses WHERE length(ident) >= {MIN} AND ident <> name AND ident IN (SELECT name FROM symbols))"


@query(f"""WITH RECURSIVE {LONG_USES}, pairs AS (SELECT DISTINCT ident, name FROM long), lv AS (
  SELECT '{USED}' AS name, 0 AS d UNION SELECT u.name, lv.d + 1 FROM lv JOIN pairs u ON u.ident = lv.name WHERE lv.d < 5
), ml AS (SELECT name, min(d) AS d FROM lv GROUP BY name)
SELECT u.path, u.name, u.line AS start, CAST(min(ml.d) + 1 AS BIGINT) AS depth FROM long u JOIN ml ON u.ident = ml.name WHERE ml.d < 5 GROUP BY ALL""")
def impact_bfs(spark, sf_dir):
    return graph.impact(co.documents(spark, sf_dir), USED, min_len=MIN).select("path", "name", "start", "depth")


@query(f"""WITH RECURSIVE {LONG_USES}, pairs AS (SELECT DISTINCT ident, name FROM long), lv AS (
  SELECT '{USER}' AS name, 0 AS d UNION SELECT u.ident, lv.d + 1 FROM lv JOIN pairs u ON u.name = lv.name WHERE lv.d < 5
), ml AS (SELECT name, min(d) AS d FROM lv GROUP BY name)
SELECT s.path, s.name, s.line AS start, CAST(min(ml.d) + 1 AS BIGINT) AS depth FROM pairs u JOIN ml ON u.name = ml.name JOIN symbols s ON s.name = u.ident WHERE ml.d < 5 GROUP BY ALL""")
def callgraph_bfs(spark, sf_dir):
    return graph.callgraph(co.documents(spark, sf_dir), USER, calls_only=False, min_len=MIN).select("path", "name", "start", "depth")


EDGES = f"""{SYMBOLS}, names AS (SELECT DISTINCT path, name FROM symbols WHERE length(name) >= {MIN}),
idents AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS name FROM files),
edges AS (SELECT DISTINCT i.path AS src, n.path AS dst FROM idents i JOIN names n USING (name) WHERE i.path <> n.path)"""


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def reference_edges(spark, sf_dir):
    return links.edges(co.documents(spark, sf_dir), MIN)


@query(f"WITH {EDGES} SELECT src, count(*) AS deg FROM edges GROUP BY src")
def out_degree(spark, sf_dir):
    return links.degrees(co.documents(spark, sf_dir), MIN)


RANKS = f"""{EDGES}, outs AS (SELECT src, list(dst) AS dsts, count(*) AS deg FROM edges GROUP BY src), nn AS (SELECT count(*) AS n FROM files),
pr AS (
  SELECT 0 AS i, path, CAST(1.0 AS DOUBLE) / n AS rank FROM files, nn
  UNION ALL
  SELECT i, path, 0.15 / n + 0.85 * (sum(c) + max(lost) / n) AS rank FROM (
    SELECT i, unnest(goals) AS path, unnest(cs) AS c, lost FROM (
      SELECT pr.i + 1 AS i, list_append(coalesce(dsts, []), pr.path) AS goals,
        list_append(list_transform(coalesce(dsts, []), lambda x: pr.rank / deg), CAST(0 AS DOUBLE)) AS cs,
        sum(CASE WHEN deg IS NULL THEN pr.rank ELSE 0 END) OVER () AS lost
      FROM pr LEFT JOIN outs ON outs.src = pr.path WHERE pr.i < 30
    )
  ), nn GROUP BY i, path, n
), ranks AS (SELECT path, rank FROM pr WHERE i = 30)"""


@query(f"WITH RECURSIVE {RANKS} SELECT path, round(rank, 8) AS rank FROM ranks")
def pagerank(spark, sf_dir):
    return links.ranks(co.documents(spark, sf_dir), MIN, graph.DAMPING, graph.ITERATIONS).withColumn("rank", F.round("rank", 8))


@query(f"""WITH RECURSIVE {RANKS}, firsts AS (SELECT path, name, txt, ord, row_number() OVER (PARTITION BY path ORDER BY ord) AS r FROM (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY ord) AS k FROM symbols) WHERE k = 1),
listed AS (SELECT path, string_agg(txt, chr(10) ORDER BY ord) AS names FROM firsts WHERE r <= 6 GROUP BY path),
run AS (SELECT path, names, sum(greatest(1, strlen(path || chr(10) || names) // 4)) OVER (ORDER BY round(rank, 12) DESC, path) AS used FROM listed JOIN ranks USING (path))
SELECT path, names, CAST(used AS BIGINT) AS used FROM run WHERE used <= 6000""")
def repo_map(spark, sf_dir):
    c = co.documents(spark, sf_dir)
    ranks = links.ranks(c, MIN, graph.DAMPING, graph.ITERATIONS).withColumn("rank", F.round("rank", 12))
    return graph.repo_map(c, ranks, 6000).select("path", "names", "used")


# Recovery and diagnostics.


@query(f"WITH {SYMBOLS} SELECT DISTINCT name, path, levenshtein(lower(name), 'licencsed') AS distance FROM symbols WHERE abs(length(name) - 9) <= 2 AND levenshtein(lower(name), 'licencsed') BETWEEN 1 AND 2 ORDER BY distance, length(name), path, name LIMIT 5")
def fuzzy_symbol(spark, sf_dir):
    return search.fuzzy_symbols(co.documents(spark, sf_dir), "licencsed")


@query(f"WITH {FILES} SELECT path, levenshtein(split_part(path, '/', 3), '12.tx') AS distance FROM files WHERE levenshtein(split_part(path, '/', 3), '12.tx') <= 2 ORDER BY distance, path LIMIT 3")
def path_typo(spark, sf_dir):
    return search.path_suggestions(co.documents(spark, sf_dir).files, "src/en/12.tx")


# Edits.


@query(f"WITH {FILES} SELECT path, len(regexp_extract_all(text, 'Licensed')) AS occurrences, replace(text, 'Licensed', 'Permitted') AS new_text FROM files WHERE starts_with(path, 'src1') AND contains(text, 'Licensed')")
def bulk_replace_preview(spark, sf_dir):
    return edits.bulk_replace(co.documents(spark, sf_dir).files, ["src1**"], "Licensed", "Permitted")


@query(f"WITH {FILES} SELECT path, len(regexp_extract_all(text, '\\bApache\\b')) AS occurrences, regexp_replace(text, '\\bApache\\b', 'Cochise', 'g') AS new_text FROM files WHERE regexp_matches(text, '\\bApache\\b')")
def rename_preview(spark, sf_dir):
    return edits.rename_preview(co.documents(spark, sf_dir).files, "Apache", "Cochise")


def _versions(spark, sf_dir):
    """Three batches: all files, a change of some, deletions of others."""
    f = co.documents(spark, sf_dir).files.withColumn("d", F.regexp_extract("path", "([0-9]+)\\.txt$", 1).cast("long"))
    first = f.select("path", F.lit(0).cast("long").alias("revision"), "text", F.lit("put").alias("op"), F.lit(0).cast("long").alias("batch_id"))
    second = edits.upsert(first, f.filter("d % 10 = 3").select("path", F.concat("text", F.lit("\nmore")).alias("text")), 1, 1)
    return edits.upsert(second, f.filter("d % 10 = 4").select("path", F.lit(None).cast("string").alias("text")), 2, 2)


NUMBERED = f"{FILES}, v AS (SELECT path, text, CAST(regexp_extract(path, '([0-9]+)\\.txt$', 1) AS BIGINT) AS d FROM files)"


@query(f"WITH {NUMBERED} SELECT path, text AS old_text, CASE WHEN d % 10 = 3 THEN text || chr(10) || 'more' END AS new_text, CASE WHEN d % 10 = 3 THEN 'changed' ELSE 'deleted' END AS change FROM v WHERE d % 10 IN (3, 4)")
def session_diff(spark, sf_dir):
    return edits.session_diff(_versions(spark, sf_dir), 0)


@query(f"WITH {NUMBERED} SELECT path, CAST(CASE WHEN d % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS added, CAST(CASE WHEN d % 10 = 4 THEN len(string_split(text, chr(10))) ELSE 0 END AS BIGINT) AS removed_lines FROM v WHERE d % 10 IN (3, 4)")
def diff_line_counts(spark, sf_dir):
    return edits.diff_counts(edits.session_diff(_versions(spark, sf_dir), 0)).withColumnRenamed("removed", "removed_lines")


@query(f"WITH {NUMBERED} SELECT path, CASE WHEN d % 10 = 3 THEN text || chr(10) || 'more' ELSE text END AS text FROM v")
def undo_restore(spark, sf_dir):
    return edits.latest(edits.undo(_versions(spark, sf_dir), 1, 3)).select("path", "text")


@query(f"WITH {SYMBOLS} SELECT path, name, h AS hash, CASE WHEN line % 2 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM (SELECT path, name, line, CASE WHEN line % 2 = 0 THEN 'feedfeedfeedfeed' ELSE substr(sha256(txt), 1, 16) END AS h FROM symbols WHERE name = '{REF}') GROUP BY ALL")
def stale_locator(spark, sf_dir):
    located = co.documents(spark, sf_dir).located
    h = F.when(F.col("start") % 2 == 0, "feedfeedfeedfeed").otherwise(F.substring_index("id", "sha256=", -1))
    return edits.stale(located, located.filter(F.col("name") == REF).select("path", "name", h.alias("hash")).distinct())


@query(f"WITH {SYMBOLS} SELECT name, count(*) AS taken FROM symbols WHERE name IN ('Apache', 'Licensed', 'Released') GROUP BY name")
def rename_collision(spark, sf_dir):
    wanted = spark.createDataFrame([("Apache",), ("Licensed",), ("Released",)], "name string")
    return co.documents(spark, sf_dir).symbols.join(F.broadcast(wanted), "name", "left_semi").groupBy("name").agg(F.count("*").alias("taken"))


@query(f"WITH {SYMBOLS} SELECT l.path, count(*) AS uses FROM lines l WHERE regexp_matches(l.txt, '(^|[^A-Za-z0-9_]){USED}([^A-Za-z0-9_]|$)') AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.path = l.path AND s.line = l.line AND s.name = '{USED}') GROUP BY l.path")
def safe_delete_refs(spark, sf_dir):
    return graph.references(co.documents(spark, sf_dir), USED).groupBy("path").agg(F.count("*").alias("uses"))


# Freshness.


def _edited(spark, sf_dir):
    f = co.documents(spark, sf_dir).files
    d = F.regexp_extract("path", "([0-9]+)\\.txt$", 1).cast("long")
    return f, f.filter(d % 10 != 7).withColumn("text", F.when(d % 10 == 5, F.concat("text", F.lit(" freshly_added"))).otherwise(F.col("text")))


@query(f"WITH {NUMBERED}, e AS (SELECT path, CASE WHEN d % 10 = 5 THEN text || ' freshly_added' ELSE text END AS text FROM v WHERE d % 10 <> 7) SELECT DISTINCT path, substr(sha256(text), 1, 16) AS content_hash, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{{2,}}')) AS token FROM e")
def incremental_tokens(spark, sf_dir):
    old, new = (rf.hashed(f) for f in _edited(spark, sf_dir))
    tokens = old.select("path", "content_hash", F.explode(tx.identifiers(F.col("text"))).alias("token"))
    return rf.refresh_tokens(new, tokens, old)


@query(f"""WITH {NUMBERED}, e AS (SELECT path, CASE WHEN d % 10 = 5 THEN text || ' freshly_added' ELSE text END AS text FROM v WHERE d % 10 <> 7),
a AS (SELECT path, string_split(text, chr(10)) AS a FROM e), l AS (SELECT path, unnest(range(1, n + 1)) AS line, unnest(a[1:n]) AS txt FROM (SELECT *, len(a) - CASE WHEN len(a) > 1 AND a[len(a)] = '' THEN 1 ELSE 0 END AS n FROM a)),
s AS (SELECT path, line, regexp_extract(txt, '[A-Za-z_][A-Za-z0-9_]{{2,}}') || ' ' || txt AS x FROM l WHERE regexp_matches(txt, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))
SELECT subword, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(x, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 2))) AS subword FROM s) GROUP BY subword""")
def incremental_subwords(spark, sf_dir):
    old, new = (rf.hashed(f) for f in _edited(spark, sf_dir))
    before = co.documents(spark, sf_dir).subwords.join(old.select("path", "content_hash"), "path").select("path", "content_hash", "id", "subword")
    return rf.refresh_subwords(new, before, old).groupBy("subword").agg(F.count("*").alias("df"))


@query("""WITH c AS (SELECT 'u' || user_id AS path, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT path, event_type AS text FROM c WHERE r = 1 AND event_type <> 'error'""")
def stream_upsert_latest(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    changes = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("text"), op.alias("op"), F.col("ts"), F.col("event_id").alias("seq"))
    empty = changes.select("path", "text").filter("false")
    return rf.merge(empty, changes)


@query("SELECT 'u' || user_id AS path, event_type AS content_hash, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def change_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("content_hash")).agg(F.count("*").alias("n"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
