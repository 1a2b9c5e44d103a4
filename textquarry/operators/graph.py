"""References, callers, callees, reachability, ranks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths
from ..functions import text as tx
from ..sources.corpus import Corpus, explode_lines
from ..sources.store import checkpoint
from .code import CODE, call_identifiers, stripped_lines

DAMPING, ITERATIONS = 0.85, 30
MAX_DEPTH = 5


def symbol_identifiers(corpus: Corpus, min_len: int = 3) -> DataFrame:
    """path, ord, name, start, end, ident: distinct code identifiers in the body of each symbol."""
    return corpus.uses.filter(F.length("ident") >= min_len)


def symbol_calls(corpus: Corpus, min_len: int = 3) -> DataFrame:
    """path, ord, name, start, end, ident: as symbol_identifiers(), in call position only."""
    rows = corpus.symbols
    if "lang" not in rows.columns:
        rows = rows.join(corpus.files.select("path", "lang"), "path")
    found = F.array_distinct(call_identifiers(F.col("body"), F.col("lang")))
    return rows.select("path", "ord", "name", "start", "end", F.explode(found).alias("ident")).filter(F.length("ident") >= min_len)


def definitions(corpus: Corpus, name: str) -> DataFrame:
    return corpus.located.filter(F.col("name") == name).select("path", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "id")


def references(corpus: Corpus, name: str, cap: int | None = None) -> DataFrame:
    """path, line, text: lines with the name as a whole word of code, but for those that define it."""
    from .search import prune

    word = rf"(^|[^A-Za-z0-9_]){tx.escape(name)}([^A-Za-z0-9_]|$)"
    files = prune(corpus.files, [name], fold=False)
    files = files.filter(F.col("text").rlike(word))
    is_code = F.col("lang").isin(*CODE)
    hits = explode_lines(files.filter(~F.coalesce(is_code, F.lit(False)))).filter(F.col("text").rlike(word))
    # of code, lines that hold the name outside comments and strings
    coded = files.filter(is_code).select("path", "text", stripped_lines(F.col("text"), F.col("lang")).alias("code")).filter(F.col("code").rlike(word))
    both = coded.select("path", F.posexplode(F.arrays_zip(tx.lines(F.col("text")).alias("text"), tx.lines(F.col("code")).alias("code"))).alias("line", "x"))
    both = both.filter(F.col("x.code").rlike(word)).select("path", (F.col("line") + 1).alias("line"), F.col("x.text").alias("text"))
    hits = hits.unionByName(both)
    own = corpus.symbols.filter(F.col("name") == name).select("path", F.col("start").alias("line"))
    hits = hits.join(own, ["path", "line"], "left_anti").select("path", F.col("line").cast("long").alias("line"), "text")
    return hits.orderBy("path", "line").limit(cap) if cap else hits


def tiered_references(corpus: Corpus, name: str, exact: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """path, line, text, tier: references with where they come from.

    exact: path, line of references that a language server or compiler has told (tier
    lsp); covered: path of the files that it knows, for which it is believed.  In all
    other files the words are looked for (tier lexical)."""
    found = references(corpus, name).withColumn("tier", F.lit("lexical"))
    if exact is None:
        return found
    if covered is not None:
        found = found.join(covered.select("path"), "path", "left_anti")
    told = exact.select("path", F.col("line").cast("long").alias("line")).distinct()
    shown = corpus.files.select("path", tx.lines(F.col("text")).alias("lines")).join(told, "path")
    shown = shown.filter(F.col("line").between(1, F.size("lines")))
    shown = shown.select("path", "line", F.element_at("lines", F.col("line").cast("int")).alias("text"), F.lit("lsp").alias("tier"))
    return shown.unionByName(found.join(told, ["path", "line"], "left_anti"))


def callers(corpus: Corpus, name: str) -> DataFrame:
    """Symbols whose body names the given one, but for itself."""
    found = symbol_identifiers(corpus).filter((F.col("ident") == name) & (F.col("name") != name))
    return found.select("path", F.col("name").alias("caller"), F.col("start").cast("long").alias("start")).distinct()


def callees(corpus: Corpus, name: str) -> DataFrame:
    """Definitions of what the given symbol names in call position."""
    idents = symbol_calls(corpus).filter(F.col("name") == name).select("ident").distinct()
    d = corpus.symbols.filter(F.col("name") != name).select("path", "name", F.col("start").cast("long").alias("start"))
    return d.join(idents, F.col("name") == F.col("ident"), "left_semi").withColumnRenamed("name", "callee").distinct()


def context(corpus: Corpus, name: str, most: int = 40) -> DataFrame:
    """role (definition, callee, caller, test), path, name, start of what belongs to a symbol."""
    base = definitions(corpus, name).select(F.lit("definition").alias("role"), "path", F.lit(name).alias("name"), "start")
    down = callees(corpus, name).select(F.lit("callee").alias("role"), "path", F.col("callee").alias("name"), "start")
    up = callers(corpus, name).orderBy("path", "start").limit(most)
    is_test = F.lower("caller").startswith("test") | F.lower(F.element_at(F.split("path", "/"), -1)).rlike("(^|_)tests?[._]")
    up = up.select(F.when(is_test, "test").otherwise("caller").alias("role"), "path", F.col("caller").alias("name"), "start")
    return base.unionByName(down).unionByName(up)


def reach(pairs: DataFrame, start: str, depth: int = MAX_DEPTH) -> DataFrame:
    """path, name, start, depth of symbols reached from a name over pairs
    (name -> path, to, start), each at its smallest depth."""
    seen = frontier = None
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        step = pairs.filter(F.col("name") == start) if frontier is None else pairs.join(frontier, "name", "left_semi")
        found = step.select("path", F.col("to").alias("name"), "start").distinct()
        if seen is not None:
            found = found.join(seen, ["path", "name", "start"], "left_anti")
        found = checkpoint(found.withColumn("depth", F.lit(d).cast("long")))
        if found.isEmpty():
            break
        names = found.select("name").distinct()
        if seen is not None:
            names = names.join(seen.select("name").distinct(), "name", "left_anti")
        seen = found if seen is None else seen.unionByName(found)
        frontier = names.filter(F.col("name") != start)
    return seen if seen is not None else pairs.select("path", F.col("to").alias("name"), "start", F.lit(1).cast("long").alias("depth")).filter("false")


def impact(corpus: Corpus, name: str, depth: int = MAX_DEPTH, min_len: int = 3) -> DataFrame:
    """Symbols that use the given one, directly or through others; none for a name that nothing defines."""
    uses = symbol_identifiers(corpus, min_len).filter("ident <> name")
    pairs = uses.select(F.col("ident").alias("name"), "path", F.col("name").alias("to"), F.col("start").cast("long").alias("start"))
    pairs = pairs if corpus.kept else checkpoint(pairs)  # else every step would parse the files again
    # what is reached has a definition; the name asked for may have none
    defined = not corpus.symbols.filter(F.col("name") == name).isEmpty()
    return reach(pairs if defined else pairs.filter("false"), name, depth)


def callgraph(corpus: Corpus, name: str, depth: int = MAX_DEPTH, calls_only: bool = True, min_len: int = 3) -> DataFrame:
    """path, name, start, depth of definitions that the given symbol calls (or, not
    calls_only, names), directly or through others."""
    found = symbol_calls(corpus, min_len) if calls_only else symbol_identifiers(corpus, min_len)
    defined = corpus.symbols.select(F.col("name").alias("ident")).distinct()
    # names lead to names; the definitions join in once
    named = checkpoint(found.filter("ident <> name").select("name", "ident").distinct().join(defined, "ident", "left_semi"))
    seen, frontier = None, None
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        step = named.filter(F.col("name") == name) if frontier is None else named.join(frontier, "name", "left_semi")
        new = step.select(F.col("ident").alias("name")).distinct()
        new = new if seen is None else new.join(seen, "name", "left_anti")
        new = checkpoint(new.withColumn("depth", F.lit(d).cast("long")))
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.select("name").filter(F.col("name") != name)
    d = corpus.symbols.select("path", "name", F.col("start").cast("long").alias("start")).distinct()
    if seen is None:
        return d.withColumn("depth", F.lit(1).cast("long")).filter("false")
    return d.join(seen, "name").select("path", "name", "start", "depth")


def reach_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("all"))


def naming(corpus: Corpus, min_name_len: int = 3) -> tuple[DataFrame, DataFrame]:
    """(src, name): names of other files' symbols that a file holds; (dst, name): names of the symbols of a file."""
    names = corpus.symbols.select(F.col("path").alias("dst"), "name").filter(F.length("name") >= min_name_len).distinct()
    known = names.select("name").distinct()
    idents = corpus.files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(tx.IDENT), F.lit(0)))).alias("name"))
    return idents.filter(F.length("name") >= min_name_len).join(known, "name", "left_semi"), names


def reference_edges(corpus: Corpus, min_name_len: int = 3) -> DataFrame:
    """src, dst: a file names a symbol that another file defines.

    As many rows as there are such pairs of files, with the square of the files for a
    word that all of them hold."""
    idents, names = naming(corpus, min_name_len)
    return idents.join(names, "name").filter("src <> dst").select("src", "dst").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """path, rank.  The mass of nodes without outgoing edges is spread over all."""
    spark = nodes.sparkSession
    nodes = nodes.select("path").distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 50_000)))
    state = nodes.join(out.withColumnRenamed("src", "path"), "path", "left").withColumn("rank", F.lit(1.0 / n))
    # a graph of one partition needs no exchange at all
    state = checkpoint(state.coalesce(1) if parts == 1 else state.repartition(parts, "path"))
    edges = checkpoint(edges.coalesce(1) if parts == 1 else edges.repartition(parts, "src"))
    for i in range(iterations):
        # the mass of dangling nodes: a one-row aggregate inside the plan
        dangling = state.agg((F.sum(F.when(F.col("deg").isNull(), F.col("rank")).otherwise(0.0)) / n).alias("lost"))
        share = state.filter("deg is not null").select(F.col("path").alias("src"), (F.col("rank") / F.col("deg")).alias("share"))
        got = edges.join(share, "src").groupBy("dst").agg(F.sum("share").alias("got")).withColumnRenamed("dst", "path")
        state = state.select("path", "deg").join(got, "path", "left").join(F.broadcast(dangling))
        state = state.select("path", "deg", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost"))).alias("rank"))
        if i % 5 == 4:
            state = checkpoint(state)
    return state.select("path", "rank")


def repo_map(corpus: Corpus, ranks: DataFrame, budget: int, per_file: int = 6) -> DataFrame:
    """path, rank, names: files by rank (generated ones count a fifth) with their first
    symbols, as long as the budget lasts."""
    weight = F.when(paths.is_generated(F.col("path")), F.col("rank") * 0.2).otherwise(F.col("rank"))
    # every file costs a token at least, so no more files than that can be shown
    ranks = ranks.join(corpus.passed.select("path").distinct(), "path", "left_semi").withColumn("rank", weight)
    ranks = checkpoint(ranks.orderBy(F.desc("rank"), "path").limit(budget))
    first = W.partitionBy("path", "name").orderBy("ord")
    names = corpus.passed.join(F.broadcast(ranks.select("path")), "path", "left_semi").withColumn("r", F.row_number().over(first)).filter("r = 1")
    names = names.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy("ord"))).filter(F.col("r") <= per_file)
    listed = names.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "signature"))).alias("x"))
    listed = listed.select("path", F.array_join(F.transform("x", lambda s: s["signature"]), "\n").alias("names"))
    rows = listed.join(ranks, "path")
    cost = F.sum(tx.est_tokens(F.concat("path", F.lit("\n"), "names"))).over(W.orderBy(F.desc("rank"), "path").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", cost).filter(F.col("used") <= budget).select("path", "rank", "names", F.col("used").cast("long").alias("used"))


def imports(corpus: Corpus, wanted: DataFrame) -> DataFrame:
    """name, target, definition, statement: how target files bring in symbols (wanted: name, target),
    one statement per file that defines one."""
    defined = corpus.symbols.select("name", F.col("path").alias("definition")).distinct()
    both = defined.join(wanted, "name").filter("definition <> target")
    return both.select("name", "target", "definition", paths.import_statement(F.col("name"), F.col("target"), F.col("definition")).alias("statement"))


def package_roots(files: DataFrame, tree: DataFrame) -> DataFrame:
    """path, root: the nearest directory above each file that holds a package manifest in the tree; null without."""
    parts = F.split("path", "/")
    folder = lambda p, n: F.array_join(F.slice(p, 1, n), "/")
    marked = tree.filter(F.element_at(parts, -1).isin(*paths.MANIFESTS)).select(folder(parts, F.size(parts) - 1).alias("root")).distinct()
    own = files.select("path").distinct()
    above = own.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: folder(parts, i))).alias("root"))
    nearest = above.join(marked, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return own.join(nearest, "path", "left")


def blast_radius(corpus: Corpus, names: list[str]) -> DataFrame:
    """name, n, files: how many lines in how many files refer to each of some symbols; those that none does are left out."""
    out = corpus.files.select(F.lit("").alias("name"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("files")).filter("false")
    for name in names:
        out = out.unionByName(references(corpus, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct("path").alias("files")))
    return out.filter("n > 0")
