"""Search: lines, symbols, subwords, mentions; counting; fusion of rankings."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.locators import format_locator, short_hash
from ..sources.corpus import Corpus, explode_lines
from ..sources.store import checkpoint

RRF_K = 60


def prune(files: DataFrame, literals: list[str], fold: bool = True) -> DataFrame:
    """Files that hold every literal, so that only their lines are looked at."""
    for w in literals:
        files = files.filter(tx.contains_literal(F.col("text"), w, fold))
    return files


def line_hits(corpus: Corpus, predicate, *, literals: list[str] = (), per_file: int | None = None) -> DataFrame:
    """path, line, text of lines that satisfy a predicate; of each file the first per_file."""
    files = prune(corpus.files, list(literals))
    if per_file is None:
        return explode_lines(files).filter(predicate(F.col("text")))
    # numbered, chosen and cut off inside the row
    told = F.transform(tx.lines(F.col("text")), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    rows = files.select("path", F.explode(F.slice(F.filter(told, lambda x: predicate(x["text"])), 1, per_file)).alias("x"))
    return rows.select("path", "x.line", "x.text")


def regex_hits(corpus: Corpus, q: str, per_file: int | None = None) -> DataFrame:
    pattern = tx.line_pattern(q)
    return line_hits(corpus, lambda t: t.rlike(pattern), literals=tx.required_literals(q), per_file=per_file)


def boolean_hits(corpus: Corpus, all_of=(), any_of=(), none_of=(), base: str = "", per_file: int | None = None) -> DataFrame:
    words = [w.lower() for w in all_of]
    return line_hits(corpus, lambda t: tx.boolean_predicate(t, list(all_of), list(any_of), list(none_of), base), literals=words, per_file=per_file)


def enclosing(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """hits with the innermost symbol around each line (the earlier of equals), or the line itself."""
    s = corpus.located.select(F.col("path").alias("p"), "ord", "kind", "name", "start", "end", "id")
    both = hits.join(s, (F.col("path") == F.col("p")) & F.col("line").between(F.col("start"), F.col("end")), "left")
    best = F.min(F.when(F.col("p").isNotNull(), F.struct((F.col("end") - F.col("start")).alias("span"), "ord", "kind", "name", "start", "end", "id")))
    own = format_locator(F.col("path"), F.lit(None).cast("string"), F.col("line"), F.col("line"), short_hash(F.col("text")))
    out = both.groupBy("path", "line").agg(F.first("text").alias("text"), best.alias("s"))
    return out.select(
        "path", "line", "text", F.col("s.kind").alias("kind"), F.col("s.name").alias("name"),
        F.coalesce("s.start", "line").alias("start"), F.coalesce("s.end", "line").alias("end"), F.coalesce("s.id", own).alias("id"),
    )


def lexical_rank(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """id, hits, rank (from 0): symbols by the number of hit lines, then by id."""
    counts = enclosing(hits, corpus).groupBy("id").agg(F.count("*").alias("hits"))
    return ranked(counts, F.desc("hits"), "id")


#: Rows that are ranked in one task; longer lists are ranked by a distributed sort.
SMALL_LIST = 1_000_000


def ranked(df: DataFrame, *order) -> DataFrame:
    """Adds rank from 0 in the given total order."""
    df = df.persist()
    if df.count() <= SMALL_LIST:
        return df.withColumn("rank", (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
    # written out: numbers given once hold, whatever executors are lost
    placed = checkpoint(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # one per partition
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    offsets = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    return placed.withColumn("rank", within + F.element_at(offsets, part)).drop("place")


def structural(corpus: Corpus, q: str, limit: int | None = None) -> DataFrame:
    """id, path, quality (0 equal, 1 prefix, 2 part of the name), rank."""
    fold = not tx.has_upper(q, ascii_only=True)
    name = F.lower("name") if fold else F.col("name")
    quality = F.when(name == q, 0).when(name.startswith(q), 1).when(F.contains(name, F.lit(q)), 2)
    found = corpus.located.withColumn("quality", quality).filter("quality is not null").select("id", "path", "quality").distinct()
    if limit is not None:
        found = found.orderBy("quality", "path", "id").limit(limit)
    return ranked(found, "quality", "path", "id")


def semantic(whole: Corpus, scoped: Corpus, q: str, k: int) -> DataFrame:
    """id, score, rank of the k symbols whose subwords weigh most.

    A subword weighs ln(N/df) + 1 with N and df over the whole corpus; a word that
    stands twice in the query counts twice."""
    words = tx.py_subwords(q)
    if not words:
        return scoped.located.select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).filter("false")
    distinct = sorted(set(words))
    # the postings of the query's words: N, and how often each stands
    n = whole.symbols.count()
    df = {r["subword"]: r["n"] for r in whole.subwords.filter(F.col("subword").isin(distinct)).groupBy("subword").agg(F.count("*").alias("n")).collect()}
    score = F.lit(0.0)
    for w in distinct:
        if w in df:
            score = score + F.when(F.array_contains("bag", w), F.lit(words.count(w) * (math.log(n / df[w]) + 1))).otherwise(F.lit(0.0))
    found = scoped.subwords.filter(F.col("subword").isin(distinct)).groupBy("id").agg(F.collect_set("subword").alias("bag")).select("id", score.alias("score"))
    return ranked(found.orderBy(F.desc("score"), "id").limit(k), F.desc("score"), "id")


def mentions(corpus: Corpus, q: str) -> DataFrame:
    """id, path, ord, rank: symbols whose name is a word of the query."""
    words = tx.mention_words(q)
    found = corpus.located.filter(F.lower("name").isin(words)) if words else corpus.located.filter("false")
    return ranked(found.select("id", "path", "ord").dropDuplicates(["id"]), "path", "ord", "id")


def rrf(*lists: tuple[float, DataFrame]) -> DataFrame:
    """id, score: the sum over rankings (id, rank) of weight / (60 + rank + 1)."""
    parts = [df.select("id", (F.lit(float(w)) / (F.col("rank") + RRF_K + 1)).alias("part")) for w, df in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def confident(top: list, exact: bool) -> bool:
    """Whether the first result stands out from the second, or a symbol is named like the query."""
    if exact:
        return True
    return bool(top) and (len(top) < 2 or (top[0]["score"] - top[1]["score"]) / max(top[0]["score"], 1e-9) >= 0.10)


def search_auto(whole: Corpus, q: str, k: int = 8, scoped: Corpus | None = None, all_of=(), any_of=(), none_of=()) -> DataFrame:
    """id, score: structural and lexical rankings fused; where no result stands out,
    mentions and subwords join in."""
    scoped = scoped or whole
    boolean = bool(all_of or any_of or none_of)
    hits = boolean_hits(scoped, all_of, any_of, none_of, q, k) if boolean else regex_hits(scoped, q, k)
    lexical = lexical_rank(scoped, hits).persist()
    struct = structural(scoped, q.strip()).persist()
    fused = rrf((1.0, struct), (1.0, lexical)).orderBy(F.desc("score"), "id")
    exact = tx.is_plain_ident(q) and not struct.filter("quality = 0").isEmpty()
    if exact or confident(fused.limit(2).collect(), exact):
        return fused.limit(k)
    named, meant = mentions(scoped, q), semantic(whole, scoped, q, max(k, 8))
    if named.isEmpty() and meant.isEmpty():
        return fused.limit(k)
    # the weights of the second phase
    fused = rrf((0.8, struct), (0.8, lexical), (0.3, named), (0.2, meant))
    return fused.orderBy(F.desc("score"), "id").limit(k)


def exclude_seen(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select("id"), "id", "left_anti")


def count_matches(corpus: Corpus, q: str, limit: int | None = 200) -> DataFrame:
    """path, lines, matches by file, most lines first.

    A plain identifier is counted as a case-sensitive part of words, anything else as a smart-case pattern."""
    pattern = tx.escape(q) if tx.is_plain_ident(q) else tx.line_pattern(q)
    files = corpus.files.filter(F.col("text").rlike(pattern))
    counts = files.select(
        "path",
        F.size(F.filter(tx.lines(F.col("text")), lambda t: t.rlike(pattern))).cast("long").alias("lines"),
        F.regexp_count("text", F.lit(pattern)).cast("long").alias("matches"),
    ).filter("lines > 0")
    return counts.orderBy(F.desc("lines"), "path").limit(limit) if limit else counts


def count_boolean(corpus: Corpus, all_of=(), any_of=(), none_of=(), base: str = "", limit: int | None = 200) -> DataFrame:
    """path, lines: how many lines satisfy a boolean search."""
    good = F.filter(tx.lines(F.col("text")), lambda t: tx.boolean_predicate(t, list(all_of), list(any_of), list(none_of), base))
    counts = prune(corpus.files, [w.lower() for w in all_of]).select("path", F.size(good).cast("long").alias("lines")).filter("lines > 0")
    return counts.orderBy(F.desc("lines"), "path").limit(limit) if limit else counts


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def fuzzy_symbols(corpus: Corpus, q: str, limit: int = 5) -> DataFrame:
    """name, path, distance: symbols whose name is a few edits away."""
    most = min(3, max(1, len(q) // 4))
    near = corpus.symbols.filter(F.abs(F.length("name") - len(q)) <= most)
    near = near.select("name", "path", F.levenshtein(F.lower("name"), F.lit(q.lower()), most).cast("long").alias("distance")).filter("distance >= 1").distinct()
    return near.orderBy("distance", F.length("name"), "path", "name").limit(limit)


def path_suggestions(files: DataFrame, path: str, limit: int = 3) -> DataFrame:
    """path, distance: files whose own name is at most two edits from that of a path."""
    base = path.rsplit("/", 1)[-1]
    own = F.element_at(F.split("path", "/"), -1)
    near = files.select("path", F.levenshtein(own, F.lit(base), 2).cast("long").alias("distance")).filter("distance >= 0")
    return near.orderBy("distance", "path").limit(limit)


def resolve_path(files: DataFrame, path: str) -> DataFrame:
    """The file of a path: the equal one, else the only one that ends in it; no row if there are several."""
    hit = files.select("path").filter((F.col("path") == path) | F.col("path").endswith(f"/{path}"))
    hit = hit.withColumn("exact", F.col("path") == path)
    one = hit.agg(F.max("exact").alias("exact"), F.count("*").alias("n"), F.min("path").alias("path"))
    return one.filter("exact or n = 1").select(F.when(F.col("exact"), F.lit(path)).otherwise(F.col("path")).alias("path"))


class NoMatch(NamedTuple):
    """Why nothing was found: SCOPE_NO_MATCH, FUZZY with names and paths near the query, or PATTERN_NO_MATCH; what to try."""

    code: str
    near: list[tuple[str, str]]
    hints: list[str]


def no_match_hint(corpus: Corpus, scoped: Corpus, q: str) -> NoMatch:
    if scoped.files.isEmpty():
        tops = corpus.files.select(F.substring_index("path", "/", 1).alias("top")).distinct().orderBy("top").limit(8).collect()
        return NoMatch("SCOPE_NO_MATCH", [], [f"no file is in this scope; there are: {', '.join(r['top'] for r in tops)}"])
    if tx.is_plain_ident(q):
        near = [(r["name"], r["path"]) for r in fuzzy_symbols(corpus, q.strip()).collect()]
        if near:
            return NoMatch("FUZZY", near, [])
    hints = []
    if tx.has_upper(q):
        hints.append("upper case is matched as it is; lower case matches both")
    if re.search(r"[.*+?()\[\]{}|\\^$]", q):
        hints.append("the query is read as a pattern; put a backslash before characters that stand for themselves")
    if len(q.split()) > 1:
        hints.append("words have to stand side by side; all_of finds them anywhere in a line")
    if corpus is not scoped and not regex_hits(corpus, q).isEmpty():
        hints.append("there are matches outside this scope")
    return NoMatch("PATTERN_NO_MATCH", [], hints)


def attribution(spans: DataFrame) -> DataFrame:
    """q_idx, hits: how many results each query of a batch had, before duplicates go."""
    return spans.groupBy("q_idx").agg(F.count("*").alias("hits"))
