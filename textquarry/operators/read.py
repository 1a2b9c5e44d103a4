"""Reading: ranges, windows, outlines, trees, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.locators import parse_line_range
from ..sources.corpus import Corpus

#: Lines of a symbol that is shown whole; lines on both sides of a hit in longer ones; lines shown at most.
WHOLE, AROUND, MOST = 40, 14, 200


def read_range(corpus: Corpus, path: str, spec: str) -> DataFrame:
    """path, line, text of a line range (a-b, a, a-, -n, ~n) of one file."""
    one = corpus.files.filter(F.col("path") == path).select("path", tx.lines(F.col("text")).alias("lines"))
    n = one.select(F.size("lines").alias("n")).first()
    a, b = parse_line_range(spec, n["n"] if n else 0)
    rows = one.select("path", F.posexplode(F.slice("lines", a, b - a + 1)).alias("i", "text"))
    return rows.select("path", (F.col("i") + a).cast("long").alias("line"), "text")


def ends(corpus: Corpus, n: int, tail: bool = False) -> DataFrame:
    """path, line, text of the first (or last) n lines of every file."""
    lines_ = corpus.files.select("path", tx.lines(F.col("text")).alias("lines")).withColumn("size", F.size("lines"))
    first = F.greatest(F.col("size") - n + 1, F.lit(1)) if tail else F.lit(1)
    rows = lines_.select("path", first.alias("first"), F.posexplode(F.slice("lines", first, F.lit(n))).alias("i", "text"))
    return rows.select("path", (F.col("first") + F.col("i")).cast("long").alias("line"), "text")


def number(lines_: Column, first: Column) -> Column:
    """Lines with their absolute numbers, as one text."""
    return F.array_join(F.transform(lines_, lambda x, i: F.concat((i + first).cast("string"), F.lit("\t"), x)), "\n")


def snippets(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """id, path, first, last, snippet of hits (id, path, start, end, line): the whole
    symbol if it is short, else the lines around the hit, inside the symbol."""
    long_ = F.col("end") - F.col("start") >= WHOLE
    first = F.when(long_, F.greatest("start", F.col("line") - AROUND)).otherwise(F.col("start"))
    last = F.when(long_, F.least("end", F.col("line") + AROUND)).otherwise(F.least(F.col("end"), F.col("start") + MOST - 1))
    both = hits.withColumns({"first": first.cast("int"), "last": last.cast("int")}).join(corpus.files.select("path", "text"), "path")
    body = F.slice(tx.lines(F.col("text")), F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0)))
    return both.select("id", "path", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), number(body, F.col("first")).alias("snippet"))


def locate(corpus: Corpus) -> DataFrame:
    """id, text: one line per symbol."""
    return corpus.located.select("id", F.format_string("L%d-%d %s", "start", "end", F.substring_index("body", "\n", 1)).alias("text"))


def container_outline(corpus: Corpus) -> DataFrame:
    """path, name, start, members: symbols that hold others, with the signatures of those directly or deeper inside."""
    a = corpus.symbols.select("path", "name", "start", "end")
    b = corpus.symbols.select("path", F.col("start").alias("s"), F.col("end").alias("e"), F.col("ord").alias("o"), "signature")
    inside = a.join(b, "path").filter("s >= start and e <= end and not (s = start and e = end)")
    member = F.concat("signature", F.lit(" @L"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"))
    listed = inside.groupBy("path", "name", "start", "end").agg(F.array_sort(F.collect_list(F.struct("s", "o", member.alias("m")))).alias("x"))
    return listed.select("path", "name", F.col("start").cast("long").alias("start"), F.array_join(F.transform("x", lambda r: r["m"]), "\n").alias("members"))


def tree(files: DataFrame, cap: int | None = 400) -> DataFrame:
    """path, entry, depth, new_dirs: files in order, with how many directories each is the first of."""
    dirs = F.split("path", "/")
    rows = files.select("path").orderBy("path")
    rows = rows.limit(cap) if cap else rows
    rows = rows.withColumn("prev", F.lag("path").over(W.orderBy("path")))
    depth = F.size(dirs) - 1
    before = F.split(F.coalesce("prev", F.lit("")), "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: (i <= depth) & (F.slice(dirs, 1, i) == F.slice(before, 1, i)) & (F.size(before) > i)))
    return rows.select("path", F.element_at(dirs, -1).alias("entry"), depth.cast("long").alias("depth"), (depth - shared).cast("long").alias("new_dirs"))


def within_budget(files: DataFrame, budget: int) -> DataFrame:
    """Files in order as long as their text fits (budget - 64) * 4 characters; reading ends at the first that does not."""
    used = F.sum(F.length("text")).over(W.orderBy("path").rowsBetween(W.unboundedPreceding, 0))
    return files.withColumn("used", used).filter(F.col("used") <= (budget - 64) * 4)


def whole(files: DataFrame, budget: int) -> DataFrame:
    """path, text of files, as many whole lines of each as fit (budget - 64) * 4 characters, and how many are left out."""
    most = max(1, (budget - 64) * 4)
    part = F.substring("text", 1, most)
    lines_ = F.when(F.contains(part, F.lit("\n")), F.regexp_replace(part, r"\n[^\n]*\z", "")).otherwise(part)
    left = F.size(tx.lines(F.col("text"))) - F.size(F.split(lines_, "\n", -1))
    cut = F.concat(lines_, F.lit("\n… +"), left.cast("string"), F.lit(" more lines"))
    return files.select("path", F.when(F.length("text") > most, cut).otherwise(F.col("text")).alias("text"))


# Diagnostics of compilers, linters and stack traces.
PYTHON_AT = r'File "([^"]+)"[^\n]*?line ([0-9]+)'
COLON_AT = r"""([^\s()\[\]{}'"`<>:]*[./\\][^\s()\[\]{}'"`<>:]*):([0-9]+)(?::[0-9]+)?(?=[\s()\[\]{}'"`<>,:]|$)"""
PAREN_AT = r"([^\s(]*[./\\][^\s(]*)\(([0-9]+)(?:,[0-9]+)?\)"


def diagnostics(blob: DataFrame) -> DataFrame:
    """path, line, severity, message, ord (from 0) of the places that tool output (n, text: its lines in order) names.

    A line with an arrow takes severity and message of the last line that had them; of
    several mentions of one place the first stays."""
    low = F.lower("text")
    at = {w: F.locate(w, low) for w in ("error", "warning", "warn", "note")}
    severity = F.when(at["error"] > 0, "error").when((at["warning"] > 0) | (at["warn"] > 0), "warning").when(at["note"] > 0, "note")
    start = F.when(at["error"] > 0, at["error"]).when(at["warning"] > 0, at["warning"]).when(at["warn"] > 0, at["warn"]).otherwise(at["note"])
    rest = F.substr("text", F.greatest(start, F.lit(1)))
    message = F.nullif(F.trim(F.when(severity.isNotNull() & (F.locate(": ", rest) > 0), F.substr(rest, F.locate(": ", rest) + 2))), F.lit(""))
    rows = blob.withColumns({"own": severity, "said": message})
    order = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)  # one tool's output
    carried = F.last(F.when(F.col("own").isNotNull(), F.struct("own", "said")), True).over(order)
    rows = rows.withColumn("last", carried).withColumn("arrow", F.contains("text", F.lit("-->")) & F.col("own").isNull())
    rows = rows.withColumns({"severity": F.when(F.col("arrow"), F.col("last.own")).otherwise(F.col("own")), "message": F.when(F.col("arrow"), F.col("last.said")).otherwise(F.col("said"))})
    found = None
    for k, pattern in enumerate((PYTHON_AT, COLON_AT, PAREN_AT)):
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("l"))
        part = rows.select("n", F.lit(k).alias("form"), "severity", "message", F.posexplode(pairs).alias("i", "x"))
        part = part.select("n", "form", "i", F.trim(F.col("x.p")).alias("path"), F.col("x.l").cast("long").alias("line"), "severity", "message")
        found = part if found is None else found.unionByName(part)
    first = W.partitionBy("path", "line").orderBy("n", "form", "i")
    found = found.filter("line > 0").withColumn("r", F.row_number().over(first)).filter("r = 1")
    place = (F.row_number().over(W.orderBy("n", "form", "i")) - 1).cast("long")  # one tool's output
    return found.select("path", "line", "severity", "message", place.alias("ord"))


def diagnose(blob: DataFrame, corpus: Corpus, window: int = 2) -> DataFrame:
    """Diagnostics with the file each belongs to, the innermost symbol there, the lines around, and
    a score that falls from 1 with their order."""
    from .search import enclosing

    found = diagnostics(blob)
    found = found.withColumn("score", 1 - F.col("ord") / (F.count("*").over(W.partitionBy()) + 1))
    files = corpus.files.select("path", "text")
    d = found.select(F.col("path").alias("said"), "line", "severity", "message", "score")
    base = F.element_at(F.split("said", "/"), -1)
    near = d.withColumn("base", base).join(files.withColumn("base", F.element_at(F.split("path", "/"), -1)), "base")
    near = near.filter((F.col("path") == F.col("said")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("said"))) | F.col("said").endswith(F.concat(F.lit("/"), F.col("path"))))
    lines_ = tx.lines(F.col("text"))
    first = F.greatest(F.col("line") - window, F.lit(1))
    near = near.withColumn("around", number(F.slice(lines_, first.cast("int"), F.lit(2 * window + 1)), first))
    at = near.select("path", F.col("line").cast("int").alias("line"), F.element_at(F.concat(lines_, F.array_repeat(F.lit(""), 1)), F.least(F.col("line").cast("int"), F.size(lines_) + 1)).alias("text")).distinct()
    named = enclosing(at, corpus).select("path", F.col("line").cast("long").alias("line"), "name", "id")
    return near.join(named, ["path", "line"], "left").select("path", "line", "severity", "message", "name", "id", "around", "score")


def diagnostics_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (introduced, fixed), path, line, message between two runs of a tool."""
    key = ["path", "line", "message"]
    new = after.select(*key).exceptAll(before.select(*key)).withColumn("change", F.lit("introduced"))
    gone = before.select(*key).exceptAll(after.select(*key)).withColumn("change", F.lit("fixed"))
    return new.unionByName(gone).select("change", *key)
