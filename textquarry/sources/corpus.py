"""A corpus: files, and the lines, symbols and tokens derived from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths
from ..functions import text as tx
from ..functions.locators import format_locator, short_hash
from .store import fingerprint, keep


def content_hash(text) -> F.Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


class Corpus:
    """files(path, text, lang); symbols(path, ord, kind, name, signature, start, end, body, and lang if at hand).

    Derived tables are plans over these two; nothing is read before a query runs.
    kept: gives a derived table by its name and maker, from what was written before; without it
    all tables are worked out for each query.  named: the symbols as a plan, where they would be written first."""

    def __init__(self, files: DataFrame, symbols: DataFrame | Callable[[], DataFrame], kept: Callable[[str, Callable[[], DataFrame], str], DataFrame] | None = None, named: DataFrame | None = None):
        self.files, self._symbols, self.kept, self._named = files, symbols, kept, named

    @cached_property
    def symbols(self) -> DataFrame:
        return self._symbols() if callable(self._symbols) else self._symbols

    @property
    def passed(self) -> DataFrame:
        """The symbols for one pass over them: not written first, and without locators."""
        return self.symbols if self._named is None else self._named

    @property
    def names(self) -> DataFrame:
        """path, name of the symbols."""
        return self.passed.select("path", "name")

    @cached_property
    def lines(self) -> DataFrame:
        """path, line (from 1), text."""
        return explode_lines(self.files)

    @cached_property
    def tokens(self) -> DataFrame:
        """path, token: distinct identifiers in lower case."""
        make = lambda: token_rows(self.files)
        return self.kept("tokens", make, "token") if self.kept else make()

    @cached_property
    def subwords(self) -> DataFrame:
        """id, subword: distinct subwords of a symbol's name and signature."""
        make = lambda: self.located.select("path", "id", F.explode(symbol_subwords()).alias("subword"))
        return self.kept("subwords", make, "subword") if self.kept else make()

    @cached_property
    def uses(self) -> DataFrame:
        """path, ord, name, start, end, ident: distinct identifiers in the code of each symbol."""
        from ..operators.code import code_identifiers

        def make() -> DataFrame:
            rows = self.symbols if "lang" in self.symbols.columns else self.symbols.join(self.files.select("path", "lang"), "path")
            return rows.select("path", "ord", "name", "start", "end", F.explode(F.array_distinct(code_identifiers(F.col("body"), F.col("lang")))).alias("ident"))

        return self.kept("uses", make, "ident") if self.kept else make()

    @cached_property
    def located(self) -> DataFrame:
        """symbols with their locator id."""
        return self.symbols if "id" in self.symbols.columns else with_locators(self.symbols)

    def scoped(self, scope: list[str] = (), lang: str | None = None) -> Corpus:
        """The part of the corpus in a path scope and of some languages.

        An unknown language covers no file."""
        if not scope and not lang:
            return self
        files = self.files
        tests = []
        if scope:
            files = files.filter(paths.in_scope(F.col("path"), list(scope)))
            tests.append(paths.in_scope(F.col("path"), list(scope)))
        if lang:
            files = files.filter(paths.lang_filter(F.col("path"), lang, F.col("text")))
            tests.append(paths.lang_filter(F.col("path"), lang) if paths.lang_suffixes(lang) else F.lit(False))
        inside = lambda df: reduce(lambda d, t: d.filter(t), tests, df)
        whole = self.kept
        return Corpus(files, lambda: inside(self.symbols), (lambda name, _, order: inside(getattr(self, name))) if whole else None)


def with_locators(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("id", format_locator(F.col("path"), F.col("name"), F.col("start"), F.col("end"), short_hash(F.col("body"))))


def symbol_subwords() -> F.Column:
    return F.array_distinct(tx.subwords(F.concat_ws(" ", "name", "signature")))


def explode_lines(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(tx.lines(F.col("text"))).alias("line", "text"))
    return rows.select("path", (F.col("line") + 1).alias("line"), "text")


def token_rows(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(tx.identifiers(F.col("text"))).alias("token"))


def prose_symbols(files: DataFrame) -> DataFrame:
    """The prose pack: every line that holds an identifier is a symbol named after the first one.

    Lines are numbered and chosen inside the row, so nothing is shuffled."""
    told = F.transform(tx.lines(F.col("text")), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), F.regexp_extract(t, tx.IDENT, 0).alias("name")))
    rows = files.select("path", "lang", F.posexplode(F.filter(told, lambda x: x["name"] != "")).alias("ord", "x"))
    return rows.select(
        "path", "ord", F.lit("para").alias("kind"), F.col("x.name").alias("name"), F.col("x.text").alias("signature"),
        F.col("x.line").alias("start"), F.col("x.line").alias("end"), F.col("x.text").alias("body"), "lang",
    )


def from_table(df: DataFrame, path: F.Column, text: F.Column, lang: F.Column | None = None) -> Corpus:
    """A corpus of a table's texts, with the prose pack."""
    files = df.select(path.alias("path"), F.coalesce(text, F.lit("")).alias("text"), (lang if lang is not None else paths.language(path, text)).alias("lang"))
    return Corpus(files, prose_symbols(files))


def documents(spark: SparkSession, sf_dir: str) -> Corpus:
    """The documents as files.  Symbols, tokens, subwords and uses are written once per
    state of the table and application, each sorted by what it is looked up by."""
    table = f"{sf_dir}/documents.parquet"
    df = spark.read.parquet(table)
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = df.select(path.alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"), "lang")
    key = fingerprint(spark, table)
    kept = lambda name, make, order: keep(spark, key, name, make, order)

    def symbols() -> DataFrame:
        # a line's body is its signature and is not written twice
        rows = kept("symbols", lambda: with_locators(prose_symbols(files)).drop("body"), "name")
        return rows.withColumn("body", F.col("signature"))

    return Corpus(files, symbols, kept, prose_symbols(files))


def conversations(spark: SparkSession, sf_dir: str) -> Corpus:
    """A file per conversation; a symbol per turn, and one for the whole conversation that holds them."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".md"))
    turns = df.select(path.alias("path"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("n", F.size(F.split("text", "\n", -1)))
    order = W.partitionBy("path").orderBy("turn")
    ends = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))
    turns = turns.withColumns({"ord": F.row_number().over(order), "end": ends.cast("int")}).withColumn("start", (F.col("end") - F.col("n") + 1).cast("int"))
    symbols = turns.select(
        "path", "ord", F.col("role").alias("kind"), F.concat("role", F.lit("_"), F.col("turn").cast("string")).alias("name"),
        F.substring_index("text", "\n", 1).alias("signature"), "start", "end", F.col("text").alias("body"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    files = turns.groupBy("path").agg(whole.alias("text"), F.max("end").alias("end"))
    outer = files.select(
        "path", F.lit(0).alias("ord"), F.lit("conversation").alias("kind"), F.lit("conversation").alias("name"),
        F.substring_index("text", "\n", 1).alias("signature"), F.lit(1).alias("start"), "end", F.col("text").alias("body"),
    )
    return Corpus(files.select("path", "text", F.lit("markdown").alias("lang")), symbols.unionByName(outer))


def pages(spark: SparkSession, sf_dir: str) -> Corpus:
    """A file per page, named by its address; the first heading is its symbol."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("."), F.col("page_id").cast("string"), F.lit(".html"))
    files = df.select(path.alias("path"), F.coalesce("html", F.lit("")).alias("text"), F.lit("html").alias("lang"))
    head = F.regexp_extract("text", "<h1>([^<]*)</h1>", 1)
    at = F.size(F.split(F.substring_index("text", "<h1>", 1), "\n", -1))
    symbols = files.select("path", F.lit(0).alias("ord"), F.lit("h1").alias("kind"), F.regexp_extract(head, tx.IDENT, 0).alias("name"), head.alias("signature"), at.alias("start"), at.alias("end"), head.alias("body"))
    return Corpus(files, symbols.filter("name <> ''"))


def file_metrics(corpus: Corpus) -> DataFrame:
    """path, lines, bytes, symbols."""
    sizes = corpus.files.select("path", F.size(tx.lines(F.col("text"))).cast("long").alias("lines"), F.octet_length("text").cast("long").alias("bytes"))
    n = corpus.symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    return sizes.join(n, "path", "left").select("path", "lines", "bytes", F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"))


#: Line starts that are gathered in one piece: growing an array copies it.
GATHERED = 256


def line_starts(corpus: Corpus) -> DataFrame:
    """path, line, start: the byte at which each line begins."""
    # running sum inside the row, in pieces: no shuffle, and the work grows with the lines
    sizes = F.transform(tx.lines(F.col("text")), lambda x: F.octet_length(x).cast("long") + 1)
    zero = F.struct(F.array().cast("array<array<bigint>>").alias("done"), F.array(F.lit(0).cast("long")).alias("piece"))

    def add(acc: F.Column, n: F.Column) -> F.Column:
        new = F.array(F.element_at(acc["piece"], -1) + n)
        full = F.size(acc["piece"]) >= GATHERED
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["piece"]))).otherwise(acc["done"]).alias("done"), F.when(full, new).otherwise(F.concat(acc["piece"], new)).alias("piece"))

    # the last is the end of the text
    ended = lambda a: F.slice(a, 1, F.size(a) - 1)
    starts = F.aggregate(sizes, zero, add, lambda acc: ended(F.flatten(F.concat(acc["done"], F.array(acc["piece"])))))
    rows = corpus.files.select("path", F.posexplode(starts).alias("line", "start"))
    return rows.select("path", (F.col("line") + 1).cast("long").alias("line"), "start")


def subword_frequency(corpus: Corpus) -> DataFrame:
    """subword, df: how many symbols have it in their name or signature."""
    return corpus.subwords.groupBy("subword").agg(F.count("*").alias("df"))


def repo_outline(corpus: Corpus) -> DataFrame:
    """path, outline: the signatures of a file with their lines, in order."""
    line = F.concat("signature", F.lit(" @L"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    per = corpus.symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))
    return per.select("path", F.transform("x", lambda s: s["line"]).alias("outline"))
