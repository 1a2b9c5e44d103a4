"""Exact deduplication by a tree merge of sorted digest runs.

Each input partition yields a run: its distinct digests in order, each with the
best identifier seen so far and a count.  Runs are cut into digest ranges, and
within a range they meet in binomial rounds: FAN neighbouring runs travel whole
(one row each) to one task, which merges them in a single ordered pass and keeps
per digest the best identifier after verifying that the lengths behind equal
digests agree.  The winners go back to the members through (run, digest), so a
digest that a third of all rows carry is never joined in one task.
"""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, SPACE, fresh, join_rows, materialize, read, with_row_key, without_rows

#: Runs that meet in one task per round: three binomial rounds in one exchange.
FAN = 8
#: Entries of a digest range; the number of ranges grows with the input.
RANGE_ROWS = 1 << 18
#: Entries of a run of one range before the first round.
RUN_ROWS = 1 << 12

#: digest, bytes of the normalised text, minus code points of the original, doc_id, row, rows.
ENTRY = struct.Struct(">32sqqqqq")


def merge_runs(runs: list[bytes]) -> bytes:
    """Merge packed sorted runs; of each digest the first entry wins and counts add up.

    Raises ValueError when equal digests come with different text lengths."""
    out = []
    merged = heapq.merge(*(ENTRY.iter_unpack(x) for x in runs))
    for digest, same in itertools.groupby(merged, key=lambda e: e[0]):
        first = next(same)
        best, total = first, first[5]
        for e in same:
            if e[1] != first[1]:
                raise ValueError(f"digest {digest.hex()} stands for texts of {first[1]} and {e[1]} bytes")
            best = min(best, e)
            total += e[5]
        out.append(ENTRY.pack(*best[:5], total))
    return b"".join(out)


def _first_run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    entries = sorted(zip(rows.digest, rows.n_norm, rows.neg_chars, rows.doc_id, rows.rid, rows.n, strict=True))
    run = merge_runs([b"".join(ENTRY.pack(*e) for e in entries)])
    return pd.DataFrame({"rng": [key[0]], "node": [key[1]], "run": [run]})


def _round(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"rng": [key[0]], "node": [key[1]], "run": [merge_runs(list(rows.run))]})


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for run in rows.run:
            e = list(ENTRY.iter_unpack(run))
            yield pd.DataFrame({"digest": [x[0] for x in e], "keep_neg": [x[2] for x in e], "keep_id": [x[3] for x in e], "keep_rid": [x[4] for x in e], "group_size": [x[5] for x in e]})


def _norm() -> Column:
    return F.translate(F.coalesce(F.col("text"), F.lit("")), SPACE, "")


def _key() -> Column:
    """Rows with one identifier and one key have equal texts of one length."""
    return F.xxhash64(_norm(), F.length("text"))


def _decide(docs: DataFrame) -> DataFrame:
    """A row per row: did (NO_ID: none), key, digest, keep_id, group_size, kept, and
    twin: not kept, though of one identifier, text and length with the one that is."""
    text, norm = F.coalesce(F.col("text"), F.lit("")), _norm()
    members = materialize(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"),
            _key().alias("key"),
            F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"),
            F.octet_length(norm).cast("long").alias("n_norm"),
            (-F.length(text)).cast("long").alias("neg_chars"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "digests",
    )
    n = members.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    nodes = max(1, -(-n // (ranges * RUN_ROWS)))
    low = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    best = F.min(F.struct("neg_chars", "did", "rid")).alias("best")
    entries = members.groupBy("part", "digest", "n_norm").agg(best, F.count("*").alias("n"))
    runs = (
        entries.select(
            (low % ranges).cast("int").alias("rng"), (F.col("part") % nodes).alias("node"), "digest", "n_norm",
            "best.neg_chars", F.col("best.did").alias("doc_id"), "best.rid", "n",
        )
        .groupBy("rng", "node")
        .applyInPandas(_first_run, "rng int, node int, run binary")
    )
    while nodes > 1:
        nodes = -(-nodes // FAN)
        runs = runs.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("rng", "node").applyInPandas(_round, "rng int, node int, run binary")
    winners = runs.select("run").mapInPandas(_unpack, "digest binary, keep_neg long, keep_id long, keep_rid long, group_size long")
    back = members.select("part", "digest").distinct().join(winners, "digest")
    kept = F.col("rid") == F.col("keep_rid")
    twin = ~kept & (F.col("did") == F.col("keep_id")) & (F.col("neg_chars") == F.col("keep_neg"))
    return members.join(back, ["part", "digest"]).select("did", "key", "digest", "keep_id", "group_size", kept.alias("kept"), twin.alias("twin"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space.  Of equal texts
    the row with the most code points in the original text stays, then the
    smallest doc_id (rows without one come last), then the first of repeated
    rows.  Null text counts as empty; a white-space text equals an empty one.
    Rows without a doc_id take part and are reported with a null one; keep_id is
    null where such a row stays.  Other columns are ignored; an empty table gives
    an empty result.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return _decide(docs).select(given("did").alias("doc_id"), given("keep_id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept.

    Rows are decided on one by one, so one identifier may stand for several texts;
    rows that share identifier, text and length are one, any of which stays."""
    decided = materialize(_decide(docs), "exact")
    kept = without_rows(docs, decided.filter("not kept and not twin"), _key())
    twins = decided.filter("twin").select("did", "key").distinct()
    if twins.isEmpty():
        return kept
    d, k = fresh(docs.columns, "row_id", "row_key")
    same = with_row_key(join_rows(kept, twins, _key(), "left_semi"), _key(), d, k).dropDuplicates([d, k]).drop(d, k)
    return without_rows(kept, twins, _key()).unionByName(same)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE_SQL = {
    "op5_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents
), h AS (
  SELECT doc_id, length(x) AS n, sha256(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS s FROM t
), w AS (
  SELECT doc_id, s,
    first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY s) AS group_size,
    row_number() OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS r
  FROM h
)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, s AS text_sha256 FROM w
""",
}
