"""Mixing sources to target weights, with DataFrame and SQL functions only.

The weight of a source is its share of all tokens to the power alpha, made to
sum to one.  alpha is found by bisection: the largest that reaches a target
entropy, or the largest whose most repeated source is shown at most a given
number of times.  The token budget is the smallest that shows every document at
least once, unless one is given.  Each source's budget is then realised as
permutations of blocks: documents are hashed into blocks, every epoch runs
through the blocks in an order of its own and through a block's documents in an
order of their own, and the last epoch ends when the budget is used up.

A source has about as many blocks as a block has documents, so neither the
window over a source's blocks nor the one over a block's documents holds more
than a root of the source's rows, however large the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, materialize, read

#: Halvings of the exponent's interval.
STEPS = 40
#: Documents of a block, at least.
BLOCK_DOCS = 256


def bisect_exponent(shares: Column, *, max_epochs: float | None = None, entropy: float | None = None) -> Column:
    """The largest alpha in [0, 1] that meets the target; 0 if none does.

    shares: array of positive shares.  Epochs (of the smallest over the largest
    source) and entropy (bits) both fall as alpha rises."""
    if (max_epochs is None) == (entropy is None):
        raise ValueError("give either max_epochs or entropy")

    def met(a: Column) -> Column:
        if max_epochs is not None:
            return F.pow(F.array_min(shares) / F.array_max(shares), a - 1) <= F.lit(float(max_epochs))
        raised = F.transform(shares, lambda s: F.pow(s, a))
        total = F.aggregate(raised, F.lit(0.0), lambda x, y: x + y)
        return F.aggregate(raised, F.lit(0.0), lambda x, y: x - y / total * F.log2(y / total)) >= F.lit(float(entropy))

    # more repetition is allowed by a larger alpha, more entropy by a smaller one
    up = F.lit(entropy is not None)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        right = met(mid) == up
        return F.struct(F.when(right, mid).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda acc: acc["lo"] if entropy is not None else acc["hi"])


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source (null: empty), n_tokens (words of the whole text; null: none)."""
    return docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def source_weights(counts: DataFrame, *, max_epochs: float | None = None, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """One row per source: tokens, n_docs, alpha, weight, quota (tokens to show)."""
    per = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    # one number per source, a catalogue of names, meets in one row
    target = per.filter("tokens > 0").agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("ts"))
    total = F.aggregate("ts", F.lit(0.0), lambda x, y: x + y)
    target = target.select("ts", total.alias("total"))
    target = target.withColumn("shares", F.transform("ts", lambda t: t / F.col("total")))
    target = target.withColumn("alpha", F.when(F.size("ts") > 0, bisect_exponent(F.col("shares"), max_epochs=max_epochs, entropy=entropy)))
    raised = F.aggregate(F.transform("shares", lambda s: F.pow(s, F.col("alpha"))), F.lit(0.0), lambda x, y: x + y)
    target = target.withColumn("norm", raised)
    least = F.array_max(F.transform("ts", lambda t: t / (F.pow(t / F.col("total"), F.col("alpha")) / F.col("norm"))))
    # one row of four numbers
    t = target.select("total", "alpha", "norm", (F.lit(float(budget)) if budget is not None else least).alias("budget")).first()
    total, alpha, norm, budget = (F.lit(t[k]).cast("double") for k in ("total", "alpha", "norm", "budget"))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, alpha) / norm).otherwise(F.lit(0.0))
    quota = F.greatest(F.round(weight * budget), F.lit(0.0)).cast("long")
    return per.select("source", "tokens", "n_docs", alpha.alias("alpha"), weight.alias("weight"), quota.alias("quota"))


def _hash(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def mix(docs: DataFrame, *, max_epochs: float | None = None, entropy: float | None = None, budget: int | None = None, seed: int = 17) -> DataFrame:
    """One row per showing of a document: doc_id, source, n_tokens, epoch,
    block_pos, doc_pos, slot.

    epoch counts a source's passes from 0; block_pos is the place of the block in
    the pass, doc_pos that of the document in its block; slot is the part of the
    source's quota used up before the block (in 10^-9), so that reading by
    (slot, source, epoch, block_pos, doc_pos) meets the weights all along.  The
    document that crosses the quota is the last.  Documents without tokens are
    shown in the first pass.  Null source counts as the empty name, null text as
    no tokens; rows without doc_id are left out; repeated rows are shown as often
    as they occur, in ties ordered by n_tokens.  An empty table gives no rows.
    """
    counts = materialize(token_counts(docs), "tokens")
    weights = source_weights(counts, max_epochs=max_epochs, entropy=entropy, budget=budget)
    weights = materialize(weights, "weights")
    side = F.greatest(F.lit(BLOCK_DOCS), F.ceil(F.sqrt(F.col("n_docs").cast("double"))))
    weights = weights.withColumn("n_blocks", F.ceil(F.col("n_docs") / side).cast("long"))
    # the join puts a source's rows together by name; a few sources, many rows: the small side goes to all if its size allows
    block = F.conv(F.substring(_hash(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long")
    small = weights.select("source", "n_blocks")
    if weights.count() <= 100_000:
        small = F.broadcast(small)
    dealt = counts.join(small, "source").withColumn("block", block % F.col("n_blocks")).drop("n_blocks")
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("b_tokens"))
    passes = F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
    blocks = blocks.join(weights.select("source", "tokens", "quota", F.greatest(passes, F.lit(1)).alias("passes")), "source")
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    order = W.partitionBy("source", "epoch").orderBy(_hash(seed, F.col("epoch"), F.col("source"), F.col("block")), "block")
    before = F.coalesce(F.sum("b_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(
        "source", "block", "epoch", "quota", (F.row_number().over(order) - 1).cast("long").alias("block_pos"),
        (F.col("epoch") * F.col("tokens") + before).alias("used"),
    ).filter("used < quota or epoch = 0")
    shown = dealt.join(blocks, ["source", "block"])
    inner = W.partitionBy("source", "block", "epoch").orderBy(_hash(seed, F.col("epoch"), F.col("doc_id")), "doc_id", "n_tokens")
    used = F.col("used") + F.coalesce(F.sum("n_tokens").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slot = F.when(F.col("quota") > 0, F.floor(F.col("used") / F.col("quota") * F.lit(1e9))).otherwise(F.lit(0)).cast("long")
    return (
        shown.withColumns({"doc_pos": (F.row_number().over(inner) - 1).cast("long"), "now": used, "slot": slot})
        .filter("now < quota or (epoch = 0 and n_tokens = 0)")
        .select("doc_id", "source", "n_tokens", "epoch", "block_pos", "doc_pos", "slot")
    )


#: Production parameters: no source is shown more than twice as often as the largest.
MAX_EPOCHS = 2.0


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), max_epochs=MAX_EPOCHS)


QUERIES = {"op1_mixing": op1_mixing}
ORACLE_SQL = {
    "op1_mixing": r"""
WITH RECURSIVE c AS (
  SELECT doc_id, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents WHERE doc_id IS NOT NULL
), per AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_docs FROM c GROUP BY source
), ext AS (
  SELECT CAST(sum(tokens) AS DOUBLE) AS total, CAST(min(tokens) AS DOUBLE) AS lo_t, CAST(max(tokens) AS DOUBLE) AS hi_t FROM per WHERE tokens > 0
), bis AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1,
    CASE WHEN pow((lo_t / total) / (hi_t / total), (lo + hi) / 2 - 1) <= 2.0 THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN pow((lo_t / total) / (hi_t / total), (lo + hi) / 2 - 1) <= 2.0 THEN (lo + hi) / 2 ELSE hi END
  FROM bis, ext WHERE i < 40
), al AS (
  SELECT hi AS alpha FROM bis WHERE i = 40
), nm AS (
  SELECT sum(pow(tokens / total, alpha)) AS norm FROM per, ext, al WHERE tokens > 0
), wt AS (
  SELECT source, tokens, n_docs, CASE WHEN tokens > 0 THEN pow(tokens / total, alpha) / norm ELSE 0 END AS weight FROM per, ext, al, nm
), bg AS (
  SELECT max(tokens / weight) AS budget FROM wt WHERE tokens > 0
), q AS (
  SELECT source, tokens, CAST(round(weight * budget) AS BIGINT) AS quota,
    CAST(ceil(n_docs / greatest(256, ceil(sqrt(n_docs)))) AS BIGINT) AS n_blocks,
    greatest(1, CASE WHEN tokens > 0 THEN CAST(ceil(CAST(round(weight * budget) AS BIGINT) / tokens) AS BIGINT) ELSE 1 END) AS passes
  FROM wt, bg
), d AS (
  SELECT c.*, CAST('0x' || substr(md5('17|' || doc_id), 1, 8) AS BIGINT) % n_blocks AS block FROM c JOIN q USING (source)
), b AS (
  SELECT source, block, sum(n_tokens) AS b_tokens FROM d GROUP BY source, block
), p AS (
  SELECT b.source, b.block, b.b_tokens, q.tokens, q.quota, unnest(range(q.passes)) AS epoch FROM b JOIN q USING (source)
), o AS (
  SELECT source, block, epoch, quota,
    row_number() OVER w - 1 AS block_pos,
    epoch * tokens + coalesce(sum(b_tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM p WINDOW w AS (PARTITION BY source, epoch ORDER BY md5('17|' || epoch || '|' || source || '|' || block), block)
), s AS (
  SELECT d.doc_id, d.source, d.n_tokens, o.epoch, o.block_pos, o.quota, o.used,
    row_number() OVER w - 1 AS doc_pos,
    o.used + coalesce(sum(d.n_tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS now
  FROM d JOIN o ON d.source = o.source AND d.block = o.block AND (o.used < o.quota OR o.epoch = 0)
  WINDOW w AS (PARTITION BY d.source, d.block, o.epoch ORDER BY md5('17|' || o.epoch || '|' || d.doc_id), d.doc_id, d.n_tokens)
)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(block_pos AS BIGINT) AS block_pos, CAST(doc_pos AS BIGINT) AS doc_pos,
  CASE WHEN quota > 0 THEN CAST(floor(CAST(used AS DOUBLE) / CAST(quota AS DOUBLE) * 1e9) AS BIGINT) ELSE 0 END AS slot
FROM s WHERE now < quota OR (epoch = 0 AND n_tokens = 0)
""",
}
