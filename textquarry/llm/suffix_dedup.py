"""Removal of repeated byte strings by sharded suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else.
Every such string (window) is assigned to its anchor, the place in it whose
GRAM bytes have the smallest hash, so equal windows have equal anchors at the
same offset.  Neighbouring windows with one anchor make a segment.  Anchors that
occur once in the corpus are done with; segments of the others meet by anchor:

* equal segments are one, and if they are several, all their windows repeat
  (equal: 64 bits of a hash of the anchor's bytes and 64 of one of all bytes are;
  only segments of one anchor are compared, which are few);
* different segments of one anchor go, each once, to the anchor's shard.  Equal
  windows also agree in SIDE bytes before or after the anchor's; of the segments
  that agree with another one there, a suffix array (Larsson-Sadakane refinement: sort by eight bytes, then double the
  depth within the groups not yet told apart) and Kasai's common prefixes show
  which windows repeat;
* an anchor with more than HOT different segments (the edge of a passage that a
  large part of all documents holds) is dealt out over many shards.  Each sorts the
  digests of its windows and cuts the run into ranges, and the runs of a range are
  merged two by two by binary search.

So all windows that can be equal meet, and no task holds more than a shard.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, parts, read, small_batches

LENGTH = 400
#: Bytes whose hash makes an anchor; a power of two.
GRAM = 64
#: A window holds so many bytes more on one side of its anchor's GRAM.
SIDE = (LENGTH - GRAM) // 2
#: Different segments of an anchor that one shard takes.
HOT = 512
#: Bytes of a shard, about; a suffix array is built of at most twice as many.
SHARD_BYTES = 2 << 20
#: Windows of a sorted run, about.
RUN_WINDOWS = 1 << 18
#: Where a window of a run came from.
REF = np.dtype([("anchor", "<i8"), ("seg", "<i8"), ("window", "<i4")])

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_NONE = -(1 << 63)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place."""
    h, step, mult = (b.astype(U) + U(1)) * U(0xC2B2AE3D27D4EB4F), 1, int(_ODD)
    while step < GRAM:
        h = h[:-step] * U(mult) + h[step:]
        mult, step = mult * mult % (1 << 64), step * 2
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def segments(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(anchor hash, segment hash, first window, number of windows, bytes before the
    anchor) of a text, in order; signed hashes."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return []
    h = gram_hashes(np.frombuffer(data, np.uint8))
    width = LENGTH - GRAM + 1
    low = ((h >> U(32)) << U(32)) | np.arange(len(h), dtype=U)  # of equal hashes, the first
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: n], low[width - step : width - step + n])
    place = (low & U(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    counts = np.diff(np.r_[starts, n]).tolist()
    anchors, ahead = h[place[starts]].view(np.int64).tolist(), (place[starts] - starts).tolist()
    digest = xxhash.xxh3_64_intdigest
    return [(a, digest(data[s : s + c - 1 + LENGTH]) - (1 << 63), s, c, p) for a, s, c, p in zip(anchors, starts.tolist(), counts, ahead, strict=True)]


def eights(b: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes at each of n places, in an order that follows theirs."""
    key = np.zeros(n, U)
    for i in range(8):
        key = (key << U(8)) | b[i : n + i].astype(U)
    return key


def suffix_array(data: bytes) -> np.ndarray:
    """Places in the order of their suffixes, as far as LENGTH bytes tell them apart."""
    n = len(data)
    b = np.frombuffer(data + b"\0" * 8, np.uint8)
    key = eights(b, n)
    sa = np.argsort(key)
    ranks = np.empty(n, np.int64)
    new = np.r_[True, key[sa[1:]] != key[sa[:-1]]]
    head = np.flatnonzero(new)
    ranks[sa] = np.repeat(head, np.diff(np.r_[head, n]))  # of a group: the place of its first in sa
    depth = 8
    while depth < LENGTH:
        sizes = np.diff(np.r_[head, n])
        at = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in sa that are not told apart
        if not len(at):
            break
        who = sa[at]
        ahead = who + depth
        # rank at depth, then rank of what follows, as one number
        both = ranks[who] * (n + 1) + np.where(ahead < n, ranks[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(both)
        who, both = who[order], both[order]
        sa[at] = who
        fresh = np.r_[True, both[1:] != both[:-1]]
        new[at] = fresh
        ranks[who] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        head = np.flatnonzero(new)
        depth *= 2
    return sa


def repeated_windows(texts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """Of each segment (its bytes, its number of windows): which windows start with LENGTH bytes that occur at another window."""
    data = b"".join(texts)
    sa = suffix_array(data)
    begin = np.cumsum([0] + [len(t) for t in texts])[:-1]
    valid = np.zeros(len(data), bool)
    for a, c in zip(begin.tolist(), counts, strict=True):
        valid[a : a + c] = True
    # only windows: suffixes that begin beyond them are no strings of one text
    sa = sa[valid[sa]]
    starts = np.flatnonzero(valid)
    place = np.empty(len(data), np.int64)
    place[starts] = np.arange(len(starts))
    rank = np.empty(len(starts), np.int64)
    rank[place[sa]] = np.arange(len(sa))
    lcp = _kasai(data, sa, starts, rank)
    same = np.zeros(len(starts) + 1, bool)
    same[rank] = lcp >= LENGTH  # with the one before in order
    hit = same[rank] | same[np.minimum(rank + 1, len(starts))]
    flags = np.zeros(len(data), bool)
    flags[starts] = hit
    return [flags[a : a + c] for a, c in zip(begin.tolist(), counts, strict=True)]


def _kasai(data: bytes, sa: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefixes, up to LENGTH, of each window with the one before it in order
    (0 where a look at a few places shows that it is shorter than LENGTH).

    Kasai: where both move on by one place, the common prefix is at most one shorter.
    (Not every suffix is a window, so the neighbour need not move on; then it is
    compared from the beginning.)"""
    before = np.where(rank > 0, sa[np.maximum(rank - 1, 0)], -1)
    # most pairs differ in one of a few places; the scan goes over the others
    key = eights(np.frombuffer(data + b"\0" * 8, np.uint8), len(data))
    open_ = before >= 0
    for at in (0, LENGTH // 4, LENGTH // 2, LENGTH - 8):
        open_[open_] = key[starts[open_] + at] == key[before[open_] + at]
    where = np.flatnonzero(open_)
    out, h, last = np.zeros(len(starts), np.int64), 0, (-2, -2)
    for k, i, j in zip(where.tolist(), starts[where].tolist(), before[where].tolist(), strict=True):
        if last == (i - 1, j - 1) and 0 < h < LENGTH:
            h -= 1  # they differ at the same place as before
        elif data[i : i + LENGTH] == data[j : j + LENGTH]:
            h = LENGTH
        else:
            h, step = 0, 256
            while step:
                if h + step <= LENGTH and data[i + h : i + h + step] == data[j + h : j + h + step]:
                    h += step
                else:
                    step //= 2
        out[k] = h
        last = (i, j)
    return out


def runs(flags: np.ndarray) -> bytes:
    """First and one past the last of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge.astype(np.int32).tobytes()


def _bytes(text: str | None) -> bytes:
    return text.encode(errors="surrogatepass") if isinstance(text, str) else b""


def _segment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        blobs, size, ids, hashes = [], 0, [], []
        for did, th, text in zip(rows.did, rows.th, rows.text, strict=True):
            own = segments(_bytes(text))
            if own:
                blobs.append(np.array(own, np.int64)), ids.append(did), hashes.append(th)
                size += len(own)
                if size > 50_000:
                    yield _segment_frame(blobs, ids, hashes)
                    blobs, size, ids, hashes = [], 0, [], []
        if blobs:
            yield _segment_frame(blobs, ids, hashes)


def _segment_frame(blobs: list[np.ndarray], ids: list[int], hashes: list[int]) -> pd.DataFrame:
    """A row per document and different segment, with all the places where it begins."""
    doc, x = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs]), np.concatenate(blobs)
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], doc))
    doc, x = doc[order], x[order]
    key = np.stack([doc, x[:, 0], x[:, 1]], 1)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
    firsts = x[:, 2].astype(np.int32)
    d, x = doc[starts], x[starts]
    return pd.DataFrame({
        "did": np.array(ids)[d], "th": np.array(hashes)[d], "anchor": x[:, 0], "seg": x[:, 1], "first": x[:, 2], "windows": x[:, 3], "at": x[:, 4],
        "n": np.diff(np.r_[starts, len(firsts)]), "firsts": [f.tobytes() for f in np.split(firsts, starts[1:])],
    })


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the segments asked for of each text."""
    for rows in batches:
        for text, wanted in zip(rows.text, rows.wanted, strict=True):
            data = _bytes(text)
            w = list(wanted)
            yield pd.DataFrame({
                "anchor": [x["anchor"] for x in w], "seg": [x["seg"] for x in w], "hot": [x["hot"] for x in w], "windows": [x["windows"] for x in w], "at": [x["at"] for x in w],
                "data": [data[x["first"] : x["first"] + x["windows"] - 1 + LENGTH] for x in w],
            })


def _agreeing(rows: pd.DataFrame) -> np.ndarray:
    """Segments that agree with another one of their anchor in SIDE bytes before or after the anchor's."""
    sides = []
    for name, part in (("l", lambda d, at: d[at - SIDE : at + GRAM] if at >= SIDE else None), ("r", lambda d, at: d[at : at + GRAM + SIDE] if len(d) >= at + GRAM + SIDE else None)):
        keys = [(name, a, x) for a, x in zip(rows.anchor, map(part, rows.data, rows["at"]), strict=True)]
        n = Counter(keys)
        sides.append([k[2] is not None and n[k] > 1 for k in keys])
    return np.array(sides, bool).any(0)


def _shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows among the segments of a shard's anchors."""
    rows = rows[_agreeing(rows)].sort_values(["anchor", "seg"])
    out, texts, counts, size = [], [], [], 0
    anchors = rows.anchor.to_numpy()
    for k, (data, c) in enumerate(zip(rows.data, rows.windows, strict=True)):
        texts.append(data), counts.append(c)
        size += len(data)
        # a suffix array ends between anchors
        if k + 1 == len(rows) or size >= SHARD_BYTES and anchors[k + 1] != anchors[k]:
            out += [runs(f) for f in repeated_windows(texts, counts)]
            texts, counts, size = [], [], 0
    found = pd.DataFrame({"anchor": anchors, "seg": rows.seg.to_numpy(), "runs": out})
    return found[found.runs.map(len) > 0]


def _digest_runs(batches: Iterator[pd.DataFrame], ranges: int) -> Iterator[pd.DataFrame]:
    """Of hot anchors' segments: sorted runs of the digests of their windows, cut into ranges."""
    digest = xxhash.xxh3_128_digest
    held: list[bytes] = []
    refs: list[np.ndarray] = []

    def run() -> pd.DataFrame:
        d, ref = np.array(held, "S16"), np.concatenate(refs)
        order = np.argsort(d)
        d, ref = d[order], ref[order]
        first = np.frombuffer(d.tobytes(), ">u8")[::2]
        cuts = np.searchsorted(first, np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64))
        pieces = [(k, x, y) for k, (x, y) in enumerate(zip(np.split(d, cuts), np.split(ref, cuts), strict=True)) if len(x)]
        held.clear(), refs.clear()
        return pd.DataFrame({"range": [k for k, _, _ in pieces], "run": [x.tobytes() for _, x, _ in pieces], "refs": [y.tobytes() for _, _, y in pieces]})

    for rows in batches:
        for anchor, seg, data, c in zip(rows.anchor, rows.seg, rows.data, rows.windows, strict=True):
            held += [digest(data[i : i + LENGTH]) for i in range(c)]
            ref = np.empty(c, REF)
            ref["anchor"], ref["seg"], ref["window"] = anchor, seg, np.arange(c)
            refs.append(ref)
            if len(held) >= RUN_WINDOWS:
                yield run()
    if held:
        yield run()


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs (digests, where they came from) as one: each of b's finds its place in a by binary search."""
    at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
    rest = np.ones(len(a[0]) + len(b[0]), bool)
    rest[at] = False
    out = []
    for x, y in zip(a, b, strict=True):
        z = np.empty(len(rest), x.dtype)
        z[at], z[rest] = y, x
        out.append(z)
    return out[0], out[1]


def _merge_runs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Windows whose digest stands more than once in the runs of a range."""
    runs_ = [(np.frombuffer(x, "S16"), np.frombuffer(y, REF)) for x, y in zip(rows.run, rows.refs, strict=True)]
    while len(runs_) > 1:
        runs_ = [merge(*pair) if len(pair) > 1 else pair[0] for pair in (runs_[i : i + 2] for i in range(0, len(runs_), 2))]
    d, ref = runs_[0]
    same = np.r_[False, d[1:] == d[:-1], False]
    return pd.DataFrame(ref[same[1:] | same[:-1]])


def _gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    flags = np.zeros(int(rows.window.max()) + 1, bool)
    flags[rows.window.to_numpy()] = True
    return pd.DataFrame({"anchor": [key[0]], "seg": [key[1]], "runs": [runs(flags)]})


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        n, removed, spans, sha = [], [], [], []
        for text, found in zip(rows.text, rows.found, strict=True):
            data = _bytes(text)
            edge = np.zeros(len(data) + 1, np.int64)
            for x in found if found is not None else ():
                r = np.frombuffer(x["runs"], np.int32).reshape(-1, 2)
                r = (np.frombuffer(x["firsts"], np.int32)[:, None, None] + r).reshape(-1, 2)
                np.add.at(edge, r[:, 0], 1)
                np.add.at(edge, np.minimum(r[:, 1] - 1 + LENGTH, len(data)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            n.append(len(data)), removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            sha.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
        yield pd.DataFrame({"doc_id": rows.doc_id.astype("Int64"), "n_bytes": n, "n_removed": removed, "n_spans": spans, "kept_sha256": sha})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are taken as UTF-8; null is empty.  Strings do not cross documents and are
    judged on the input.  Texts shorter than LENGTH lose nothing.  Repeated rows are
    copies of each other, so both lose their repeated strings; doc_id may be null
    or repeated, other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    # a row is known by its identifier and a hash of its text, so repeated identifiers do no harm
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("did"), F.xxhash64("text").alias("th"))
    long_enough = docs.filter(F.octet_length("text") >= LENGTH)
    occurs = materialize(long_enough.select("did", "th", "text").mapInPandas(_segment_rows, "did long, th long, anchor long, seg long, first long, windows long, at long, n long, firsts binary"), "segments")
    each = occurs.groupBy("anchor", "seg").agg(F.sum("n").alias("n"), F.min(F.struct("did", "th", "first", "windows", "at")).alias("one"))
    per = each.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).filter("n > 1")
    each = materialize(each.withColumnRenamed("n", "own").join(per, "anchor"), "anchors")
    whole = each.filter("own > 1").select("anchor", "seg", _pack(F.lit(0), F.col("one.windows")).alias("runs"))
    # different segments of one anchor: one copy of each is looked at
    asked = each.filter("kinds > 1").select("one.did", "one.th", F.struct("anchor", "seg", (F.col("kinds") > HOT).alias("hot"), "one.first", "one.windows", "one.at").alias("w"))
    asked = asked.groupBy("did", "th").agg(F.collect_list("w").alias("wanted"))  # at most a document's segments
    texts = _with(long_enough, asked).dropDuplicates(["did", "th"]).select("text", "wanted")
    cut = materialize(texts.mapInPandas(_cut_out, "anchor long, seg long, hot boolean, windows long, at long, data binary"), "cut")
    size = cut.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(parts(spark), -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    found = cut.filter("not hot").withColumn("shard", shard).groupBy("shard").applyInPandas(_shard, "anchor long, seg long, runs binary")
    n_hot = cut.filter("hot").agg(F.sum("windows")).first()[0] or 0
    ranges = max(1, -(-n_hot // RUN_WINDOWS))
    dealt = cut.filter("hot").repartition(max(ranges, parts(spark)), "anchor", "seg").mapInPandas(lambda x: _digest_runs(x, ranges), "range int, run binary, refs binary")
    hot = dealt.groupBy("range").applyInPandas(_merge_runs, "anchor long, seg long, window int")
    hot = hot.groupBy("anchor", "seg").applyInPandas(_gather, "anchor long, seg long, runs binary")
    # a segment that occurs twice needs no further finds
    some = materialize(found.unionByName(hot).join(whole.select("anchor", "seg"), ["anchor", "seg"], "left_anti").unionByName(whole), "repeats")
    # a segment that very many documents hold makes a skewed join, which is split since both sides are plainly shuffled
    gone = occurs.select("did", "th", "anchor", "seg", "firsts").join(some, ["anchor", "seg"])
    gone = materialize(gone.select("did", "th", "firsts", "runs").distinct().groupBy("did", "th").agg(F.collect_list(F.struct("firsts", "runs")).alias("found")), "found")
    changed = _with(docs, gone).select("doc_id", "text", "found").mapInPandas(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce(F.col("text"), F.lit(""))
    zero = F.lit(0).cast("long")
    same = _with(docs, gone.select("did", "th"), "left_anti").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256")
    )
    return changed.unionByName(same)


def _pack(a: Column, b: Column) -> Column:
    """Two numbers as runs() writes them."""
    little = lambda c: F.reverse(F.array(*[F.substring(F.lpad(F.hex(c.cast("long")), 8, "0"), i, 2) for i in (1, 3, 5, 7)]))
    return F.unhex(F.array_join(F.concat(little(a), little(b)), ""))


def _with(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """docs joined with rows by (did, th).  Their keys go to every executor first if
    their counted size is small, so that only the texts concerned are shuffled."""
    if how == "left_anti":
        keys = rows.select("did", "th")
        if keys.count() * 32 <= BROADCAST_BYTES:
            keys = F.broadcast(keys)
        return docs.join(keys, ["did", "th"], "left_anti")
    keys = rows.select("did", "th")
    if keys.count() * 32 <= BROADCAST_BYTES:
        docs = docs.join(F.broadcast(keys), ["did", "th"], "left_semi")
    return docs.join(rows, ["did", "th"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
