"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of distinct five-word shingles.  All shingles are brought in
one order: rare ones first, by hash, then the frequent ones.  Two sets of
similarity T share a shingle among the first n - ceil(T n) + 1 of each (their
prefixes).  Where a prefix holds rare shingles only, each is indexed by itself.
Where it holds frequent ones it is extended until any two similar sets share
k = g + 1 shingles in it: either one of those is rare, or all are frequent and
two of them fall in the same of g classes.  So the frequent shingles are indexed
as two-token combinations within a class, with g in proportion to the set, which
makes their number linear in its size.

Index lists travel as packed arrays.  Lists of up to LIST documents give their
pairs; a pair remains if the shingles it shares in the prefixes, and all that can
still come after them, suffice, and is verified on the whole sets.  Longer lists,
which only large groups of similar documents leave, are not expanded.  Documents
that such lists connect make a group.  A group of up to BLOCK documents is worked
off in one task, which counts common shingles by posting lists.  Of a larger one,
LEADERS documents that stand in most lists are compared with all others, block by
block; then those outside the largest component so found are compared, again
block against block, with all the others.  Of the links found in a task, only a
spanning forest goes on.

Which shingles count as frequent is a matter of speed only; the join is exact for
any choice.  They are judged from what recurs inside the tasks, and where long
lists of single shingles show that too many were missed, these are added and the
index is made again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, fresh, materialize, only, parts, read, small_batches, without
from .components import components

WORDS = 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle of so many documents is frequent; so many frequent ones are told apart, at most.
FREQUENT, MOST_FREQUENT = 32, 1 << 20
#: Documents of a list whose pairs are made at once.
LIST = 64
#: The index is made again, at most AGAIN times, if long lists of single shingles have one document in MISSED and make groups beyond BLOCK.
AGAIN, MISSED = 3, 64
#: Documents of a group that one task takes; those compared first in larger groups.
BLOCK, LEADERS = 1024, 32
#: Postings of an index bucket.
BUCKET = 1 << 20
SALT = 32

U = np.uint64
MULT = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
POSTING = np.dtype([("k", "<u4"), ("id", "<i8"), ("n", "<u4"), ("w", "<u4")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("need", "<u4"), ("c", "<u4")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * MULT[4]
    h = h ^ (h >> U(29))
    h = h * MULT[3]
    return h ^ (h >> U(32))


class Shingler:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def __missing(self, w: bytes) -> int:
        if len(self.words) > 1 << 18:
            self.words.clear()
        x = self.words[w] = xxhash.xxh3_64_intdigest(w)
        return x

    def split(self, text: str | None) -> list[bytes]:
        return text.encode(errors="surrogatepass").lower().split() if text else []

    def shingles(self, w: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes; of fewer than five words, that of all of them."""
        if not w:
            return np.empty(0, U)
        if len(w) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], U)
        get, miss = self.words.get, self.__missing
        a = np.fromiter([get(x) or miss(x) for x in w], U, len(w))
        h = a[WORDS - 1 :] * MULT[0]
        for i in range(WORDS - 1):
            h = h + a[i : len(a) - WORDS + 1 + i] * MULT[i + 1]
        return np.unique(_mix(h))


def key_of(w: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(w), digest_size=16).digest()


def _texts(rows: pd.DataFrame) -> Iterator[tuple[int, str | None]]:
    return ((i, t if isinstance(t, str) else None) for i, t in zip(rows.doc_id, rows.text, strict=True))


def _surveyed(**columns) -> pd.DataFrame:
    rows = range(len(next(iter(columns.values()))))
    return pd.DataFrame({c: pd.Series(columns.get(c), rows, object if c == "key" else "Int64") for c in ("doc_id", "own", "key", "n", "token", "cnt")})


#: Shingles among which recurring ones are looked for at a time.
WINDOW = 4_000_000


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per document (key of its words, set size), and shingles that recur within the task."""
    sh, seen, held, n = Shingler(), set(), [], 0

    def recurring() -> pd.DataFrame:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return _surveyed(token=u[c > 1].view(np.int64), cnt=c[c > 1])

    for rows in batches:
        ids, keys, sizes = [], [], []
        for i, t in _texts(rows):
            w = sh.split(t)
            h = sh.shingles(w)
            k = key_of(w)
            ids.append(i), keys.append(k), sizes.append(len(h))
            if len(h) and k not in seen:
                seen.add(k)
                held.append(h)
                n += len(h)
        if n > WINDOW:  # over batches, else few would recur
            yield recurring()
            n = 0
        if len(seen) > 1 << 16:
            seen.clear()
        yield _surveyed(doc_id=ids, own=rows.own.astype("Int64").to_numpy(), key=keys, n=sizes)
    if held:
        yield recurring()


def least_overlap(n: np.ndarray) -> np.ndarray:
    """What a set of n must share with any similar one."""
    return -(-PERCENT * n // 100)


def _need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What sets of a and b must share."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _classes(bucket: int) -> int:
    """Classes for sets of 2**bucket to 2**(bucket+1) shingles."""
    return max(1, (1 << bucket) // 4)


def _placed(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and list number of index keys."""
    key = _mix(key)
    return key % U(buckets), key >> U(32)


class Indexer:
    """frequent: shingles, lists: lists (bucket and number in one) of further ones; both sorted."""

    def __init__(self, frequent: np.ndarray, lists: np.ndarray, buckets: int):
        self.frequent, self.lists, self.buckets = frequent, lists, buckets
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(frequent >> U(44)).astype(np.int64)] = True

    def is_frequent(self, h: np.ndarray) -> np.ndarray:
        out = self.maybe[(h >> U(44)).astype(np.int64)]
        if len(at := np.flatnonzero(out)):
            i = np.searchsorted(self.frequent, h[at])
            i[i == len(self.frequent)] = 0
            out[at] = self.frequent[i] == h[at]
        if len(self.lists):
            bucket, k = _placed(h, self.buckets)
            own = (bucket << U(32)) | k
            i = np.searchsorted(self.lists, own)
            i[i == len(self.lists)] = 0
            out |= self.lists[i] == own
        return out

    def keys(self, h: np.ndarray) -> tuple[np.ndarray, int]:
        """Index keys of a set, and the place in the order where its prefix ends (top bit: among the frequent)."""
        n = len(h)
        p = n - int(least_overlap(n)) + 1
        f = self.is_frequent(h)
        rare, often = h[~f], h[f]
        if len(rare) >= p:
            return rare[:p], int(rare[p - 1] >> U(33))
        out = [rare]
        for bucket in sorted({int(least_overlap(n)).bit_length() - 1, n.bit_length() - 1}):
            g = _classes(bucket)
            k = min(g + 1, int(least_overlap(n)))
            ext = often[: max(0, p + k - 1 - len(rare))]
            # fewer than g + 1 shared for sure: one class, or single tokens
            if k == 1:
                out.append(ext)
                continue
            cls = ext % U(g) if k == g + 1 else np.zeros(len(ext), U)
            order = np.lexsort((ext, cls))
            ext, cls = ext[order], cls[order]
            ends = np.searchsorted(cls, cls, "right")
            at = np.arange(len(ext))
            reps = ends - at - 1
            first = np.repeat(at, reps)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(reps) - reps, reps)
            out.append(_mix(ext[first] * MULT[1] + ext[second] * MULT[2] + U(bucket + 1)))
        return np.concatenate(out), 1 << 31


def _postings(batches: Iterator[pd.DataFrame], index: Indexer, buckets: int) -> Iterator[pd.DataFrame]:
    sh = Shingler()
    for rows in batches:
        keys, ids, ns, ws, count = [], [], [], [], []
        for i, t in _texts(rows):
            h = sh.shingles(sh.split(t))
            if len(h):
                k, w = index.keys(h)
                keys.append(k), ids.append(i), ns.append(len(h)), ws.append(w), count.append(len(k))
        if not keys:
            continue
        key = np.concatenate(keys)
        out = np.empty(len(key), POSTING)
        bucket, number = _placed(key, buckets)
        bucket = bucket.astype(np.int64)
        out["k"], out["id"], out["n"], out["w"] = number, np.repeat(ids, count), np.repeat(ns, count), np.repeat(ws, count)
        order = np.argsort(bucket, kind="stable")
        out, bucket = out[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        yield pd.DataFrame({"bucket": bucket[starts], "blob": [x.tobytes() for x in np.split(out, starts[1:])]})


def _sum_pairs(p: np.ndarray) -> np.ndarray:
    order = np.lexsort((p["b"], p["a"]))
    p = p[order]
    if not len(p):
        return p
    starts = np.flatnonzero(np.r_[True, (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])])
    out = p[starts].copy()
    out["c"] = np.add.reduceat(p["c"].astype(np.int64), starts)
    out["need"] = np.minimum.reduceat(p["need"], starts)
    return out


def _lists(key: tuple, rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of one index bucket: packed pairs by pair bucket, and long lists."""
    p = np.concatenate([np.frombuffer(b, POSTING) for b in rows.blob])
    # a repeated row brings its postings again
    p = p[np.lexsort((p["id"], p["n"], p["k"]))]
    p = p[np.r_[True, (p["k"][1:] != p["k"][:-1]) | (p["id"][1:] != p["id"][:-1])]]
    starts = np.flatnonzero(np.r_[True, p["k"][1:] != p["k"][:-1]])
    size = np.diff(np.r_[starts, len(p)])
    per = np.repeat(size, size)
    out: dict[str, list] = {"kind": [], "part": [], "blob": []}
    for s, m in zip(starts[size > LIST], size[size > LIST], strict=True):
        out["kind"].append(1), out["part"].append(int(xxhash.xxh3_64_intdigest(p["id"][s : s + m].tobytes()) % buckets))
        out["blob"].append(p["id"][s : s + m].tobytes())
        if (p["w"][s : s + m] < 1 << 31).any():  # a document without frequent shingles: the list is one shingle's
            out["kind"].append(2), out["part"].append(0)
            out["blob"].append(np.array([int(key[0]) << 32 | int(p["k"][s]), m], U).tobytes())
    q = p[(per > 1) & (per <= LIST)]
    found = []
    for lag in range(1, LIST):
        x, y = q[:-lag], q[lag:]
        at = np.flatnonzero(x["k"] == y["k"])
        if not len(at):
            break
        x, y = x[at], y[at]  # x is the smaller set
        fits = 100 * x["n"].astype(np.int64) >= PERCENT * y["n"].astype(np.int64)
        x, y = x[fits], y[fits]
        new = np.empty(len(x), PAIR)
        nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
        owner = np.where(x["w"] <= y["w"], nx, ny)
        # beyond the prefix that ends first, its owner has least_overlap - 1 shingles
        need = np.maximum(_need(nx, ny) - (least_overlap(owner) - 1), 1)
        # where that prefix reaches the frequent ones, what is shared there was not counted
        new["need"] = np.where(np.minimum(x["w"], y["w"]) >= 1 << 31, 0, need)
        new["a"], new["b"], new["c"] = np.minimum(x["id"], y["id"]), np.maximum(x["id"], y["id"]), 1
        found.append(new)
    if found:
        pairs = _sum_pairs(np.concatenate(found))
        to = (_mix(pairs["a"].astype(U) * MULT[0] + pairs["b"].astype(U)) % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        pairs, to = pairs[order], to[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        for b, x in zip(to[starts], np.split(pairs, starts[1:]), strict=True):
            out["kind"].append(0), out["part"].append(int(b)), out["blob"].append(x.tobytes())
    return pd.DataFrame(out)


def _candidates(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs that still can be similar (kind 0); each different long list (kind 1) as it is;
    the numbers of long lists of single shingles (kind 2; b: their documents)."""
    if key[0] == 2:
        x = np.concatenate([np.frombuffer(b, U) for b in rows.blob]).reshape(-1, 2)
        return pd.DataFrame({"a": pd.Series([None], dtype="Int64"), "b": pd.Series([int(x[:, 1].sum())], dtype="Int64"), "blob": [x[:, 0].tobytes()]})
    if key[0] == 1:
        blobs = rows.blob.drop_duplicates()
        return pd.DataFrame({"a": pd.Series(None, blobs.index, "Int64"), "b": pd.Series(None, blobs.index, "Int64"), "blob": blobs})
    p = _sum_pairs(np.concatenate([np.frombuffer(b, PAIR) for b in rows.blob]))
    p = p[p["c"] >= p["need"]]
    return pd.DataFrame({"a": p["a"], "b": p["b"], "blob": pd.Series(None, range(len(p)), object)})


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    i = np.searchsorted(y, x)
    i[i == len(y)] = 0
    inter = int((y[i] == x).sum())
    return 100 * inter >= PERCENT * (len(x) + len(y) - inter)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        ok = [_similar(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(rows.set_a, rows.set_b, strict=True)]
        yield rows.loc[ok, ["a", "b"]]


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sh = Shingler()
    for rows in batches:
        out = {}
        for i, t in _texts(rows):
            out[i] = sh.shingles(sh.split(t)).tobytes()
        yield pd.DataFrame({"id": list(out), "hashes": list(out.values())})


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    a = sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInPandas(_verify, "a long, b long")


def links_between(ids_a: list[int], sets_a: list[np.ndarray], ids_b: list[int], sets_b: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents of a and of b, by counting
    common shingles along posting lists of a's."""
    token = np.concatenate(sets_a)
    owner = np.repeat(np.arange(len(sets_a)), [len(x) for x in sets_a])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    size_a = np.array([len(x) for x in sets_a])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    out = []
    for i, x in zip(ids_b, sets_b, strict=True):
        lo, hi = np.searchsorted(token, x, "left"), np.searchsorted(token, x, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        inter = np.bincount(owner[at], minlength=len(sets_a))
        for k in np.flatnonzero(100 * inter >= PERCENT * (size_a + len(x) - inter)).tolist():
            a, b = root(ids_a[k]), root(i)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((ids_a[k], i))
    return out


def _unpacked(rows: pd.DataFrame) -> tuple[list[int], list[np.ndarray]]:
    return rows.id.tolist(), [np.frombuffer(x, U) for x in rows.hashes]


def _link_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    ids, sets = _unpacked(rows)
    return pd.DataFrame(links_between(ids, sets, ids, sets), columns=["a", "b"], dtype=np.int64)


def _link_blocks(key: tuple, first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
    if first.empty or second.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    return pd.DataFrame(links_between(*_unpacked(first), *_unpacked(second)), columns=["a", "b"], dtype=np.int64)


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each long list: its smallest document with each; lists: how many of them hold it."""
    for rows in batches:
        made = []
        for blob in rows.blob:
            ids = np.frombuffer(blob, np.int64)
            made.append(np.stack([np.full(len(ids), ids.min()), ids], 1))
        pairs, n = np.unique(np.concatenate(made), axis=0, return_counts=True)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "lists": n})


def _own(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own, to be cogrouped with rows of one origin."""
    return df.toDF(*(f"_{c}" for c in df.columns)).toDF(*df.columns)


def _groups(lists: DataFrame) -> DataFrame:
    """id, root, lists, m, blocks, block of the documents in long lists: their group, its
    size, and the block they are dealt to; lists: how many long lists hold them."""
    stars = materialize(lists.select("blob").mapInPandas(_stars, "a long, b long, lists long"), "lists")
    central = stars.groupBy("b").agg(F.sum("lists").alias("lists")).withColumnRenamed("b", "id")
    roots = components(stars.select("a", "b"))
    dense = central.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = dense.groupBy("root").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    return materialize(dense.join(sizes, "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")), "dense")


def _work_off(dense: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) within the groups that long lists make (module's docstring)."""
    if dense.isEmpty():
        return dense.select(F.col("id").alias("a"), F.col("id").alias("b"))
    sets = only(docs, dense.select(F.col("id").alias("doc_id"))).mapInPandas(_sets, "id long, hashes binary").dropDuplicates(["id"])
    dense = materialize(dense.join(sets, "id"), "dense-sets")
    links = "a long, b long"
    small = dense.filter("blocks = 1").select("root", "id", "hashes").groupBy("root").applyInPandas(_link_group, links)
    large = dense.filter("blocks > 1")
    if large.isEmpty():
        return small
    # the most central documents, first of parts of the group, then of the group
    order = [F.desc("lists"), "id"]
    top = large.withColumn("r", F.row_number().over(W.partitionBy("root", "block").orderBy(*order))).filter(F.col("r") <= LEADERS)
    top = top.withColumn("r", F.row_number().over(W.partitionBy("root").orderBy(*order))).filter(F.col("r") <= LEADERS)
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    top = top.select("root", "id", "hashes", each_block.alias("block"))
    by = ["root", "block"]
    first = materialize(_own(top).groupBy(*by).cogroup(large.select("root", "id", "hashes", "block").groupBy(*by)).applyInPandas(_link_blocks, links), "led")
    comp = components(first).select(F.col("node").alias("id"), F.col("root").alias("comp"))
    large = large.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    main = large.groupBy("root", "comp").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "comp")).alias("main"))
    rest = large.join(main, "root").filter("comp <> main.comp")
    left = rest.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("rests"))
    rest = rest.join(left, "root").withColumn("rest", F.pmod(F.xxhash64("id", F.lit("rest")), "rests"))
    each_rest = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("rest")
    by = ["root", "block", "rest"]
    others = large.join(left, "root").select("root", "id", "hashes", "block", each_rest)
    rest = rest.select("root", "id", "hashes", "rest", each_block.alias("block"))
    second = _own(rest).groupBy(*by).cogroup(others.groupBy(*by)).applyInPandas(_link_blocks, links)
    return small.unionByName(first).unionByName(second)


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """docs with a number of the document: its identifier, or, where that is missing or
    stands on several rows, a hash of identifier and text; and whether none has to be hashed."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    several = materialize(ids.filter("_id is not null").groupBy("_id").count().filter("count > 1").select("_id"), "several")
    hashed = F.xxhash64(F.lit("row"), "doc_id", "text")
    if (n := several.count()) == 0:
        missing = not ids.filter("_id is null").isEmpty()
        return docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), hashed)), not missing
    (mark,) = fresh([*docs.columns, name], "several_of")
    several = several.withColumnRenamed("_id", mark)
    several = F.broadcast(several) if n * 48 <= BROADCAST_BYTES else several
    marked = docs.join(several, F.col("doc_id").cast("long") == F.col(mark), "left")
    number = F.when(F.col(mark).isNotNull() | F.col("doc_id").isNull(), hashed).otherwise(F.col("doc_id").cast("long"))
    return marked.withColumn(name, number).drop(mark), False


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are runs of characters other than space and tab to carriage return, A-Z
    in lower case.  A document of fewer than five words is one shingle, all of
    them; one without words, or with null text, has none and is linked with
    nothing.  component_id is the smallest doc_id reachable over links, null
    where no document reached has one.  Rows that share doc_id and text are one
    document, each reported; rows that share a doc_id only are several.  Other
    columns are ignored; an empty table gives no rows.
    """
    (name,) = fresh(docs.columns, "number")
    docs, plain = _numbered(docs, name)
    found = _rooted(docs.select(F.col(name).alias("doc_id"), F.col("doc_id").cast("long").alias("own"), "text"))
    if plain:  # the smallest number is the smallest identifier
        return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    found = materialize(found, "numbered-classes")
    least = found.groupBy("root").agg(F.min("own").alias("least")).filter("least is null or least <> root").withColumn("other", F.lit(True))
    least = F.broadcast(least) if least.count() * 48 <= BROADCAST_BYTES else least
    both = found.join(least, "root", "left")
    return both.select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("other"), F.col("least")).otherwise(F.col("root")).alias("component_id"))


def _rooted(docs: DataFrame) -> DataFrame:
    """doc_id, own, n, root of docs (doc_id: number of the document; own: its identifier; text)."""
    spark = docs.sparkSession
    small_batches(spark)
    survey = materialize(docs.mapInPandas(_survey, "doc_id long, own long, key binary, n long, token long, cnt long"), "survey")
    each = survey.filter("doc_id is not null").select("doc_id", "own", "key", "n")
    docs = docs.select("doc_id", "text")
    # copies of the same words: the smallest identifier stands for all
    same = each.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).filter("m > 1")
    same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    each = materialize(each.join(same, ["key", "salt"], "left").select("doc_id", "own", "n", F.coalesce("rep", "doc_id").alias("rep")), "reps")
    often = survey.filter("token is not null").groupBy("token").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") >= FREQUENT)
    often = often.orderBy(F.desc("cnt"), "token").limit(MOST_FREQUENT).select("token").toPandas()
    frequent = np.sort(often.token.to_numpy(np.int64).view(U))
    n_docs, total = each.agg(F.count("*"), F.sum("n")).first()
    buckets = max(parts(spark), -(-(total or 0) // (4 * BUCKET)))
    single = without(docs, each.filter("doc_id <> rep").select("doc_id").distinct())
    missed = np.empty(0, U)
    for again in range(AGAIN + 1):
        index = spark.sparkContext.broadcast(Indexer(frequent, missed, buckets))
        postings = single.mapInPandas(lambda x, i=index: _postings(x, i.value, buckets), "bucket long, blob binary")
        lists = postings.groupBy("bucket").applyInPandas(lambda k, x: _lists(k, x, buckets), "kind int, part long, blob binary")
        found = materialize(lists.groupBy("kind", "part").applyInPandas(_candidates, "a long, b long, blob binary"), "candidates")
        more = found.filter("a is null and b is not null").select("b", "blob").toPandas()  # one row
        dense = _groups(found.filter("blob is not null and b is null"))
        few = not len(more) or more.b.sum() * MISSED <= n_docs or len(missed) >= MOST_FREQUENT
        if again == AGAIN or few or dense.filter("blocks > 1").isEmpty():
            break
        missed = np.unique(np.concatenate([missed, *(np.frombuffer(x, U) for x in more.blob)]))[:MOST_FREQUENT]
    pairs = found.filter("a is not null").select("a", "b")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(only(docs, ids).mapInPandas(_sets, "id long, hashes binary").dropDuplicates(["id"]), "sets")
    links = materialize(_linked(pairs, sets).unionByName(_work_off(dense, docs)), "links")
    roots = components(links)
    return each.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", "own", "n", F.coalesce("root", "rep").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the longest text, then the smallest
    doc_id (rows without one come last).  Rows are decided on one by one; of rows that
    share doc_id and text, any one stays."""
    columns = docs.columns
    (name,) = fresh(columns, "number")
    docs, plain = _numbered(docs, name)
    given = docs.select(F.col(name).alias("doc_id"), F.col("doc_id").cast("long").alias("own"), "text")
    classes = _rooted(given).select("doc_id", "root").distinct()
    shared = classes.groupBy("root").agg(F.count("*").alias("m")).filter("m > 1").select("root")
    # only components of several documents matter further
    classes = materialize(classes.join(shared, "root", "left_semi"), "classes")
    sized = only(given.select("doc_id", "own", F.length("text").alias("size")), classes).groupBy("doc_id").agg(F.max("size").alias("size"), F.min("own").alias("own")).join(classes, "doc_id")
    order = F.struct((-F.coalesce("size", F.lit(0))).alias("s"), F.col("own").isNull().alias("none"), "own", "doc_id")
    best = sized.groupBy("root").agg(F.min(order).alias("best")).select("best.doc_id")
    kept = without(docs, materialize(classes.select(F.col("doc_id").alias(name)).join(best.withColumnRenamed("doc_id", name), name, "left_anti"), "near"), name)
    if not plain:
        several = materialize(kept.groupBy(name).count().filter("count > 1").select(name), "twins")
        if not several.isEmpty():
            kept = without(kept, several, name).unionByName(only(kept, several, name).dropDuplicates([name]))
    return kept.select(*columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLE_SQL = {
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * p.c >= 75 * (nx.c + ny.c - p.c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT x AS a, y AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
), m AS (
  SELECT a, min(b) AS b FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
""",
}
