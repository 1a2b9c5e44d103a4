"""Language-model scores of all documents.

The base score is that of a smoothed unigram model, with exact counts over all
training documents.  Documents are dealt into chunks; a chunk sends its distinct
words (64-bit hashes) and their training counts, packed, to the hash's bucket,
which adds up and sends the totals back to each chunk in the same order.  So a
word crosses the network once per chunk, and no task holds the corpus's words.

The score mixes, word by word, that model with the causal self-attention model of
attention.py over subword ids, which knows what the words before are and how
words are made; UNIGRAM is the part of the former.  The attention model's
tree and rows come from the subword counts of all training documents, which the
chunks send along with their words.  Its first weights, and which tokens stand
beside each other in the tree, come from a bounded sample (INIT_DOCS documents).
It is then trained on the executors on all context windows of all training
documents, which the chunks send along too.  Each chunk's windows train a copy of the weights, and the
copies are averaged, by the tokens they have seen, in a tree of merges.

Chunks are dealt by a hash of identifier and text and read in the order of that
hash, so the scores do not depend on how the input is laid out.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import kernel
from .attention import STEP, TOKENIZER, WINDOW, Model, Tokens, n_windows
from .common import bucket_crc, materialize, parts, read, small_batches

#: Bytes of text of a chunk, about.
CHUNK_BYTES = 20 << 20
#: Training documents that the first weights and the neighbours in the tree come from, at most.
INIT_DOCS, INIT_PASSES = 1000, 2
#: Of the windows of all training documents, one in so many trains the weights: all of them.
SHARE = 1
#: Bytes of windows that go together; pieces of a chunk's windows, at most.
PIECE_BYTES, PIECES = 1 << 16, 64
#: Bytes of text whose words one bucket adds up, about.
BUCKET_BYTES = 256 << 20
UNIGRAM = 0.4
RATE = 0.8
FAN = 8

_tokens: dict[str, Tokens] = {}


def tokenizer(path: str) -> Tokens:
    """One per worker."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if isinstance(text, str) else []


def ids_of(tokens: Tokens, text: str | None) -> np.ndarray:
    return np.fromiter((i for w in tokens.text(words(text)) for i in w), np.int64)


#: Stands for the end among words: no word holds a space.
END = b" end"


def _indexed(texts) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of some texts, the end among them, and each text as their numbers, the end last."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    out = []
    for t in texts:
        w = words(t)
        w.append(END)
        out.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
    return list(number), out


def _places(vocabulary: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the words by bucket and hash, their hashes and buckets in that order."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    return order, h[order], bucket[order]


def _places_in(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, length of them, for each in turn."""
    ends = np.cumsum(length)
    return np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)


#: Tokens whose windows are cut out at a time, about.
TOKENS_AT_ONCE = 1 << 17


def _windows(rows: pd.DataFrame, texts: list[np.ndarray], flat: np.ndarray, begin: np.ndarray, length: np.ndarray, share: int) -> np.ndarray:
    """The windows, one in share of each text's, of a chunk's training texts, in the order of the rows' hashes."""
    order = rows.order.to_numpy()
    who = np.lexsort((rows.doc_id.fillna(0).to_numpy(), order))
    who = who[rows.train.to_numpy(bool)[who]]
    size = np.array([length[texts[i]].sum() for i in who.tolist()], np.int64)
    # of each text: the first window drawn, and how many are
    drawn = order[who] % share
    n = np.maximum(0, -((drawn - n_windows(size)) // share))
    out, done = np.empty((n.sum(), WINDOW + 2), np.int32), 0
    group = np.cumsum(size) // TOKENS_AT_ONCE
    for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(group)) + 1) if len(who) else ():
        own = np.concatenate([texts[i] for i in who[part].tolist()])
        ids = flat[_places_in(begin[own], length[own])].astype(np.int32)
        ends, each = np.cumsum(size[part]), n[part]
        starts = ends - size[part]
        t = np.repeat(np.arange(len(part)), each)
        k = drawn[part][t] + share * (np.arange(len(t)) - np.repeat(np.cumsum(each) - each, each))
        at = (starts[t] + k * STEP - 1)[:, None] + np.arange(WINDOW + 1)
        inside = (at >= starts[t][:, None]) & (at < ends[t][:, None])
        made = out[done : done + len(t)]
        made[:, 0] = k == 0
        made[:, 1:] = np.where(inside, ids[np.where(inside, at, 0)], -1)
        done += len(t)
    return out


def packed(windows: np.ndarray) -> bytes:
    """Windows in few bytes: bytes of a number and how many numbers, then the compressed numbers, -1 as 0."""
    kind = np.uint16 if windows.max(initial=0) < (1 << 16) - 1 else np.uint32
    head = np.array([np.dtype(kind).itemsize, windows.size], np.int64).tobytes()
    return head + pa.compress((windows + 1).astype(kind).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    """The bytes of the windows (int32) that packed() has taken."""
    width, n = np.frombuffer(data, np.int64, 2).tolist()
    numbers = np.frombuffer(pa.decompress(data[16:], width * n, "zstd", asbytes=True), f"u{width}")
    return (numbers.astype(np.int32) - 1).tobytes()


def _send(key: tuple, rows: pd.DataFrame, buckets: int, path: str, share: int) -> pd.DataFrame:
    """A chunk's distinct words by bucket: hashes, and counts in its training documents;
    the subword counts of these documents, dealt to the same buckets; and (in buckets
    of their own beyond the others) the windows that train the weights."""
    vocabulary, texts = _indexed(rows.text)
    n = np.zeros(len(vocabulary), np.int64)
    for x, train in zip(texts, rows.train, strict=True):
        if train:
            np.add.at(n, x, 1)
    flat, begin, length = tokenizer(path).vocabulary(vocabulary, END)
    subwords = np.bincount(flat[_places_in(begin, length)], np.repeat(n, length)).astype(np.int64)
    windows = _windows(rows, texts, flat, begin, length, share)
    pieces = [packed(x) for x in np.array_split(windows, min(PIECES, -(-windows.nbytes // PIECE_BYTES) or 1))]
    del windows, texts
    order, h, bucket = _places(vocabulary, buckets)
    n = n[order].astype(np.uint32)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    used = bucket[starts]
    # a bucket without words here would have no row: the ids go round those that have one
    ids = [np.flatnonzero(subwords)[i :: len(used)] for i in range(len(used))]
    return pd.DataFrame({
        "bucket": [*used, *(buckets + key[0] * PIECES + i for i in range(len(pieces)))],
        "chunk": key[0],
        "hashes": [x.tobytes() for x in np.split(h, starts[1:])] + [b""] * len(pieces),
        "counts": [x.tobytes() for x in np.split(n, starts[1:])] + [b""] * len(pieces),
        "subwords": [np.stack([x, subwords[x]]).tobytes() for x in ids] + [b""] * len(pieces),
        "windows": [None] * len(used) + pieces,
    })


def _pairs(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of subwords and their counts, added up, from packed ones."""
    ids, n = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in blobs], axis=1)
    each, at = np.unique(ids, return_inverse=True)
    total = np.zeros(len(each), np.int64)
    np.add.at(total, at, n)
    return each, total


def _merge_pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"totals": [np.stack(_pairs(rows.totals)).tobytes()]})


def _total(key: tuple, rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of a bucket: each chunk's totals in the order of its hashes; (chunk -1) subwords and their
    counts, beside them the numbers of tokens and of distinct words; (chunk -2) a chunk's windows, as they are."""
    if key[0] >= buckets:
        return pd.DataFrame({"chunk": -2, "bucket": [key[0] - buckets], "totals": list(rows.windows), "tokens": 0, "words": 0})
    parts_ = [np.frombuffer(x, np.uint64) for x in rows.hashes]
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.counts]).astype(np.int64)
    h = np.concatenate(parts_)
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    sums = np.add.reduceat(n[order], starts)
    back = np.empty(len(h), np.int64)
    back[order] = np.repeat(sums, np.diff(np.r_[starts, len(h)]))
    cuts = np.cumsum([len(x) for x in parts_])[:-1]
    blobs = [x.tobytes() for x in np.split(back, cuts)]
    blobs.append(np.stack(_pairs(rows.subwords)).tobytes())
    none = [0] * len(cuts) + [0]
    return pd.DataFrame({"chunk": [*rows.chunk, -1], "bucket": key[0], "totals": blobs, "tokens": [*none, sums.sum()], "words": [*none, (sums > 0).sum()]})


def _train(key: tuple, rows: pd.DataFrame, model: Model) -> pd.DataFrame:
    """The weights that a chunk's windows lead to."""
    own = pickle.loads(pickle.dumps(model))
    windows = [np.frombuffer(x, np.int32).reshape(-1, WINDOW + 2) for x in rows.sort_values("piece").windows]
    seen = own.train_on(np.concatenate(windows), RATE)
    theta = np.concatenate([p.ravel() for p in own.theta()]).astype(np.float32).tobytes()
    return pd.DataFrame({"node": [key[0]], "child": [key[0]], "seen": [seen], "theta": [theta]})[: 1 if seen else 0]


def _average(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("child")  # sums of fractions depend on their order
    total = np.zeros(len(rows.theta.iloc[0]) // 4)
    for theta, seen in zip(rows.theta, rows.seen, strict=True):
        total += np.frombuffer(theta, np.float32) * float(seen)
    seen = int(rows.seen.sum())
    return pd.DataFrame({"node": [key[0]], "child": [key[0]], "seen": [seen], "theta": [(total / seen).astype(np.float32).tobytes()]})


def first_model(docs: DataFrame, counts: np.ndarray, path: str = TOKENIZER) -> Model:
    """The tree of the subwords, which have these counts in all training documents, and first weights
    from at most INIT_DOCS of docs (order, text), those of the smallest order; null texts are empty ones.

    Without documents it is the uniform model of its tree."""
    first = docs.select(F.col("order").alias("o")).distinct().orderBy("o").limit(INIT_DOCS)
    sample = docs.join(F.broadcast(first), F.col("order") == F.col("o"), "left_semi").select("order", "text").distinct().collect()  # at most INIT_DOCS documents
    tokens = tokenizer(path)
    texts = [ids_of(tokens, r["text"]) for r in sorted(sample, key=lambda r: (r["order"], r["text"] or ""))]
    model = Model(np.concatenate(texts or [np.array([tokens.end])]), tokens.initial, counts=counts)
    for _ in range(INIT_PASSES):
        model.train(iter(texts), RATE)
    return model


def fit(docs: DataFrame, counts: np.ndarray, windows: DataFrame, path: str = TOKENIZER) -> Model:
    """The attention model: first_model(), trained on windows (node: the chunk, piece, packed, windows: unpacked)."""
    model = first_model(docs, counts, path)
    weights = "node long, child long, seen long, theta binary"
    if java := kernel.load(docs.sparkSession):
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("piece", "packed"))), lambda x: x.packed)
        trained = windows.groupBy("node").agg(pieces.alias("pieces")).select("node", java.train(model, RATE)("pieces").alias("own"))
        theta = materialize(trained, "theta").select("node", F.col("node").alias("child"), "own.seen", "own.theta").filter("seen > 0")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        theta = materialize(windows.drop("packed").groupBy("node").applyInPandas(lambda k, x: _train(k, x, shared.value), weights), "theta")
    n = (theta.agg(F.max("node")).first()[0] or 0) + 1
    while n > 1:
        n = -(-n // FAN)
        theta = theta.withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy("node").applyInPandas(_average, weights)
    if got := theta.select("theta").collect():  # one row
        flat, at = np.frombuffer(got[0]["theta"], np.float32), 0
        for p in model.theta():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
    return model


def _score(key: tuple, rows: pd.DataFrame, totals: pd.DataFrame, buckets: int, n: int, v: int, model: Model | None, path: str) -> pd.DataFrame:
    """Of a chunk's rows all but train_tokens; without a model, what the kernel makes the score of instead of it."""
    vocabulary, texts = _indexed(rows.text)
    order, _, _ = _places(vocabulary, buckets)
    counts = np.empty(len(vocabulary), np.int64)
    counts[order] = np.concatenate([np.frombuffer(x, np.int64) for x in totals.sort_values("bucket").totals])
    logs, known = np.log10(counts + 1.0) - np.log10(n + (v + 1.0)), counts > 0
    flat, begin, length = tokenizer(path).vocabulary(vocabulary, END)
    del vocabulary
    base = [logs[x].sum() for x in texts]
    n_known, size = [int(known[x].sum()) for x in texts], [len(x) for x in texts]
    out = pd.DataFrame({"doc_id": rows.doc_id.astype("Int64"), "train": rows.train, "n_tokens": size, "n_known": n_known, "base_score": base})
    if model is None:
        # few bytes: all texts of the chunk go to the JVM at once
        ids, short, logs = flat.astype(np.min_scalar_type(flat.max())), length.astype(np.min_scalar_type(length.max())), logs.astype(np.float32)
        out["ids"] = [ids[_places_in(begin[x], length[x])].tobytes() for x in texts]
        out["sizes"], out["logs"] = [short[x].tobytes() for x in texts], [logs[x].tobytes() for x in texts]
        return out
    score, held, own = np.zeros(len(texts)), [], []

    def flush() -> None:
        for (i, starts), (token, root) in zip(own, model.score(held), strict=True):
            # a word: its tokens, and that the next one begins a word (which its first token is known to do)
            token[starts] -= root[starts]
            lm = np.add.reduceat(token, starts)
            lm[:-1] += root[starts[1:]]
            score[i] = np.logaddexp(lm + np.log(1 - UNIGRAM), logs[texts[i]] * np.log(10) + np.log(UNIGRAM)).sum() / np.log(10)
        held.clear(), own.clear()

    pending, copies, first = 0, {}, np.arange(len(texts))
    for i, x in enumerate(texts):
        first[i] = copies.setdefault(x.tobytes(), i)
        if first[i] != i:  # the same words: the same score
            continue
        size = length[x]
        starts = np.cumsum(size) - size
        held.append(flat[_places_in(begin[x], size)])
        own.append((i, starts))
        pending += int(size.sum())
        if pending > 100_000:
            flush()
            pending = 0
    flush()
    out["score"] = score[first]
    return out


def score_texts(docs: DataFrame, learn_from, path: str = TOKENIZER, share: int = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, train, n_tokens, n_known, train_tokens,
    base_score, score.

    learn_from: condition (Column) for training documents; null counts as false.
    path: vocabulary file of a public tokenizer, which all executors must have.
    share: one in so many context windows trains the attention model, by default all.
    Words are runs of characters other than space and tab to carriage return, A-Z
    in lower case, then one end.  base_score has the smoothed unigram model's
    log10 probability, score the mixed model's, of the words joined by spaces.
    Null text is an empty text: its only token is the end.  Repeated rows count
    and are scored each time; a null doc_id stays null; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn_from, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(2, -(-size // CHUNK_BYTES)), max(parts(spark), -(-size // BUCKET_BYTES))
    # the text too, for rows without an identifier
    order = F.xxhash64(F.lit("chunk"), "doc_id", "text")
    dealt = docs.withColumn("order", order).withColumn("chunk", F.pmod("order", F.lit(chunks)))
    sent = dealt.groupBy("chunk").applyInPandas(lambda k, x: _send(k, x, buckets, path, share), "bucket long, chunk long, hashes binary, counts binary, subwords binary, windows binary")
    totals = materialize(sent.groupBy("bucket").applyInPandas(lambda k, x: _total(k, x, buckets), "chunk long, bucket long, totals binary, tokens long, words long"), "totals")
    n, v = (int(x or 0) for x in totals.agg(F.sum("tokens"), F.sum("words")).first())
    counts = np.zeros(tokenizer(path).size, np.int64)
    merged = totals.filter("chunk = -1").select((F.col("bucket") % FAN).alias("node"), "totals").groupBy("node").applyInPandas(_merge_pairs, "totals binary")
    if found := [r["totals"] for r in merged.collect()]:  # FAN rows, bounded by the tokens
        ids, each = _pairs(found)
        counts[ids] = each
    windows = totals.filter("chunk = -2").select(F.floor(F.col("bucket") / PIECES).alias("node"), (F.col("bucket") % PIECES).alias("piece"), F.col("totals").alias("packed"))
    windows = windows.withColumn("windows", F.udf(lambda x: unpacked(x), BinaryType())("packed"))  # worked out only where it is used
    model = fit(dealt.filter("train").select("order", "text"), counts, windows, path)
    both, columns = dealt.groupBy("chunk").cogroup(totals.filter("chunk >= 0").groupBy("chunk")), "doc_id long, train boolean, n_tokens long, n_known long, base_score double"
    if java := kernel.load(spark):
        scored = both.applyInPandas(lambda k, x, y: _score(k, x, y, buckets, n, v, None, path), f"{columns}, ids binary, sizes binary, logs binary")
        scored = scored.withColumn("score", java.score(model, UNIGRAM)("ids", "sizes", "logs"))
    else:
        shared = spark.sparkContext.broadcast(model)
        scored = both.applyInPandas(lambda k, x, y: _score(k, x, y, buckets, n, v, shared.value, path), f"{columns}, score double")
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_texts(read(spark, sf_dir, "documents"), bucket_crc("doc_id", 7) != 2)
    held_out = F.coalesce(bucket_crc("doc_id", 7) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_score": op9_lm_score}
