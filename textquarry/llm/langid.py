"""Language identification by prediction by partial matching.

Per language a tree of byte contexts, of up to ORDER bytes, holds the counts of
the bytes that followed.  A byte is coded in the longest context that the tree
has; one that was not seen there costs an escape and is coded in the next shorter
context, without the bytes already ruled out.  The statistics are frozen after
learning, so every context's code lengths are worked out once, and a text's exact
code length under each language is a sum of table entries.

The tree has one shape for all languages.  It is grown from the root, the most
frequent contexts first, as long as the table of all contexts, bytes and
languages has at most ENTRIES entries; so what the driver gathers and the
executors get is bounded however large the corpus.  Counts come from every
labelled document of the learning part: three bytes in a row in a first pass,
then what follows the contexts of three and of four bytes that the tree has.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, bucket_crc, materialize, read, small_batches, text_key, without_rows

#: Bytes of the longest context.
ORDER = 4
#: Bytes that stand before a text's first byte.
START = b"\n" * ORDER
#: Entries of the table of code lengths, at most (beyond contexts of one byte).
ENTRIES = 1 << 21
#: A context of two bytes or more is in the tree if it was seen so often.
GROW = 16
#: Bytes coded at a time.
CHUNK = 1 << 20
#: Characters whose contexts are counted at a time.
HELD = 16 << 20
LETTER = re.compile(r"[^\W\d_]")


def _fold() -> tuple[bytes, int]:
    """Bytes to symbols: letters without case, digits as one, controls as one."""
    table, ids = bytearray(256), {}
    for b in range(256):
        c = b | 0x20 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 10 if b < 32 or b == 127 else b
        table[b] = ids.setdefault(c, len(ids))
    return bytes(table), len(ids)


FOLD, ALPHABET = _fold()


class Tree:
    """Contexts as nodes: the root is the empty one, a child has one byte more before it.

    symbols: those that were seen in learning; all others count as one more."""

    def __init__(self, symbols: list[int]):
        self.size = len(symbols) + 1
        self.place = np.full(ALPHABET, self.size - 1)
        self.place[symbols] = np.arange(len(symbols))
        self.fold = bytes(self.place[np.frombuffer(FOLD, np.uint8)].astype(np.uint8))
        self.parent, self.symbol, self.order = [-1], [-1], [0]
        self.begins = [0, 1]  # of the nodes of each order
        self.child = np.full((1, self.size), -1, np.int32)

    def grow(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Nodes of the next order: children of nodes by the byte before."""
        new = np.arange(len(parents)) + len(self.parent)
        self.child = np.concatenate([self.child, np.full((len(new), self.size), -1, np.int32)])
        self.child[parents, symbols] = new
        order = len(self.begins) - 1
        self.parent += parents.tolist()
        self.symbol += symbols.tolist()
        self.order += [order] * len(new)
        self.begins.append(len(self.parent))

    def nodes(self, s: np.ndarray) -> np.ndarray:
        """The longest context of each symbol from the ORDER-th on."""
        n = len(s) - ORDER
        flat, node, alive = self.child.ravel(), np.zeros(n, np.int32), None
        for k in range(1, len(self.begins) - 1):
            to = flat[node * self.size + s[ORDER - k : ORDER - k + n]]
            alive = to > 0 if alive is None else alive & (to > 0)
            node = np.where(alive, to, node)
        return node

    def context(self, node: int) -> tuple[int, ...]:
        """A node's symbols in the order of the text."""
        out = []
        while node:
            out.append(self.symbol[node])
            node = self.parent[node]
        return tuple(out)


def symbols_of(texts: list[bytes], fold: bytes) -> np.ndarray:
    """START before each text, all in a row."""
    return np.frombuffer((START + START.join(texts)).translate(fold), np.uint8).astype(np.int32)


def of_texts(texts: list[bytes]) -> np.ndarray:
    """Of the symbols from the ORDER-th on: which are of a text, not of a START."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    turn = np.column_stack([sizes, np.full(len(sizes), ORDER)]).ravel()
    return np.repeat(np.tile([True, False], len(sizes)), turn)[: int(turn.sum()) - ORDER]


def grams(texts: list[bytes], size: int = ALPHABET) -> np.ndarray:
    """Codes of all symbols of the texts with the two before them."""
    s = symbols_of(texts, FOLD)[ORDER - 2 :]
    return ((s[:-2] * size + s[1:-1]) * size + s[2:])[of_texts(texts)]


def _count(labelled: DataFrame, codes: Callable[[list[bytes]], np.ndarray], most: int) -> DataFrame:
    """lang, code, n: how often each code below `most` stands in the texts of each language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: defaultdict[str, list[bytes]] = defaultdict(list)
        size = 0

        def counted() -> Iterator[pd.DataFrame]:
            for lang, texts in held.items():
                n = np.bincount(codes(texts), minlength=most)
                seen = np.flatnonzero(n)
                if len(seen):
                    yield pd.DataFrame({"lang": lang, "code": seen, "n": n[seen]})
            held.clear()

        for rows in batches:
            for lang, text in zip(rows.lang, rows.text, strict=True):
                held[lang].append(text.encode(errors="replace"))
                size += len(text)
            if size > HELD:
                yield from counted()
                size = 0
        yield from counted()

    part = labelled.mapInPandas(run, "lang string, code long, n long")
    return part.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in each context (row): counts with an escape of the number
    of distinct symbols; the escape is shared by the unseen ones as in shorter."""
    seen = counts > 0
    n, kinds = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    rest = np.where(seen, 0.0, shorter)
    left = rest.sum(1, keepdims=True)
    total = n + np.where(left > 0, kinds, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / total + np.where(left > 0, kinds / total * (rest / left), 0)
    return np.where(n > 0, p, shorter)


def has_letter(text: str | None) -> bool:
    """The pattern also finds numerals that are no digits, such as fractions."""
    m = LETTER.search(text) if text else None
    return m is not None and (m[0].isalpha() or any(map(str.isalpha, text)))


class Model:
    """Code lengths (bits) of symbol after context, for all languages, over the symbols seen in learning."""

    def __init__(self, langs: list[str], tree: Tree | None = None, counts: pd.DataFrame | None = None):
        """counts: lang (its number), node, symbol, n for all nodes."""
        self.langs, self.tree = langs, tree
        if not langs:
            return
        n_nodes, size = len(tree.parent), tree.size
        self.bits = np.zeros((n_nodes * size, len(langs)), np.float32)
        parent = np.array(tree.parent)
        slot = counts.node.to_numpy(np.int64) * size + counts.symbol.to_numpy(np.int64)
        for i in range(len(langs)):
            own = counts.lang.to_numpy() == i
            n = np.bincount(slot[own], counts.n.to_numpy()[own], n_nodes * size).reshape(n_nodes, size)
            p = np.empty((n_nodes, size))
            p[:1] = _blend(n[:1], np.full((1, size), 1 / size))
            for a, b in zip(tree.begins[1:-1], tree.begins[2:], strict=True):
                p[a:b] = _blend(n[a:b], p[parent[a:b]])
            self.bits[:, i] = -np.log2(np.maximum(p, 1e-30)).ravel()

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        joined = START + START.join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes + ORDER) - sizes - ORDER  # of the codes of a text
        n = len(joined) - ORDER
        for lo in range(0, n, CHUNK):
            hi = min(n, lo + CHUNK)
            s = np.frombuffer(joined[lo : hi + ORDER].translate(self.tree.fold), np.uint8).astype(np.int32)
            bits = self.bits.take(self.tree.nodes(s) * self.tree.size + s[ORDER:], axis=0)
            first, last = np.searchsorted(begins + sizes, lo, "right"), np.searchsorted(begins, hi, "left")
            for k in range(first, last):  # texts that reach into the chunk
                a, b = max(begins[k], lo) - lo, min(begins[k] + sizes[k], hi) - lo
                if b > a:
                    out[k] += bits[a:b].sum(0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        usable = [has_letter(t) and bool(self.langs) for t in texts]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits = self.code_lengths([t.encode(errors="replace") if u else b"" for t, u in zip(texts, usable, strict=True)])
        best = bits.argmin(1)
        odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        return [self.langs[b] if u else "und" for b, u in zip(best, usable, strict=True)], [1 / o if u else 0.0 for o, u in zip(odds, usable, strict=True)]


def _second(counts: DataFrame, tree: Tree, room: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The contexts of two and three bytes that are seen most, at most `room` of them: order, code, n;
    and lang, code, n of all bytes after those of two."""
    two = counts.groupBy(F.floor(F.col("code") / ALPHABET).alias("context")).agg(F.sum("n").alias("n"))
    three = counts.groupBy(F.col("code").alias("context")).agg(F.sum("n").alias("n"))
    both = two.select(F.lit(2).alias("order"), "context", "n").unionByName(three.select(F.lit(3).alias("order"), "context", "n"))
    found = both.filter(F.col("n") >= GROW).orderBy(F.desc("n"), "order", "context").limit(room).toPandas()
    known = counts.sparkSession.createDataFrame([(int(c),) for c in found.context[found.order == 2]], "context long")
    own = counts.withColumn("context", F.floor(F.col("code") / ALPHABET)).join(F.broadcast(known), "context", "left_semi")  # at most ALPHABET ** 2
    return found, own.select("lang", "code", "n").toPandas()


def fit(docs: DataFrame) -> Model:
    """The model of docs (text, lang); rows without either are passed over."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.filter("text is not null and lang is not null").select("lang", "text")
    counts = materialize(_count(labelled, grams, ALPHABET**3), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([])
    counts = _numbered(counts, langs)
    one = counts.groupBy("lang", (F.col("code") % ALPHABET**2).alias("code")).agg(F.sum("n").alias("n")).toPandas()
    code = one.code.to_numpy(np.int64)
    tree = Tree(np.unique(np.concatenate([code // ALPHABET, code % ALPHABET, [FOLD[START[0]]]])).tolist())
    place, size = tree.place, tree.size
    rows = []

    def keep(found: pd.DataFrame, node: np.ndarray, symbol: np.ndarray) -> None:
        rows.append(pd.DataFrame({"lang": found.lang.to_numpy(np.int32), "node": np.asarray(node, np.int32), "symbol": np.asarray(symbol, np.int16), "n": found.n.to_numpy(np.int64)}))

    keep(one, np.zeros(len(one), np.int64), place[code % ALPHABET])
    firsts = np.unique(place[code // ALPHABET])
    tree.grow(np.zeros(len(firsts), np.int64), firsts)
    keep(one, tree.child[0, place[code // ALPHABET]], place[code % ALPHABET])
    room = max(0, ENTRIES // (size * len(langs)) - len(tree.parent))
    found, two = _second(counts, tree, room * 3 // 4)
    own = np.sort(found.context[found.order == 2].to_numpy(np.int64))
    tree.grow(tree.child[0, place[own % ALPHABET]], place[own // ALPHABET])
    code = two.code.to_numpy(np.int64)
    at = lambda a, b: tree.child[tree.child[0, place[b]], place[a]]  # noqa: E731  the node of two bytes
    keep(two, at(code // ALPHABET**2, code // ALPHABET % ALPHABET), place[code % ALPHABET])
    own = np.sort(found.context[found.order == 3].to_numpy(np.int64))
    parents = at(own // ALPHABET % ALPHABET, own % ALPHABET)
    tree.grow(parents[parents > 0], place[own // ALPHABET**2][parents > 0])
    three = _after(labelled, tree, langs)
    keep(three, three.node, three.symbol)
    # contexts of four bytes: one of three and what follows it, if the last three are a context too
    total = three.groupby(["node", "symbol"], as_index=False).n.sum().sort_values(["n", "node", "symbol"], ascending=[False, True, True])
    total = total[total.n >= GROW]
    back = np.array([tree.context(x) for x in total.node.unique()], np.int64).reshape(-1, 3)
    back = dict(zip(total.node.unique().tolist(), back.tolist(), strict=True))
    abc = np.array([back[x] for x in total.node], np.int64).reshape(-1, 3)
    tail = tree.child[0, total.symbol.to_numpy(np.int64)]
    for k in (2, 1):
        tail = np.where(tail > 0, tree.child[np.maximum(tail, 0), abc[:, k]], -1)
    good = np.flatnonzero(tail > 0)[: room - room * 3 // 4]
    tree.grow(tail[good], abc[good, 0])
    four = _after(labelled, tree, langs)
    keep(four, four.node, four.symbol)
    return Model(langs, tree, pd.concat(rows, ignore_index=True))


def _numbered(counts: DataFrame, langs: list[str]) -> DataFrame:
    """Languages by their numbers: a name a row would take more memory than all else."""
    return counts.withColumn("lang", (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int"))


def _after(labelled: DataFrame, tree: Tree, langs: list[str]) -> pd.DataFrame:
    """lang (its number), node, symbol, n: what follows the longest contexts of the tree; bounded by its entries."""
    first, size = tree.begins[-2], tree.size
    n = len(tree.parent) - first
    if n == 0:
        return pd.DataFrame({"lang": np.empty(0, np.int32), "node": np.empty(0, np.int64), "symbol": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
    shared = labelled.sparkSession.sparkContext.broadcast(tree)

    def codes(texts: list[bytes]) -> np.ndarray:
        own = shared.value
        s, counts = symbols_of(texts, own.fold), of_texts(texts)
        out = []
        for lo in range(0, len(s) - ORDER, CHUNK):
            part = s[lo : lo + CHUNK + ORDER]
            node = own.nodes(part)
            deep = (node >= first) & counts[lo : lo + CHUNK]
            out.append((node[deep] - first).astype(np.int64) * size + part[ORDER:][deep])
        return np.concatenate(out or [np.empty(0, np.int64)])

    found = _numbered(_count(labelled, codes, n * size), langs).toPandas()
    return found.assign(node=found.code // size + first, symbol=found.code % size)


def identify(docs: DataFrame, model: Model, *keys: tuple[str, Column]) -> DataFrame:
    """doc_id, lang_pred, score: the language of the shortest code, and its share
    among all languages of two to the power of minus the code length.

    Null texts and texts without a letter give ``und`` and 0, as does a model that
    learned from nothing.  Every row gets its answer, repeated ones too; doc_id
    may be null.  Other columns are ignored.  Equal code lengths: the first
    language in alphabetical order.  keys: further columns (long), kept as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(n for n, _ in keys)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            lang, score = shared.value.predict([t if isinstance(t, str) else None for t in rows.text])
            yield pd.DataFrame({**{n: rows[n].astype("Int64") for n in names}, "lang_pred": lang, "score": score})

    schema = ", ".join(f"{n} long" for n in names) + ", lang_pred string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(n) for n, c in keys)).mapInPandas(run, schema)


def learning_part(docs: DataFrame) -> DataFrame:
    return docs.filter(bucket_crc("doc_id", 4) != 2)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, fit(learning_part(docs)))
    held_out = F.coalesce(bucket_crc("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language cannot be told (``und``); each row is
    decided on by its own text, whatever others share its identifier."""
    found = identify(docs, fit(learning_part(docs)), ("key", text_key())).filter("lang_pred = 'und'")
    return without_rows(docs, materialize(found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "key"), "und"))


QUERIES = {"op10_langid": op10_langid}
