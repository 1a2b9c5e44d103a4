"""Benchmark decontamination: an inverted index of test items, queried by every passage.

The question (all lines but the last) and the answer (the last line) of each
test item are cut into segments of SEGMENT words, whose words are indexed with their
BM25 weights, in blocks with the largest weight of each.  How rare a word is, is
counted over all training documents, how long a segment is, over all items.

A document holds an item if it has OVERLAP of the five-word shingles of the question
or of the answer.  Then at least one segment lacks no more than a certain number of
its words; the part of its own score that is left if those were its heaviest is the
segment's threshold, by which its weights are divided.  Every passage of every
training document is a query; block-max WAND finds all segments that reach their
thresholds.  What a document of several passages holds spread over them is found by
adding up its words' weights.  Items found are verified by their shingles.

The index holds test items only.  Items are indexed ITEMS_AT_ONCE at a time, so
what goes to the executors is bounded however many there are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, materialize, read, small_batches, text_key, without_rows

TOKEN = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Words of an indexed segment, of a passage, and from one passage to the next: a segment lies whole in some passage.
SEGMENT, PASSAGE, STEP = 64, 128, 64
#: Of a segment's heaviest words, which are looked at first, those in the text make up at least this part of its own score.
HEAVY = 0.15
#: Words of a shingle; part of the question's or answer's shingles that must be found.
SHINGLE, OVERLAP = 5, 0.75
#: An answer of fewer words proves nothing by itself.
ANSWER_WORDS = 8
#: Postings of a block.
BLOCK = 32
#: Items of an index.
ITEMS_AT_ONCE = 20_000


#: The characters of Latin-1, a space for those that no word holds.
_LATIN = bytes(i if TOKEN.match(chr(i)) else 32 for i in range(256))


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    try:  # the same words, in a third of the time
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return TOKEN.findall(text)


def shingles(w: list[str]) -> set[tuple]:
    """Distinct five-word shingles; of fewer words, all of them as one."""
    return set(zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else {tuple(w)} if w else set()


def parts(text: str) -> list[list[str]]:
    """Words of the question and, where long enough to count, of the answer; of both
    together, where the question is too short for a shingle."""
    question, _, answer = text.strip().rpartition("\n")
    q, a = words(question), words(answer)
    if len(q) < SHINGLE:
        return [x for x in (q + a,) if x]
    return [q, a] if len(a) >= ANSWER_WORDS else [q]


def segments_of(w: list[str]) -> list[list[str]]:
    return [w[at : at + SEGMENT] for at in range(0, max(1, len(w) - SEGMENT // 2), SEGMENT // 2)]


def lacking(w: list[str], n_segments: int) -> int:
    """How many words at most the fullest segment of a part lacks in a document that holds the part.

    Every missing word takes a shingle, and a word stands in two segments at most."""
    n = len(shingles(w))
    gone = n - math.ceil(OVERLAP * n)
    return gone if n_segments == 1 else 2 * gone // n_segments


class Index:
    """BM25 impacts, as parts of each segment's threshold.

    df, n_docs: in how many of the training documents a word occurs; mean: words of a segment."""

    def __init__(self, items: list[tuple[int, str | None]], df: dict[str, int], n_docs: int, mean: float | None = None):
        self.item, self.parts, segments, lack = [], {}, [], []
        for i, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
            for w in parts(text or ""):
                self.parts.setdefault(i, []).append(shingles(w))
                own = segments_of(w)
                segments += map(Counter, own)
                self.item += [i] * len(own)
                lack += [lacking(w, len(own))] * len(own)
        mean = mean or sum(map(Counter.total, segments)) / max(1, len(segments))
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.heavy: dict[str, list[tuple[int, float]]] = {}
        self.need: list[float] = []
        for n, (s, gone) in enumerate(zip(segments, lack, strict=True)):
            norm = K1 * (1 - B + B * s.total() / mean)
            impact = {t: math.log(1 + (max(0, n_docs - df.get(t, 0)) + 0.5) / (df.get(t, 0) + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in s.items()}
            own = sum(impact.values())
            ranked = sorted(impact.items(), key=lambda y: (-y[1], y[0]))
            lost = sum(x for _, x in ranked[:gone]) / own
            least = max(1 - lost, 1e-6)
            for t, x in impact.items():
                lists[t].append((n, x / own / least))
            # the heaviest words; without `need` of them the others cannot reach the threshold
            high = 0.0
            for t, x in ranked:
                if high >= lost + HEAVY:
                    break
                high += x / own
                self.heavy.setdefault(t, []).append((n, x / own))
            self.need.append(high - lost - 1e-9)
        self.ids = {t: [n for n, _ in x] for t, x in lists.items()}
        self.impacts = {t: [w for _, w in x] for t, x in lists.items()}
        self.last = {t: [x[min(i + BLOCK, len(x)) - 1] for i in range(0, len(x), BLOCK)] for t, x in self.ids.items()}
        self.top = {t: [max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for t, x in self.impacts.items()}
        self.most = {t: max(x) for t, x in self.impacts.items()}
        self.packed = {t: (np.array(x, np.int32), np.array(self.impacts[t])) for t, x in self.ids.items()}

    def may_reach(self, terms: set[str]) -> list[int]:
        """Segments, ascending, that the heavy words among terms leave open to be retrieved: no other one can be."""
        have: dict[int, float] = {}
        for t in terms:
            for n, x in self.heavy[t]:
                have[n] = have.get(n, 0.0) + x
        need = self.need
        return sorted(n for n, x in have.items() if x >= need[n])

    def added_up(self, terms: set[str], least: float = 1 - 1e-9) -> list[int]:
        """All segments that reach least, by adding up the weights of all terms."""
        own = [self.packed[t] for t in terms if t in self.packed]
        if not own:
            return []
        total = np.bincount(np.concatenate([n for n, _ in own]), np.concatenate([x for _, x in own]))
        return np.flatnonzero(total >= least).tolist()

    def query(self, terms: list[str], least: float = 1 - 1e-9, among: list[int] | None = None) -> dict[int, float]:
        """All segments (of those among, ascending) that reach least, with their scores (block-max WAND)."""
        found = {}
        cursors = [[self.ids[t][0], 0, t] for t in sorted(terms)]  # segment, place, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            if among is not None:
                k = bisect_left(among, doc)
                if k == len(among):
                    break
                if among[k] > doc:  # no segment before the next one asked for
                    cursors = self._moved(cursors, among[k])
                    continue
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # the blocks that would hold doc, and the first segment beyond the nearest block end
            bound, beyond = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 62
            for _, _, t in cursors[: pivot + 1]:
                b = bisect_left(self.last[t], doc)
                if b < len(self.last[t]):
                    bound += self.top[t][b]
                    beyond = min(beyond, self.last[t][b] + 1)
            if bound < least:
                target = max(beyond, doc + 1)
            elif cursors[0][0] == doc:
                score = sum(self.impacts[t][at] for n, at, t in cursors[: pivot + 1] if n == doc)
                if score >= least:
                    found[doc] = score
                target = doc + 1
            else:
                target = doc
            cursors = self._moved(cursors[: pivot + 1], target) + cursors[pivot + 1 :]
        return found

    def _moved(self, cursors: list[list], target: int) -> list[list]:
        """The cursors at segment target or beyond; those that have ended are left out."""
        moved = []
        for c in cursors:
            if c[0] < target:
                ids = self.ids[c[2]]
                at = bisect_left(ids, target, c[1])
                if at == len(ids):
                    continue
                c[0], c[1] = ids[at], at
            moved.append(c)
        return moved

    def matches(self, text: str | None) -> list[tuple[int, float]]:
        """Items whose question or answer the text holds, with the larger part held."""
        w = words(text)
        at = [(i, t) for i, t in enumerate(w) if t in self.heavy]
        if not at:
            return []
        items, last, passages = set(), max(0, -(-(len(w) - PASSAGE) // STEP)), defaultdict(set)
        for i, t in at:
            for k in {min(max(0, i // STEP - 1), last), min(i // STEP, last)}:
                passages[k].add(t)
        for k, terms in sorted(passages.items()):
            if among := self.may_reach(terms):
                items.update(self.item[n] for n in self.query([t for t in set(w[k * STEP : k * STEP + PASSAGE]) if t in self.ids], among=among))
        if last and self.may_reach({t for _, t in at}):
            items.update(self.item[n] for n in self.added_up(set(w)))
        if not items:
            return []
        own = shingles(w)
        found = [(i, max(len(p & own) / len(p) for p in self.parts[i])) for i in sorted(items)]
        return [(i, x) for i, x in found if x >= OVERLAP]


def document_frequency(docs: DataFrame, vocabulary: frozenset[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary occurs, over all of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for rows in batches:
            for t in rows.text:
                total.update(shared.value.intersection(words(t if isinstance(t, str) else None)))
        if total:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    counts = docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


def mean_length(items: DataFrame) -> float:
    """Words of a segment, over all of items (text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = [len(x) for t in rows.text if isinstance(t, str) for w in parts(t) for x in segments_of(w)]
            yield pd.DataFrame({"segments": [len(own)], "words": [sum(own)]})

    n, total = items.select("text").mapInPandas(run, "segments long, words long").agg(F.sum("segments"), F.sum("words")).first()
    return total / n if n else 1.0


def find_items(docs: DataFrame, benchmark: DataFrame, *keys: tuple[str, Column]) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, item_ids (ascending), overlap
    (the largest part of a question or answer found; 0 without a find).

    Words are runs of letters, digits and underscores in lower case.  Texts and
    items that are null or hold no word match nothing; items without item_id are
    skipped, repeated ones count once; repeated documents are reported each time;
    a null doc_id stays null; other columns are ignored.  An empty benchmark leaves
    every document clean.  keys: further columns (long), kept as they are."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    rounds = max(1, -(-items.count() // ITEMS_AT_ONCE))
    mean = mean_length(items)
    shard = F.pmod(F.xxhash64("item_id"), F.lit(rounds))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(n) for n, c in keys))
    if rounds > 1:  # numbered once, so that every round sees the same numbers
        docs = materialize(docs.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{n} long" for n in names) + ", item_ids array<long>, overlap double"
    out, n_docs = None, docs.count()
    for k in range(rounds):
        batch = [(r["item_id"], r["text"]) for r in items.filter(shard == k).collect()]
        df = document_frequency(docs, frozenset(t for _, text in batch for t in words(text)))
        shared = spark.sparkContext.broadcast(Index(batch, df, n_docs, mean))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for rows in batches:
                found = [shared.value.matches(t if isinstance(t, str) else None) for t in rows.text]
                frame = pd.DataFrame({n: rows[n].astype("Int64") for n in names})
                frame["item_ids"] = [[i for i, _ in f] for f in found]
                frame["overlap"] = [max((x for _, x in f), default=0.0) for f in found]
                yield frame

        part = docs.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if rounds > 1:
        out = out.groupBy(*names).agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("overlap").alias("overlap"))
    return out.select("doc_id", *(n for n, _ in keys), (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "overlap")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a test item; each row is decided on by its own text."""
    found = find_items(docs, benchmark, ("key", text_key())).filter("contaminated")
    return without_rows(docs, materialize(found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "key"), "leaks"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
