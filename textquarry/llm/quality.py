"""Quality classifier by compression.

Two zstandard dictionaries are built from texts labelled good and bad, cut into
pieces.  A text is compressed whole with each; the difference of the two sizes, over
the size of the text, says which of the two it resembles.  A logistic curve of this
one number, fitted on other labelled texts, makes it a probability.

Both fits use a bounded sample of labelled rows (SAMPLE per label, the smallest
hashes of doc_id; of their pieces PIECES per label, evenly drawn); how common the
labels are is counted over all labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_crc, read, small_batches

#: Labelled documents of each label that are learned from, at most; one in so many of them for the curve, the others for the dictionary.
SAMPLE, CURVE = 1600, 4
#: Bytes of a piece, and pieces that a dictionary is built from, at most.
PIECE, PIECES = 500, 8000
DICT_BYTES = 64 << 10
LEVEL = 3


def _dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on pieces, or the texts themselves where they are too few to train on."""
    places = [(t, i) for t in texts for i in range(0, len(t), PIECE)]
    texts = [t[i : i + PIECE] for t, i in places[:: -(-len(places) // PIECES) or 1]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(texts)[-DICT_BYTES:] or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Model:
    """Dictionaries and curve; picklable, the compressors are made on first use."""

    def __init__(self, good: list[bytes], bad: list[bytes], n_good: int, n_bad: int):
        dictionaries = (_dictionary([t for i, t in enumerate(x) if i % CURVE]) for x in (good, bad))
        self.dicts = [(d.as_bytes(), d.dict_id() == 0) for d in dictionaries]
        self.curve = np.zeros(2)
        good, bad = good[::CURVE], bad[::CURVE]
        if good or bad:
            self.curve = self._fit(good, bad, n_good, n_bad)

    def __getstate__(self) -> dict:
        return {"dicts": self.dicts, "curve": self.curve}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if "made" not in self.__dict__:
            self.made = []
            for data, raw in self.dicts:
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
                d.precompute_compress(level=LEVEL)
                self.made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self.made

    def features(self, text: bytes) -> tuple[float, float]:
        """The normalised difference (above 0: the good dictionary serves better), and a constant."""
        good, bad = (len(c.compress(text)) for c in self._compressors())
        return 100 * (bad - good) / (len(text) + 16), 1.0

    def _fit(self, good: list[bytes], bad: list[bytes], n_good: int, n_bad: int) -> np.ndarray:
        """Newton steps of a logistic regression, rows weighted to the labels' true shares."""
        x = np.array([self.features(t) for t in good + bad])
        y = np.array([1.0] * len(good) + [0.0] * len(bad))
        w = np.array([n_good / max(1, len(good))] * len(good) + [n_bad / max(1, len(bad))] * len(bad))
        w, b, ridge = w / w.sum() * len(w), np.zeros(x.shape[1]), 0.01 * np.eye(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
            b = b + np.clip(np.linalg.solve(hess, x.T @ (w * (y - p)) - ridge @ b), -5, 5)
        return b

    def score(self, text: bytes) -> float:
        z = sum(a * x for a, x in zip(self.curve.tolist(), self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labels (doc_id, quality) and the texts they point to.

    Labels that are null, other than 0 or 1, or without a document are skipped;
    a null text counts as empty.  Without labels every score is one half."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality in (0, 1) and doc_id is not null").distinct()
    n = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    samples = [marks.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    # the sample has at most 2 * SAMPLE rows of two numbers
    sample = F.broadcast(samples[0].unionByName(samples[1]))
    texts: dict[int, list[tuple]] = {0: [], 1: []}
    for r in docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").toLocalIterator():
        texts[r["quality"]].append((r["doc_id"], r["text"].encode()))
    good, bad = ([t for _, t in sorted(texts[q])] for q in (1, 0))
    return Model(good, bad, n.get(1, 0), n.get(0, 0))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), predicted (1 if score >= 0.5).

    Null texts are scored as empty ones.  Every row gets its score, repeated rows
    the same; a null doc_id stays null; other columns are ignored."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            score = np.array([shared.value.score(t.encode() if isinstance(t, str) else b"") for t in rows.text])
            yield pd.DataFrame({"doc_id": rows.doc_id.astype("Int64"), "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(bucket_crc("doc_id", 3) != 1))
    held_out = F.coalesce(bucket_crc("doc_id", 3) == 1, F.lit(False))
    return classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op4_quality": op4_quality}
