"""Passages of over 50 words that several documents hold: of 400 bytes and more they go whole, shorter ones stay."""

import hashlib
import random

from textquarry.llm import suffix_dedup


def test_passages_of_over_50_words(spark):
    rng = random.Random(8)
    words = lambda n, least, most: " ".join("".join(rng.choices("abcdeé", k=rng.randint(least, most))) for _ in range(n))
    texts, want = {}, {}
    for k in range(20):
        long = k % 2 == 0
        passage = f" {words(rng.randint(60, 90), 7, 9) if long else words(rng.randint(51, 60), 3, 4)} "
        assert (len(passage.encode()) >= 400) == long
        for copy in range(3):  # what stands beside it differs
            before, after = f"{words(80, 3, 9)}{copy}", f"{copy}{words(80, 3, 9)}"
            texts[len(texts)] = before + passage + after
            kept = before + after if long else before + passage + after
            want[len(want)] = (len((before + passage + after).encode()), len(passage.encode()) if long else 0, int(long), hashlib.sha256(kept.encode()).hexdigest())
    for _ in range(60):  # documents that hold none
        texts[len(texts)] = clean = words(160, 3, 9)
        want[len(want)] = (len(clean.encode()), 0, 0, hashlib.sha256(clean.encode()).hexdigest())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()} == want
