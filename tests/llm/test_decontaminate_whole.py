"""Words taken in the short way, and retrieval among the segments left open, lose nothing."""

import collections
import sys

import pandas as pd

from textquarry.llm import decontaminate


def test_words_are_those_of_the_pattern():
    odd = ["", "  ", "ÀÉ_1²¼\x85\xa0ß µª·÷×\x1c9", "naïve Œuvre — “quoted” ’tis", "İstanbul ǅ", "a\ud800b", "日本 語x"]
    odd += [f"{c}x{c}{c.upper()} {c}" for c in map(chr, range(sys.maxunicode + 1)) if ord(c) < 0x3000 or ord(c) % 97 == 0]
    for text in odd:
        assert decontaminate.words(text) == decontaminate.TOKEN.findall(text.lower())
    assert decontaminate.words(None) == []


def test_retrieval_among_segments_left_open(sf, monkeypatch):
    docs = pd.read_parquet(f"{sf}/documents.parquet").text.fillna("")
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    df = collections.Counter(t for text in docs for t in set(decontaminate.words(text)))
    index = decontaminate.Index(list(zip(items.item_id, items.text, strict=True)), df, len(docs))
    steps = [0]

    def counted(*x, find=decontaminate.bisect_left):
        steps[0] += 1
        return find(*x)

    monkeypatch.setattr(decontaminate, "bisect_left", counted)
    found, took = 0, []
    words = [decontaminate.words(text) for text in docs]
    for passage in [w[at : at + decontaminate.PASSAGE] for w in words for at in range(0, len(w), decontaminate.STEP)]:
        terms = {t for t in passage if t in index.ids}
        among = index.may_reach({t for t in terms if t in index.heavy})
        if not among:
            continue
        steps[0] = 0
        every = index.query(list(terms))
        took.append([steps[0], 0])
        steps[0] = 0
        assert index.query(list(terms), among=among) == every and set(every) <= set(among)
        took[-1][1] = steps[0]
        some = among[::2]
        assert index.query(list(terms), among=some) == {n: x for n, x in every.items() if n in some}
        found += len(every)
    assert found and sum(b for _, b in took) < 0.5 * sum(a for a, _ in took)
