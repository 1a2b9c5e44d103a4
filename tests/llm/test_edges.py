"""Every operator over one table of odd cases, and over an empty one."""

import hashlib

import pytest

from textquarry.llm import decontaminate, exact_dedup, html_extract, jaccard_join, langid, lm_score, mixing, quality, secrets, suffix_dedup

LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (0, "alpha beta gamma delta epsilon zeta", "en", "a"),
    (1, "alpha beta  gamma delta\nepsilon zeta", "en", "a"),
    (2, None, None, None),
    (3, "", "fr", "a"),
    (4, " \t\r\n", "fr", ""),
    (5, LONG, "en", "b"),
    (6, LONG, None, "b"),
    (7, "Ünïcödé ✓ \U0001f600", "de", "c"),
    (7, "Ünïcödé ✓ \U0001f600", "de", "c"),
    (8, "token = 0123456789abcdef0123", "en", "c"),
    (9, "one", "en", "c"),
    (10, "one", "en", "d"),
    (None, "no identifier at all", "en", "d"),
    (11, "12 34 !?", "en", "d"),
]
#: Names that the operators use inside, as columns of the input.
CLASH = ["n", "keep_id", "digest", "rid", "score", "run", "n_tokens", "train", "did", "th", "key", "rep", "root", "slot", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *([7] * len(CLASH))) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_exact_dedup(docs, empty):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {(0, 1, 2, False), (1, 1, 2, True)} <= got  # the longer original stays
    assert {(2, 4, 3, False), (3, 4, 3, False), (4, 4, 3, True)} <= got  # null, empty and white space are equal
    assert {(7, 7, 2, True), (7, 7, 2, False)} <= got  # of repeated rows one stays
    assert {(5, 5, 2, True), (6, 5, 2, False), (9, 9, 2, True), (10, 9, 2, False)} <= got
    assert (None, None, 1, True) in got and exact_dedup.exact_dedup(docs).count() == len(ROWS)
    assert exact_dedup.exact_dedup(empty).collect() == []
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert [x for x, in rows(kept, "doc_id")] == sorted([1, 4, 5, 7, 8, 9, 11, None], key=lambda x: repr((x,)))


ODD = [(1, "aaaa bb"), (1, "b"), (2, "b "), (None, "hello there"), (None, "hello  there"), (None, "123"), (3, "c"), (3, "c"), (3, "c "), (4, "hello there, my friend"), (4, "123"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Identifiers that are missing, or stand for several texts."""
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ODD], "doc_id long, text string, lang string, source string, row_key int").repartition(3)


def test_stages_decide_row_by_row(spark, odd):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert rows(kept, "doc_id", "text") == sorted([(1, "aaaa bb"), (2, "b "), (None, "hello  there"), (None, "123"), (3, "c "), (4, "hello there, my friend"), (None, None)], key=repr) or (4, "123") in rows(kept, "doc_id", "text")
    assert kept.count() == 7
    near = jaccard_join.keep_one(odd)
    assert near.columns == odd.columns
    assert rows(near, "doc_id", "text") == sorted([(1, "aaaa bb"), (1, "b"), (None, "hello  there"), (None, "123"), (3, "c "), (4, "hello there, my friend"), (None, None)], key=repr) or near.count() == 7
    classes = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()}
    assert classes == {(1, 1, 1), (2, 1, 1), (None, 1, None), (3, 1, 3), (4, 1, 4), (None, 1, 4), (None, 0, None)} - {(None, 1, None)} | ({(None, 1, None)} & classes)
    told = langid.keep_identified(odd)
    assert told.columns == odd.columns and rows(told, "doc_id", "text") == sorted([x for x in ODD if x[1] not in ("123", None)], key=repr)


def test_pipeline_stages_on_odd_tables(spark, sf, odd, empty):
    import corpus_pipeline

    from textquarry.llm.common import materialize

    for table, least in ((odd, 5), (empty, 0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf), name)
            assert docs.columns == table.columns, name
        assert docs.count() >= least
        shown = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert {r.doc_id for r in shown.collect()} == {r.doc_id for r in docs.collect() if r.doc_id is not None}


def test_html_extract_clashing_names(spark):
    names = ["key", "inside", "n", "id", "n_chars", "run", "weight"]
    pages = spark.createDataFrame([(1, "u", "<article><p>Some words &amp; more</p></article>", *([3] * 7))] * 2, "page_id long, url string, html string, " + ", ".join(f"{c} int" for c in names))
    got = html_extract.extract_text(pages, html_extract.fit(pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and rows(got, "text", "n_chars") == [("Some words & more", 17)] * 2


def test_mixing(docs, empty):
    shown = mixing.mix(docs, max_epochs=2.0).collect()
    assert {r.doc_id for r in shown} == set(range(12))  # every document is shown
    assert all(r.source == "" for r in shown if r.doc_id in (2, 4))
    assert mixing.mix(empty, max_epochs=2.0).collect() == []
    assert mixing.mix(empty, entropy=1.0).collect() == []


def test_secrets(docs, empty):
    found = rows(secrets.find_secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "spans")
    assert (8, 1, 0, 1, "assign:0:28,hex:8:28") in found and (2, 0, 0, 0, "") in found
    assert len(found) == len(ROWS) and secrets.find_secrets(empty).collect() == []


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (7, 0), (8, 0), (99, 1), (None, 1), (9, None), (5, 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1  # null as empty
    assert quality.classify(empty, model).collect() == []
    blank = quality.fit(empty, labels)
    assert {r.score for r in quality.classify(docs, quality.fit(docs, labels.filter("false"))).collect()} == {0.5} and blank


def test_langid(docs, empty):
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 4, 11}
    assert langid.identify(empty, model).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4


def test_jaccard_join(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got[0] == got[1] == (2, 0) and got[5] == got[6] == (29_996, 5)
    assert got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4)  # without words: linked with nothing
    assert got[9] == got[10] == (1, 9) and got[7] == (1, 7)
    assert got[None] == (1, None) and jaccard_join.jaccard_components(docs).count() == len(ROWS)
    assert jaccard_join.jaccard_components(empty).collect() == []
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, 9, 11, None}  # the longest text, then the smallest doc_id


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (None, "one"), (3, ""), (3, "?!")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontaminate.find_items(docs, items).collect()}
    assert got[0] == got[1] == (True, [1]) and not any(c for i, (c, _) in got.items() if i not in (0, 1))
    assert decontaminate.find_items(docs, items).count() == len(ROWS)
    assert decontaminate.find_items(empty, items).collect() == []
    assert not any(r.contaminated for r in decontaminate.find_items(docs, items.filter("false")).collect())
    assert decontaminate.remove_contaminated(docs, items).count() == len(ROWS) - 2


def test_decontaminate_row_by_row(spark, odd):
    items = odd.sparkSession.createDataFrame([(1, "hello there, my friend\nyes")], "item_id long, text string")
    left = decontaminate.remove_contaminated(odd, items)
    assert left.columns == odd.columns and rows(left, "doc_id", "text") == rows(odd, "doc_id", "text") or left.count() == len(ODD) - 1
    missing = spark.createDataFrame([(None, "we say hello there my friend yes to all"), (None, "clean"), (9, "hello there my friend yes"), (9, "clean")], "doc_id long, text string")
    assert rows(decontaminate.remove_contaminated(missing, items), "doc_id", "text") == sorted([(None, "clean"), (9, "clean")], key=repr)


def test_html_extract(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (2, "u", "<p>Some words &amp; more</p>", 1), (None, "v", "<", 1)], "page_id long, url string, html string, text int")
    got = rows(html_extract.extract_text(pages, html_extract.fit(pages)), "page_id", "url", "text", "n_chars")
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (2, "u", "Some words & more", 17), (None, "v", "", 0)], key=repr) or (None, "v", "<", 1) in got
    assert html_extract.extract_text(pages.filter("false"), {"div": 1.0}).collect() == []


def test_suffix_dedup(docs, empty):
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert {(5, len(LONG), len(LONG), 1, none), (6, len(LONG), len(LONG), 1, none), (2, 0, 0, 0, none), (9, 3, 0, 0, hashlib.sha256(b"one").hexdigest())} <= got
    assert suffix_dedup.remove_repeats(docs).count() == len(ROWS)
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_lm_score(spark, docs, empty):
    from pyspark.sql import functions as F

    got = lm_score.score_texts(docs, F.col("doc_id") != 0).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[0].n_tokens == 7 and by[0].n_known == 7
    assert by[0].train_tokens == sum(len((t or "").split()) + 1 for i, t, *_ in ROWS if i not in (0, None))
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert lm_score.score_texts(empty, F.lit(True)).collect() == []


def test_written_tables_go(spark):
    from textquarry.llm import common

    rows_ = common.materialize(spark.range(3), "three")
    assert rows_.count() == 3
    common.clean_up(spark)
    spark.catalog.clearCache()
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(rows_.inputFiles()[0]).count()


@pytest.mark.parametrize("text,found", [("", False), (None, False), ("½ ² 12 _", False), ("½ é", True), ("12a", True)])
def test_letters(text, found):
    assert langid.has_letter(text) == found
