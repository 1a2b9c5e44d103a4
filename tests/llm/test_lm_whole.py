"""The attention model learns from all training documents, beyond the sample of its first weights."""

import pickle
import time

import numpy as np
from pyspark.sql import functions as F

from textquarry.llm import kernel, lm_score
from textquarry.llm.attention import BATCH, DIM, OVERLAP, OWN_ROWS, WINDOW, Model, cut, n_windows


def test_tree_rows_and_training_see_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "INIT_DOCS", 2)
    texts = ["plain words here"] * 30 + ["zyzzyva quokkaé words"] * 30 + ["held out only"] * 9 + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given, windows, models = [], [], []
    fit = lm_score.fit

    def kept(docs, counts, rows, *more):
        given.append(counts)
        windows.append(np.concatenate([np.frombuffer(r.windows, np.int32) for r in rows.collect()]).reshape(-1, WINDOW + 2))
        models.append(fit(docs, counts, rows, *more))
        return models[-1]

    monkeypatch.setattr(lm_score, "fit", kept)
    learns = (F.col("doc_id") < 60) | (F.col("doc_id") == 69)
    assert len(lm_score.score_texts(docs, learns, share=1).collect()) == len(texts)
    tokens = lm_score.tokenizer(lm_score.TOKENIZER)
    want = np.bincount(np.concatenate([lm_score.ids_of(tokens, t) for t in texts[:60] + [None]]), minlength=tokens.size)
    assert (given[0] == want).all()
    assert (models[0].rows[np.flatnonzero(want)] < OWN_ROWS).all()  # own rows for all that occur
    assert len(windows[0]) == 61 and (np.bincount(windows[0][:, 2:][windows[0][:, 2:] >= 0], minlength=tokens.size) == want).all()


def test_windows_cover_a_text_once():
    ids = np.arange(500)
    for n in (1, 7, 8, 31, 32, 33, 56, 57, 500):
        rows = cut(ids[:n])
        assert rows[0, 0] == 1 and rows[0, 1] == -1 and not rows[1:, 0].any() and len(rows) == n_windows(n)
        told = [r[2:] if r[0] else r[2 + OVERLAP :] for r in rows]
        assert np.concatenate(told)[np.concatenate(told) >= 0].tolist() == list(range(n))
        assert all((r[2:][r[2:] > 0] - 1 == r[1:-1][r[2:] > 0]).all() for r in rows)  # inputs stand one before


def test_drawn_windows():
    """All shares together are all windows of the training texts, as cut() makes them."""
    import pandas as pd

    tokens = lm_score.tokenizer(lm_score.TOKENIZER)
    texts = ["", "one", "some plain words " * 40, "internationalisation of ünïcödé " * 9, "held out words " * 30, "the last of them, but long " * 60]
    vocabulary, numbers = lm_score._indexed(texts)
    flat, begin, length = tokens.vocabulary(vocabulary, lm_score.END)
    want = sorted(tuple(r) for i, t in enumerate(texts) if i != 4 for r in cut(lm_score.ids_of(tokens, t)).tolist())
    got = []
    for shift in range(5):
        rows = pd.DataFrame({"text": texts, "doc_id": range(6), "train": [i != 4 for i in range(6)], "order": [i * 7919 + shift - 40_000 for i in range(6)]})
        got += map(tuple, lm_score._windows(rows, numbers, flat, begin, length, 5).tolist())
    assert sorted(got) == want and len(want) > 20


def test_scores_do_not_depend_on_the_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, "no identifier"), (None, "none either")], "doc_id long, text string"))
    got = []
    for n in (1, 7):
        rows = lm_score.score_texts(docs.repartition(n), F.col("doc_id") % 5 != 2).collect()
        got.append(sorted((r.doc_id or -1, r.n_tokens, r.score, r.base_score) for r in rows))
    assert np.allclose(np.array(got[0], float), np.array(got[1], float), rtol=1e-5, atol=0)


def test_all_windows_train_by_default(spark, monkeypatch):
    got = []

    def seen(docs, counts, rows, *more):
        got.append(sum(len(r.windows) // (4 * (WINDOW + 2)) for r in rows.collect()))
        return lm_score.first_model(docs, counts)

    monkeypatch.setattr(lm_score, "fit", seen)
    texts = [f"plain words {i} " * 60 for i in range(8)]
    lm_score.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(True)).collect()
    tokens = lm_score.tokenizer(lm_score.TOKENIZER)
    assert got == [sum(n_windows(len(lm_score.ids_of(tokens, t))) for t in texts)]


def _trained(n_docs: int, seed: int = 3) -> tuple[Model, np.ndarray]:
    """A model of a vocabulary of 3,000, and windows of random texts with a few frequent tokens."""
    rng = np.random.default_rng(seed)
    texts = [np.minimum(rng.zipf(1.3, rng.integers(1, 400)), 2999).astype(np.int64) for _ in range(n_docs)]
    model = Model(np.concatenate(texts), np.arange(3000) % 3 == 2)
    model.tree[:-1] = rng.normal(0, 0.1, (len(model.tree) - 1, model.tree.shape[1]))
    return model, np.concatenate([cut(t) for t in texts])


def _plain_step(self, x, y, rate):
    """A training step decision by decision, every decision with a row of its own."""
    h, a, q, k, v = self.attend(x)
    flat = np.flatnonzero(y.reshape(-1) >= 0)
    hs = h.reshape(-1, DIM)[flat]
    z, nodes, signs, vec, begins, n = self.decide(hs, y.reshape(-1)[flat])
    g = -signs / (1 + np.exp(np.minimum(z, np.float32(60))))
    dh = np.zeros_like(h)
    dh.reshape(-1, DIM)[flat] = np.add.reduceat(g[:, None] * self.tree[vec], begins, axis=0)
    da = dh @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(2, keepdims=True))
    de = np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh, dh], 2).reshape(-1, 4 * DIM)
    by = ds.sum(0)
    near = np.array([np.trace(by, -d) for d in range(WINDOW)])
    order, other = np.argsort(nodes), np.argsort(x.reshape(-1))
    rows = np.repeat(np.arange(len(hs)), n)[order]
    for p, s, at, grad in zip(
        self.theta(), self.sums, (x.reshape(-1)[other], np.arange(WINDOW), vec[order], nodes[order]), (de[other], near, g[order][:, None] * hs[rows], g[order]), strict=True
    ):
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        grad, at = np.add.reduceat(grad, starts, axis=0) / BATCH, at[starts]
        s[at] += grad * grad
        p[at] -= rate * grad / np.sqrt(s[at])
    self.tree[-1] = 0


def test_steps_equal_plain_ones_in_less_time(monkeypatch):
    model, windows = _trained(300)
    copies = [pickle.loads(pickle.dumps(model)) for _ in range(2)]
    took = []
    for own, step in zip(copies, (Model._step, _plain_step), strict=True):
        monkeypatch.setattr(Model, "_step", step)
        own.train_on(windows[: BATCH + 7], 0.1)  # not measured: tables are made
        began = time.thread_time()
        own.train_on(windows, 0.1)
        took.append(time.thread_time() - began)
    for got, want, before in zip(copies[0].theta(), copies[1].theta(), model.theta(), strict=True):
        moved = np.abs(want - before).max()
        assert moved > 1e-3 and np.abs(got - want).max() < 0.02 * moved
    assert took[0] < 0.8 * took[1]


def test_a_copy_scores_with_its_own_weights():
    """What a model has worked out from its weights for scoring does not go along with a copy."""
    model, windows = _trained(20)
    text = np.arange(3000)
    model.score([text])
    own = pickle.loads(pickle.dumps(model))
    own.bias += 1
    model.bias += 1
    for name in ("paths", "flat"):
        model.__dict__.pop(name)
    assert np.allclose(own.score([text])[0], model.score([text])[0])


def test_decisions_are_split_in_two():
    """The decisions near the root and the others together are all of a token's."""
    model, _ = _trained(50)
    top, first, n, nodes, signs = model._steep_paths()
    for t in range(0, 3000, 7):
        own = {(int(k), float(top[t, k])) for k in np.flatnonzero(top[t])} | set(zip(nodes[first[t] : first[t] + n[t]].tolist(), signs[first[t] : first[t] + n[t]].tolist()))
        at = slice(model.offsets[t], model.offsets[t + 1])
        assert own == set(zip(model.nodes[at].tolist(), model.signs[at].tolist())) and len(own) == model.lengths[t]


def test_packed_windows_come_back_whole():
    for ids in ([], [0, 5, 65533], [65534, 65535, 1 << 20]):
        rows = cut(np.array(ids, np.int64))
        data = lm_score.packed(np.tile(rows, (50, 1)))
        assert (np.frombuffer(lm_score.unpacked(data), np.int32).reshape(-1, WINDOW + 2) == np.tile(rows, (50, 1))).all()
        assert len(data) < rows.nbytes * 50 / 2
    assert lm_score.unpacked(lm_score.packed(np.empty((0, WINDOW + 2), np.int32))) == b""


def test_the_jvm_trains_and_scores_as_numpy_does(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(200)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 3000), (-4, "\x1c odd\u2003space ")], "doc_id long, text string"))
    assert kernel.load(spark) is not None
    got = []
    for load in (kernel.load, lambda spark: None):
        monkeypatch.setattr(kernel, "load", load)
        rows = lm_score.score_texts(docs, F.col("doc_id") % 5 != 2).collect()
        got.append(sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows))
    assert len(got[0]) == docs.count() and np.allclose(np.array(got[0], float), np.array(got[1], float), rtol=1e-5, atol=0)
