"""A causal self-attention language model over subword ids, in numpy.

One attention head reads the last WINDOW tokens: queries, keys, values and the
skip connection are rows of tables by token, distance has a bias of its own.
The next token is coded by the decisions on its way down a binary tree, so the
probabilities of all tokens sum to one without a sum over the vocabulary.  With
untrained vectors the model is the unigram model that the tree was built from.
The first decision is whether a token begins a word (or ends the text), so that
the probability of a whole word, up to the beginning of the next, can be told.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np

#: Tokens of a context window, and those that every window but the first takes over from the one before.
WINDOW, OVERLAP = 32, 8
STEP = WINDOW - OVERLAP
DIM = 16
#: Tokens with rows of their own; all others share RARE_ROWS by identifier.
OWN_ROWS, RARE_ROWS = 4096, 256
#: Decisions of the tree with vectors of their own, the most frequent; the others have a bias only.
NODES = 8192
#: Windows of a training step, and windows scored at a time.
BATCH, SCORED = 256, 96
#: Decisions near the root, which nearly every token takes; they are worked out for all at once.
TOP = 64
#: Tokens whose decisions near the root are worked out at a time in training.
NEAR_AT_ONCE = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
F32 = np.float32
#: How far the second of two places of a window stands before the first.
GAP = np.subtract.outer(np.arange(WINDOW), np.arange(WINDOW))


class Tokens:
    """Subword ids of words, each word with the space before it; remembers words."""

    def __init__(self, path: str = TOKENIZER):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        #: Tokens that begin a word, or the end.
        self.initial = np.zeros(self.size, bool)
        self.initial[[i for x, i in ranks.items() if x[:1] == b" "] + [self.end]] = True
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, tuple[int, ...]] = {}

    def word(self, w: bytes) -> tuple[int, ...]:
        if len(self.known) > 1 << 17:
            self.known.clear()
        ids = self.known[w] = tuple(self.encoding.encode_ordinary(" " + w.decode(errors="replace")))
        return ids

    def vocabulary(self, words: list[bytes], end: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row; where each word's begin, and how many they are.  end: the word that stands for the end."""
        texts = [" " + w.decode(errors="replace") for w in words if w != end]
        # one call for all: a word's ids begin with the one that has the space
        flat = np.array(self.encoding.encode_ordinary("".join(texts)), np.int64)
        begin = np.flatnonzero(self.initial[flat])
        if len(begin) != len(texts):  # odd white space inside words
            each = [self.encoding.encode_ordinary(t) for t in texts]
            flat = np.fromiter((i for x in each for i in x), np.int64)
            begin = np.cumsum([0] + [len(x) for x in each])[:-1]
        length = np.diff(np.r_[begin, len(flat)])
        if end in words:
            at = words.index(end)
            begin, length = np.insert(begin, at, len(flat)), np.insert(length, at, 1)
            flat = np.append(flat, self.end)
        return flat, begin.astype(np.int64), length.astype(np.int64)

    def text(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids by word, and the end as the last one."""
        get, new = self.known.get, self.word
        out = [get(w) or new(w) for w in words]
        out.append((self.end,))
        return out


#: Tokens before that tell tokens apart when the tree is built.
CONTEXTS = 256


def _halve(weight: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Which of the tokens go right: a cut along the main direction of their contexts, at half the weight."""
    w = weight / weight.sum()
    x = context - w @ context
    d = x[np.argmax(w * np.einsum("ij,ij->i", x, x))]
    for _ in range(8):
        d = (w * (x @ d)) @ x
        d /= np.sqrt(d @ d) + 1e-30
    order = np.argsort(x @ d, kind="stable")
    cut = int(np.abs(np.cumsum(w[order])[:-1] - 0.5).argmin()) + 1
    right = np.zeros(len(w), bool)
    right[order[cut:]] = True
    return right


def build_tree(counts: np.ndarray, sample: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A binary tree of all tokens, initial ones on one side, with the odds of the counts.  Tokens that occur in
    the sample are told apart by the tokens before them there, all others (and small rests) by frequency.

    Returns the tokens' paths, each from the token up: offsets, nodes (the most
    frequent first, the root is 0), signs; and the nodes' log odds."""
    n = len(counts)
    weight = counts.astype(np.float64) + 0.1
    common = np.argsort(-counts, kind="stable")[:CONTEXTS]
    place = np.full(n, CONTEXTS)
    place[common] = np.arange(len(common))
    seen = np.flatnonzero(np.bincount(sample, minlength=n) >= 5)
    at = np.full(n, -1)
    at[seen] = np.arange(len(seen))
    ok = at[sample[1:]] >= 0
    context = np.bincount(at[sample[1:]][ok] * (CONTEXTS + 1) + place[sample[:-1]][ok], minlength=len(seen) * (CONTEXTS + 1)).reshape(len(seen), CONTEXTS + 1)
    context = np.sqrt(context / np.maximum(context.sum(1, keepdims=True), 1)).astype(F32)
    left, right = [], []

    def by_frequency(nodes: list[int], w: list[float]) -> tuple[int, float]:
        heap = list(zip(w, nodes, strict=True))
        heapq.heapify(heap)
        while len(heap) > 1:
            (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
            left.append(a), right.append(b)
            odds.append(np.log(wb / wa)), mass.append(wa + wb)
            heapq.heappush(heap, (wa + wb, n + len(left) - 1))
        return heap[0][1], heap[0][0]

    odds: list[float] = []
    mass: list[float] = []

    def by_context(tokens: np.ndarray) -> tuple[int, float]:
        if len(tokens) <= 2:
            return by_frequency(tokens.tolist(), weight[tokens].tolist())
        side = _halve(weight[tokens], context[at[tokens]])
        (a, wa), (b, wb) = by_context(tokens[~side]), by_context(tokens[side])
        left.append(a), right.append(b)
        odds.append(np.log(wb / wa)), mass.append(wa + wb)
        return n + len(left) - 1, wa + wb

    sides = []
    for begins in (False, True):
        rest, own = np.flatnonzero((at < 0) & (initial == begins)), seen[initial[seen] == begins]
        tops = [by_frequency(rest.tolist(), weight[rest].tolist())] if len(rest) else []
        tops += [by_context(own)] if len(own) else []
        sides.append(by_frequency([t for t, _ in tops], [w for _, w in tops]))
    by_frequency([t for t, _ in sides], [w for _, w in sides])
    # renumber: the most frequent decision first
    rank = np.empty(len(left), np.int64)
    rank[np.argsort(-np.array(mass), kind="stable")] = np.arange(len(left))
    parent, side = np.full(n + len(left), -1), np.zeros(n + len(left), np.int8)
    parent[left], parent[right] = n + np.arange(len(left)), n + np.arange(len(left))
    side[left], side[right] = -1, 1
    steps, now, live = [], np.arange(n), np.arange(n)
    while len(live):
        up = parent[now]
        keep = up >= 0
        now, live, up = now[keep], live[keep], up[keep]
        steps.append((live, rank[up - n], side[now]))
        now = up
    tokens = np.concatenate([x for x, _, _ in steps])
    order = np.argsort(tokens, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=n))])
    bias = np.empty(len(left), F32)
    bias[rank] = odds
    return offsets, np.concatenate([x for _, x, _ in steps])[order].astype(np.int32), np.concatenate([x for _, _, x in steps])[order].astype(F32), bias


def n_windows(n):
    """Windows of a text of n tokens (a number, or an array of them); they begin STEP apart."""
    return np.maximum(1, -(-(n - OVERLAP) // STEP))


def window(ids: np.ndarray, first: bool) -> np.ndarray:
    """A window by the tokens from the one before it on (the first of a text: from its first on):
    1 for the first, the token before (-1: none), the tokens (-1: beyond the end)."""
    out = np.full(WINDOW + 2, -1, np.int32)
    out[0] = first
    ids = ids[: WINDOW + 1 - first]
    out[1 + first : 1 + first + len(ids)] = ids
    return out


def cut(ids: np.ndarray) -> np.ndarray:
    """All windows of a text."""
    return np.stack([window(ids[max(0, k * STEP - 1) :], k == 0) for k in range(n_windows(len(ids)))])


class Model:
    """The tree, the row of each token, and the weights (theta)."""

    def __init__(self, sample: np.ndarray, initial: np.ndarray, seed: int = 7, counts: np.ndarray | None = None):
        """sample: tokens of some texts in a row; initial: which tokens begin a word, the last is the end;
        counts: how often each token occurs in all texts (without them: in the sample)."""
        counts = np.bincount(sample, minlength=len(initial)) if counts is None else counts
        self.offsets, self.nodes, self.signs, bias = build_tree(counts, sample, initial)
        self.lengths = np.diff(self.offsets)
        order = np.argsort(-counts, kind="stable")
        self.rows = (OWN_ROWS + np.arange(len(counts)) % RARE_ROWS).astype(np.int32)
        self.rows[order[:OWN_ROWS]] = np.arange(min(OWN_ROWS, len(counts)))
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (OWN_ROWS + RARE_ROWS, 4 * DIM)).astype(F32)
        self.near = np.linspace(0, -2, WINDOW).astype(F32)  # by distance
        self.tree = np.zeros((NODES + 1, DIM), F32)  # the last stands for all further nodes and stays zero
        self.bias = bias

    def theta(self) -> list[np.ndarray]:
        return [self.table, self.near, self.tree, self.bias]

    def state(self) -> list[np.ndarray]:
        """AdaGrad's sums of squares by weight, with those of all steps so far."""
        if "sums" not in self.__dict__:
            self.sums = [np.full(p.shape, 1e-2, F32) for p in self.theta()]
        return self.sums

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (rows; the end stands before the text) and, by window, the place of its first token."""
        starts = np.arange(n_windows(len(ids))) * STEP
        rows = np.full(starts[-1] + WINDOW, self.rows[-1], np.int32)
        rows[1 : len(ids)] = self.rows[ids[:-1]]
        return rows[starts[:, None] + np.arange(WINDOW)], starts

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        e = self.table.take(x, 0)
        # products of small matrices are much faster if they lie in one piece
        q, k, v, s = (np.ascontiguousarray(e[..., i : i + DIM]) for i in range(0, 4 * DIM, DIM))
        mask = np.where(GAP >= 0, self.near[np.maximum(GAP, 0)], F32(-1e4)).astype(F32)
        a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        a += mask
        np.minimum(a, F32(60), out=a)
        np.exp(a, out=a)
        a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, F32)).reshape(*a.shape[:2], 1)
        s += a @ v
        return s, a, q, k, v

    def decide(self, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Signed evidence at each decision on the way to tokens y; where each token's begin."""
        n = self.lengths[y]
        ends = np.cumsum(n)
        begins = ends - n
        at = np.arange(ends[-1]) + np.repeat(self.offsets[y] - begins, n)
        nodes, signs = self.nodes[at], self.signs[at]
        vec = np.minimum(nodes, NODES)
        z = np.einsum("ij,ij->i", np.repeat(h, n, 0), self.tree[vec])
        z += self.bias[nodes]
        z *= signs
        return z, nodes, signs, vec, begins, n

    def __getstate__(self) -> dict:
        """Without what is worked out again from the tree and the weights."""
        return {k: v for k, v in self.__dict__.items() if k not in ("paths", "flat", "steep")}

    def _steep_paths(self) -> tuple[np.ndarray, ...]:
        """For training: each token's signs at the decisions near the root (0: not on its way), and
        of its other decisions where they begin, how many they are, nodes, signs."""
        if "steep" not in self.__dict__:
            owner, near = np.repeat(np.arange(len(self.lengths)), self.lengths), self.nodes < TOP
            top = np.zeros((len(self.lengths), min(TOP, len(self.bias))), np.int8)
            top[owner[near], self.nodes[near]] = self.signs[near]
            n = np.bincount(owner[~near], minlength=len(self.lengths)).astype(np.int16)
            self.steep = top, np.cumsum(n, dtype=np.int64) - n, n, self.nodes[~near], self.signs[~near]
        return self.steep

    def _split_paths(self) -> list[tuple[np.ndarray, ...]]:
        """Each token's decisions near the root, and the others that have vectors: first, number,
        nodes, signs.  The root comes last.  Decisions without vectors are the same in all contexts:
        flat has the log of their probability by token."""
        if "paths" not in self.__dict__:
            owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
            self.paths = []
            for part in (self.nodes < TOP, (self.nodes >= TOP) & (self.nodes < NODES)):
                n = np.bincount(owner[part], minlength=len(self.lengths))
                self.paths.append((np.cumsum(n) - n, n, self.nodes[part].astype(np.int64), self.signs[part]))
            rest = self.nodes >= NODES
            z = np.minimum(-(self.bias[self.nodes[rest]] * self.signs[rest]).astype(np.float64), 30)
            self.flat = -np.bincount(owner[rest], np.log1p(np.exp(z)), len(self.lengths))
        return self.paths

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of tokens y, and of their first decision."""
        (first, n, nodes, signs), (first2, n2, nodes2, signs2) = self._split_paths()

        def places(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = n[y]
            ends = np.cumsum(n)
            return np.arange(ends[-1]) + np.repeat(first[y] - (ends - n), n), n, ends

        top = min(TOP, len(self.bias))
        z = (h @ self.tree[:top].T + self.bias[:top]).ravel()
        at, k, ends = places(first, n)
        z = z.take(np.repeat(np.arange(len(y)) * top, k) + nodes.take(at)) * signs.take(at)
        odds = 1 + np.exp(np.minimum(-z, F32(30)))  # one over the probability
        root = -np.log(odds[ends - 1])
        total = np.multiply.reduceat(odds.astype(np.float64), ends - k)
        at, k, ends = places(first2, n2)
        if len(at):
            deep = np.flatnonzero(k)
            own = nodes2.take(at)
            z = np.einsum("ij,ij->i", h.take(np.repeat(deep, k[deep]), 0), self.tree.take(own, 0))
            z += self.bias.take(own)
            z *= signs2.take(at)
            odds = 1 + np.exp(np.minimum(-z, F32(30))).astype(np.float64)
            total[deep] *= np.multiply.reduceat(odds, (ends - k)[deep])
        return self.flat[y] - np.log(total), root

    def score(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Natural log probabilities, each token scored once: of the token (first
        row), and of its first decision alone, whether it begins a word (second row)."""
        out = [np.zeros((2, len(t))) for t in texts]
        batch, where, size = [], [], 0

        def run() -> None:
            h = self.attend(np.concatenate(batch))[0].reshape(-1, DIM)
            y = np.concatenate([t for _, _, t, _ in where])
            h = h[np.concatenate([p for _, _, _, p in where])]
            logp, root = self.log_probability(h, y)
            at = 0
            for k, a, t, _ in where:
                out[k][0, a : a + len(t)], out[k][1, a : a + len(t)] = logp[at : at + len(t)], root[at : at + len(t)]
                at += len(t)

        for k, ids in enumerate(texts):
            x, starts = self.windows(ids)
            for lo in range(0, len(x), SCORED):
                part = x[lo : lo + SCORED]
                first = 0 if lo == 0 else int(starts[lo]) + OVERLAP
                last = min(len(ids), int(starts[lo + len(part) - 1]) + WINDOW)
                pos = np.arange(first, last)
                w = np.maximum((pos - OVERLAP) // STEP, 0)  # the window that scores a place
                flat = (w - lo) * WINDOW + pos - starts[w] + size * WINDOW
                batch.append(part)
                where.append((k, first, ids[first:last], flat))
                size += len(part)
                if size >= SCORED:
                    run()
                    batch, where, size = [], [], 0
        if batch:
            run()
        return out

    def train(self, texts: Iterator[np.ndarray], rate: float = 0.1) -> int:
        """One pass of AdaGrad over the texts' windows; returns the number of tokens."""
        held, n, total = [], 0, 0
        for ids in texts:
            held.append(cut(ids))
            n, total = n + len(held[-1]), total + len(ids)
            if n >= BATCH:
                self.train_on(np.concatenate(held), rate)
                held, n = [], 0
        if held:
            self.train_on(np.concatenate(held), rate)
        return total

    def train_on(self, windows: np.ndarray, rate: float) -> int:
        """AdaGrad steps over windows as cut() makes them; returns the number of tokens that they predict."""
        self.state()
        total = 0
        for lo in range(0, len(windows), BATCH):
            part = windows[lo : lo + BATCH]
            x = np.where(part[:, 1:-1] < 0, self.rows[-1], self.rows[part[:, 1:-1]])
            y = part[:, 2:].astype(np.int64)
            y[part[:, 0] == 0, :OVERLAP] = -1
            total += int((y >= 0).sum())
            self._step(x, y, rate)
        return total

    def _step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        """Decisions near the root are worked out for all tokens at once, the others level by level
        from there on; the tokens with most of them come first, so that a level's stand together."""
        top, first, deep, far, turns = self._steep_paths()
        h, a, q, k, v = self.attend(x)
        y = y.reshape(-1)
        flat = np.flatnonzero(y >= 0)
        flat = flat.take(np.argsort(-deep.take(y.take(flat)), kind="stable"))
        y, hs = y.take(flat), h.reshape(-1, DIM).take(flat, 0)
        scale, n_top = F32(1 / BATCH), top.shape[1]
        near, dhs = self.tree[:n_top], np.empty_like(hs)
        grad, grad_bias = np.zeros((n_top, DIM), F32), np.zeros(n_top, F32)
        for lo in range(0, len(y), NEAR_AT_ONCE):
            own, sign = hs[lo : lo + NEAR_AT_ONCE], top.take(y[lo : lo + NEAR_AT_ONCE], 0).astype(F32)
            g = own @ near.T
            g += self.bias[:n_top]
            g *= sign
            np.minimum(g, F32(60), out=g)
            np.exp(g, out=g)
            g += 1
            np.divide(sign, g, out=g)
            g *= -scale
            dhs[lo : lo + NEAR_AT_ONCE] = g @ near
            grad += g.T @ own
            grad_bias += np.ones(len(g), F32) @ g
        nodes, gs, sizes = [], [], []
        levels = np.cumsum(np.bincount(deep.take(y))[::-1])[::-1][1:].tolist()  # tokens that have so many decisions more
        begins = first.take(y)
        for d, c in enumerate(levels):
            at = begins[:c] + d
            node, sign = far.take(at), turns.take(at)
            vectors = self.tree.take(np.minimum(node, NODES), 0)
            z = np.einsum("ij,ij->i", hs[:c], vectors)
            z += self.bias.take(node)
            z *= sign
            g = -scale * sign / (1 + np.exp(np.minimum(z, F32(60))))
            vectors *= g[:, None]
            dhs[:c] += vectors
            nodes.append(node), gs.append(g), sizes.append(c)
        self._update(2, np.arange(n_top), grad, rate)
        self._update(3, np.arange(n_top), grad_bias, rate)
        if nodes:
            node, g = np.concatenate(nodes), np.concatenate(gs)
            order = _order(node, len(self.bias))
            node, g = node.take(order), g.take(order)
            rows = np.concatenate([np.arange(c) for c in sizes]).take(order)
            # vectors and biases of decisions: one order serves both, since vectors follow nodes
            self._update(2, np.minimum(node, NODES), g[:, None] * hs.take(rows, 0), rate)
            self.tree[NODES] = 0
            self._update(3, node, g, rate)
        dh = np.zeros_like(h)
        dh.reshape(-1, DIM)[flat] = dhs
        ds = dh @ np.ascontiguousarray(v.transpose(0, 2, 1))
        ds -= np.einsum("ijk,ijk->ij", ds, a)[..., None]
        ds *= a
        de = np.empty((*x.shape, 4 * DIM), F32)
        de[..., :DIM], de[..., DIM : 2 * DIM] = ds @ k, ds.transpose(0, 2, 1) @ q
        de[..., 2 * DIM : 3 * DIM], de[..., 3 * DIM :] = a.transpose(0, 2, 1) @ dh, dh
        x = x.reshape(-1)
        order = _order(x, len(self.table))
        self._update(0, x.take(order), de.reshape(-1, 4 * DIM).take(order, 0), rate)
        by = np.bincount(GAP.ravel() + WINDOW, ds.sum(0).ravel(), 2 * WINDOW)[WINDOW:]
        self._update(1, np.arange(WINDOW), by.astype(F32), rate)

    def _update(self, which: int, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """rows: ascending."""
        new = np.r_[True, rows[1:] != rows[:-1]]
        if not new.all():
            starts = np.flatnonzero(new)
            # two numbers are added at a time
            grad = np.add.reduceat(grad.view(np.complex64), starts, axis=0).view(F32) if grad.ndim > 1 else np.add.reduceat(grad, starts)
            rows = rows.take(starts)
        p, s = self.theta()[which], self.sums[which]
        own = s.take(rows, 0)
        own += grad * grad
        s[rows] = own
        np.sqrt(own, out=own)
        np.divide(grad, own, out=own)
        own *= F32(rate)
        p[rows] -= own


def _order(x: np.ndarray, most: int) -> np.ndarray:
    """The order of numbers below most; small ones are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if most <= 1 << 16 else x, kind="stable")
