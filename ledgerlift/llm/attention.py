"""A small causal self-attention model over subword ids, trained and evaluated in numpy.

One attention layer over the ``CONTEXT`` ids before a position and itself, with learned distance biases; its output
and the position's embedding predict the next id through a two-level softmax (``SIDE`` clusters of ``SIDE`` ids by
frequency). Ids outside the ``SIDE**2 - 3`` most frequent ones of the training corpus share one slot and are
told apart uniformly, so probabilities of all ids sum to one.

Texts are laid end to end, each after ``CONTEXT + 1`` start marks, so that a window never sees another text. The stream is cut into
windows of ``BLOCK`` positions, each with ``CONTEXT`` more before it: windows overlap, and every position is scored
once, with all its context. A product takes ``CONTEXT`` positions of a window, and the keys and values of as many before them.
Since one layer reads embeddings only, queries, keys and values of all ids are tables.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np

CONTEXT, BLOCK, SIDE, WIDTH = 16, 64, 40, 32
SLOTS = SIDE * SIDE
START, RARE, END = SLOTS - 1, SLOTS - 2, SLOTS - 3
#: Positions that scoring works on at once.
STREAM = 1 << 13
_DISTANCE = np.arange(BLOCK)[:, None] + CONTEXT - np.arange(BLOCK + CONTEXT)[None, :]
_SEEN = (_DISTANCE >= 0) & (_DISTANCE <= CONTEXT)
#: The same for the positions of one product.
_NEAR, _NEAR_SEEN = _DISTANCE[:CONTEXT, : 2 * CONTEXT], _SEEN[:CONTEXT, : 2 * CONTEXT]


class Attention:
    """``slot`` maps tokenizer ids to slots; ``within`` is an id's log share of its slot; ``p`` holds the parameters."""

    def __init__(self, slot: np.ndarray, within: np.ndarray, p: dict[str, np.ndarray]):
        self.slot, self.within, self.p = slot, within, p
        one = np.ones((len(p["emb"]), 1), np.float32)
        self.q = (p["emb"] @ p["q"] / np.float32(np.sqrt(WIDTH))).astype(np.float32)
        # keys, values and a column of ones that sums the weights; one in the hidden vector adds the biases
        self.kv = np.concatenate([p["emb"] @ p["k"], p["emb"] @ p["v"] @ p["o"], one], 1).astype(np.float32)
        self.bias = _weights(p["bias"]).astype(np.float32)
        self.emb = np.concatenate([p["emb"], one], 1).astype(np.float32)
        self.wc = np.concatenate([p["wc"], p["bc"][None]]).astype(np.float32)
        self.wi = np.concatenate([p["wi"], p["bi"][:, None]], 1).astype(np.float32)

    def slots(self, text: np.ndarray) -> tuple[np.ndarray, float]:
        """Slots of an id sequence, and the summed log shares of its ids."""
        return self.slot[text].astype(np.uint16), float(self.within[text].sum())

    def stream(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of all texts (ids, or slots where they are of 16 bits), each after its start marks; positions that predict; and the text of each."""
        lengths = np.array([len(t) for t in texts])
        at = np.concatenate([[0], np.cumsum(lengths + CONTEXT + 1)])
        x = np.full(at[-1], START, np.int32)
        for a, t in zip(at[:-1].tolist(), texts, strict=True):
            x[a + CONTEXT + 1 : a + CONTEXT + 1 + len(t)] = t if t.dtype == np.uint16 else self.slot[t]
        text = np.repeat(np.arange(len(texts)), lengths + 1)
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        return x, np.arange(len(text)) - first[text] + at[text] + CONTEXT, text

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each id sequence and its end; of slot sequences without their ids' shares."""
        x, where, text = self.stream(texts)
        target = np.full(len(x), END, np.int32)
        target[:-1] = np.where(x[1:] == START, END, x[1:])
        logp = np.empty(len(x), np.float32)
        for a in range(0, len(x), STREAM):
            logp[a : a + STREAM] = self._chunk(x, target, a, min(len(x), a + STREAM))
        out = np.bincount(text, logp[where].astype(np.float64), minlength=len(texts))
        return out + np.array([0.0 if t.dtype == np.uint16 else self.within[t].sum() for t in texts])

    def _chunk(self, x: np.ndarray, target: np.ndarray, a: int, b: int) -> np.ndarray:
        n = -(-(b - a) // CONTEXT)
        s = np.full((n + 1) * CONTEXT, START, np.int32)
        lo = max(0, a - CONTEXT)
        s[CONTEXT - (a - lo) : CONTEXT + b - a] = x[lo:b]
        own, kv = s[CONTEXT:], self.kv.take(s, 0)
        w = self.q.take(own, 0).reshape(n, CONTEXT, WIDTH) @ _parts(kv[None, :, :WIDTH])[0].transpose(0, 2, 1)
        np.clip(w, -30, 30, out=w)
        np.exp(w, out=w)
        w *= self.bias
        h = (w @ _parts(kv[None, :, WIDTH:])[0]).reshape(-1, WIDTH + 1)
        norm = 1 / h[:, WIDTH:]
        h[:, WIDTH] = 0
        h *= norm
        h += self.emb.take(own, 0)
        y = target[a:b]
        order = np.argsort((y // SIDE).astype(np.uint8), kind="stable")
        y, h = y[order], h.take(order, 0)
        z, cluster, _ = _logits(h, self.wc, self.wi, y)
        row = np.arange(len(y))
        picked = z[0, row, cluster] + z[1, row, y % SIDE]
        np.exp(z, out=z)
        total = z @ np.ones(SIDE, np.float32)
        out = np.empty(len(y), np.float32)
        out[order] = picked - np.log(total[0]) - np.log(total[1])
        return out


def _weights(bias: np.ndarray) -> np.ndarray:
    """By what the distances in one product multiply its weights."""
    return np.where(_NEAR_SEEN, np.exp(bias)[np.clip(_NEAR, 0, CONTEXT)], bias.dtype.type(0))


def _parts(rows: np.ndarray) -> np.ndarray:
    """Of each window's rows, overlapping parts of ``2 * CONTEXT``, as a view."""
    window, step, item = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (len(rows), rows.shape[1] // CONTEXT - 1, 2 * CONTEXT, rows.shape[2]), (window, CONTEXT * step, step, item))


def _logits(h: np.ndarray, wc: np.ndarray, wi: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Logits of the clusters and of the members of y's cluster, for y in the order of clusters; y's clusters and where each begins."""
    cluster = y // SIDE
    edge = np.searchsorted(cluster, np.arange(SIDE + 1)).tolist()
    z = np.empty((2, len(y), SIDE), h.dtype)
    np.matmul(h, wc, out=z[0])
    for c in range(SIDE):
        i, j = edge[c], edge[c + 1]
        if i < j:
            np.matmul(h[i:j], wi[c], out=z[1, i:j])
    return z, cluster, edge


def _grow(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of x, of an even width, summed by their index; two columns are added at once, as one complex number."""
    pairs = x.view(np.complex64 if x.dtype == np.float32 else np.complex128)
    k = pairs.shape[1]
    out = np.zeros(n * k, pairs.dtype)
    np.add.at(out, (at[:, None] * np.int64(k) + np.arange(k)).ravel(), pairs.ravel())
    return out.view(x.dtype).reshape(n, -1)


def initial(count: np.ndarray, ends: int, seed: int = 0) -> Attention:
    """A model before learning: slots and shares from the counts of all ids, biases from the slots' frequencies."""
    common = np.argsort(-count, kind="stable")[: SLOTS - 3]
    common = common[count[common] > 0]
    slot = np.full(len(count), RARE, np.int32)
    slot[common] = np.arange(len(common))
    share = np.where(slot == RARE, count + 0.1, 0)
    within = np.where(slot == RARE, np.log(np.maximum(share, 0.1) / max(share.sum(), 0.1)), 0.0)
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
    frequency = np.full(SLOTS, 0.5)
    frequency[: len(common)] += count[common]
    frequency[END] += ends
    frequency[len(common) : END] = 1e-6
    frequency[RARE] += count[slot == RARE].sum()
    frequency[START] = 1e-6
    f = frequency.reshape(SIDE, SIDE)
    p = {"emb": normal(SLOTS, WIDTH), "q": normal(WIDTH, WIDTH, scale=0.3), "k": normal(WIDTH, WIDTH, scale=0.3), "v": normal(WIDTH, WIDTH, scale=0.3), "o": normal(WIDTH, WIDTH, scale=0.3), "bias": np.zeros(CONTEXT + 1, np.float32), "wc": normal(WIDTH, SIDE), "bc": np.log(f.sum(1) / f.sum()).astype(np.float32), "wi": normal(SIDE, WIDTH, SIDE), "bi": np.log(f / f.sum(1, keepdims=True)).astype(np.float32)}
    return Attention(slot, within, p)


class Adam:
    """Steps that change ``p`` in place."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.first, self.second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        lr = float(rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, v in g.items():
            first, second = self.first[k], self.second[k]
            change = v - first
            change *= 0.1
            first += change
            np.multiply(v, v, out=change)
            change -= second
            change *= 0.01
            second += change
            np.sqrt(second, out=change)
            change += 1e-8
            np.divide(first, change, out=change)
            change *= lr
            self.p[k] -= change


def _examples(model: Attention, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, what their positions predict, and which of these count."""
    x, where, _ = model.stream(texts)
    use = np.zeros(len(x), bool)
    use[where] = True
    target = np.append(np.where(x[1:] == START, END, x[1:]), END)
    n = -(-len(x) // BLOCK)
    pad = n * BLOCK - len(x)
    s = np.concatenate([np.full(CONTEXT, START, np.int32), x, np.full(pad, START, np.int32)])
    target, use = np.append(target, np.full(pad, END)).reshape(n, BLOCK), np.append(use, np.zeros(pad, bool)).reshape(n, BLOCK)
    return np.lib.stride_tricks.as_strided(s, (n, BLOCK + CONTEXT), (BLOCK * s.itemsize, s.itemsize)), target, use


def train(texts: list[np.ndarray], n_ids: int, rate: float = 0.01, step_blocks: int = 2048 // BLOCK, passes: int = 2, seed: int = 0, model: Attention | None = None) -> Attention:
    """Adam over windows in a fixed random order, from ``model`` or from one with the texts' own frequencies."""
    if model is None:
        model = initial(np.bincount(np.concatenate([np.empty(0, np.uint32), *texts]).astype(np.int64), minlength=n_ids), len(texts), seed)
    if not texts:
        return model
    windows, target, use = _examples(model, texts)
    rng = np.random.default_rng(seed + 1)
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(passes)])
    steps = -(-len(order) // step_blocks)
    adam = Adam(model.p)
    for t in range(steps):
        at = order[t * step_blocks : (t + 1) * step_blocks]
        adam.step(_gradients(model.p, windows[at], target[at], use[at]), rate * (1 - t / steps))
    return Attention(model.slot, model.within, model.p)


def keep_memory() -> None:
    """Freed arrays of up to 32 MB stay with the process, 128 MB of them: else each step asks the system for its pages anew, which takes as long as its work."""
    with contextlib.suppress(OSError, AttributeError, TypeError):  # other C libraries do without
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        mallopt(-1, 1 << 27)  # M_TRIM_THRESHOLD


class Learner:
    """One pass of Adam over texts as they come, from a copy of a model's parameters; ``n`` positions so far."""

    def __init__(self, model: Attention, rate: float = 0.003, step_blocks: int = 8192 // BLOCK, seed: int = 0):
        self.model, self.rate, self.step_blocks, self.n = model, rate, step_blocks, 0
        self.p = {k: v.copy() for k, v in model.p.items()}
        self.adam, self.rng = Adam(self.p), np.random.default_rng(seed)

    def add(self, texts: list[np.ndarray]) -> None:
        windows, target, use = _examples(self.model, texts)
        order = self.rng.permutation(len(windows))
        for a in range(0, len(order), self.step_blocks):
            at = order[a : a + self.step_blocks]
            # the rate falls with the steps; a step of few windows weighs less
            self.adam.step(_gradients(self.p, windows[at], target[at], use[at]), self.rate * len(at) / self.step_blocks / np.sqrt(1 + self.adam.t / 50))
        self.n += int(use.sum())


def to_bytes(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32).tobytes()


def from_vector(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, a = {}, 0
    for k in sorted(like):
        out[k] = v[a : a + like[k].size].reshape(like[k].shape).astype(np.float32)
        a += like[k].size
    return out


def _gradients(p: dict, windows: np.ndarray, target: np.ndarray, use: np.ndarray) -> dict:
    """Of the mean negative log likelihood of the used positions.

    Queries, keys and values are rows of tables, and so are their gradients: they are summed by id before any matrix meets them.
    """
    b, emb, kind = len(windows), p["emb"], p["emb"].dtype.type
    scale, both, m = kind(1 / np.sqrt(WIDTH)), p["v"] @ p["o"], BLOCK // CONTEXT
    # a column of ones sums the weights on the way out, and takes their mean from the gradient on the way back
    kv = np.concatenate([emb @ p["k"], emb @ both, np.ones((len(emb), 1), kind)], 1).take(windows, 0)
    k, v = _parts(kv[..., :WIDTH]), _parts(kv[..., WIDTH:])
    own = windows[:, CONTEXT:].ravel()
    q = (emb @ p["q"] * scale).take(own, 0).reshape(b, m, CONTEXT, WIDTH)
    w = q @ k.swapaxes(2, 3)
    np.clip(w, -30, 30, out=w)
    np.exp(w, out=w)
    w *= _weights(p["bias"])
    c = (w @ v).reshape(-1, WIDTH + 1)
    norm = 1 / c[:, WIDTH:]
    c *= norm  # the last column is one
    used = np.flatnonzero(use.ravel())
    y = target.ravel()[used]
    order = np.argsort((y // SIDE).astype(np.uint8), kind="stable")
    used, y = used[order], y[order]
    row = np.arange(len(y))
    h = c.take(used, 0)
    h[:, :WIDTH] += emb.take(own[used], 0)
    weight = kind(1 / max(1, len(used)))
    z, cluster, edge = _logits(h, np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["wi"], p["bi"][:, None]], 1), y)
    # logits -> weighted probabilities less what they should be
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    z *= (weight / (z @ np.ones(SIDE, kind)))[..., None]
    z[0, row, cluster] -= weight
    z[1, row, y % SIDE] -= weight
    outer, inner, dh = h.T @ z[0], np.zeros((SIDE, WIDTH + 1, SIDE), kind), z[0] @ p["wc"].T
    for j in range(SIDE):
        i, e = edge[j], edge[j + 1]
        if i < e:
            np.matmul(h[i:e].T, z[1, i:e], out=inner[j])
            dh[i:e] += z[1, i:e] @ p["wi"][j].T
    dqe, dkv = np.zeros((b * BLOCK, 2 * WIDTH), kind), np.zeros((b, BLOCK + CONTEXT, 2 * WIDTH), kind)
    dqe[used, WIDTH:] = dh
    dc = np.empty((b * BLOCK, WIDTH + 1), kind)
    np.multiply(dqe[:, WIDTH:], norm, out=dc[:, :WIDTH])
    dc[:, WIDTH] = -np.einsum("ij,ij->i", dc[:, :WIDTH], c[:, :WIDTH])
    dc = dc.reshape(b, m, CONTEXT, WIDTH + 1)
    ds = dc @ v.swapaxes(2, 3)
    ds *= w
    dqe[:, :WIDTH] = (ds @ k).reshape(-1, WIDTH)
    for at, d in ((slice(WIDTH), ds.swapaxes(2, 3) @ q), (slice(WIDTH, None), w.swapaxes(2, 3) @ dc[..., :WIDTH])):
        dkv[:, :BLOCK, at] = d[:, :, :CONTEXT].reshape(b, BLOCK, WIDTH)
        dkv[:, CONTEXT:, at] += d[:, :, CONTEXT:].reshape(b, BLOCK, WIDTH)
    gq, ge = np.split(_grow(dqe, own, SLOTS), 2, axis=1)
    gk, gv = np.split(_grow(dkv.reshape(-1, 2 * WIDTH), windows.ravel(), SLOTS), 2, axis=1)
    dv = emb.T @ gv
    return {
        "wc": outer[:WIDTH], "bc": outer[WIDTH], "wi": inner[:, :WIDTH], "bi": inner[:, WIDTH], "bias": np.bincount(_NEAR[_NEAR_SEEN], ds.sum((0, 1))[_NEAR_SEEN], minlength=CONTEXT + 1).astype(kind),
        "q": emb.T @ gq * scale, "k": emb.T @ gk, "v": dv @ p["o"].T, "o": p["v"].T @ dv, "emb": ge + gq @ p["q"].T * scale + gk @ p["k"].T + gv @ both.T,
    }
