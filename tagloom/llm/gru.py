"""A small gated recurrent language model in numpy with a class-factored softmax.

Words 0 .. K-1 are the model's vocabulary in order of frequency, cut into C classes of equal
size; id K stands for every other word, which has a class of its own. The probability of a
word is that of its class times that of the word within the class.
"""

from __future__ import annotations

import numpy as np

EMB, HID, CLASSES = 8, 12, 32
WINDOW = 24


def init(counts: np.ndarray, other: int, end: int, seed: int = 5) -> dict[str, np.ndarray]:
    """A network that starts out as the unigram model of the given counts: those of its
    words by id, and that of all other tokens together."""
    k = len(counts)
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    size = max(1, -(-k // CLASSES))
    word = np.zeros(CLASSES * size, np.float64)
    word[:k] = counts
    word = word.reshape(CLASSES, size)
    mass = np.append(word.sum(axis=1), max(other, 0.5))
    bc, bo = np.log(np.maximum(mass, 1e-30)), np.log(np.maximum(word, 0.5))  # an empty class is never expected
    return {"emb": f(k + 1, EMB), "wx": f(EMB, 3 * HID), "wh": f(HID, 3 * HID), "b": np.zeros(3 * HID, np.float32), "wc": f(HID, CLASSES + 1) * 0.1, "bc": (bc - bc.max()).astype(np.float32), "wo": f(CLASSES, size, HID) * 0.1, "bo": (bo - bo.max(axis=1, keepdims=True)).astype(np.float32), "end": np.array(end), "k": np.array(k)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _steps(p: dict, x: np.ndarray, h: np.ndarray, keep: bool = False):
    """Hidden states after each of the inputs x (time, lane); the state starts anew where
    the input is the end of a text."""
    wx, wh, out, tape = p["emb"] @ p["wx"] + p["b"], p["wh"], np.empty((*x.shape, HID), np.float32), []
    for t, ids in enumerate(x):
        h = h * (ids != p["end"])[:, None]
        gx, gh = wx[ids], h @ wh
        zr = _sigmoid(gx[:, : 2 * HID] + gh[:, : 2 * HID])
        z, r = zr[:, :HID], zr[:, HID:]
        n = np.tanh(gx[:, 2 * HID:] + r * gh[:, 2 * HID:])
        if keep:
            tape.append((h, z, r, n, gh[:, 2 * HID:]))
        h = out[t] = n + z * (h - n)
    return out, h, tape


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _output(p: dict, hidden: np.ndarray, y: np.ndarray, grads: dict | None = None):
    """Log probability (natural) of each y given its hidden state; with grads also fills in
    the gradients of the mean loss and returns that of the hidden states."""
    size = p["wo"].shape[1]
    cls = np.where(y >= p["k"], CLASSES, y // size)
    logc = _log_softmax(hidden @ p["wc"] + p["bc"])
    rows = np.arange(len(y))
    total = logc[rows, cls].astype(np.float64)
    dh = None
    if grads is not None:
        d = np.exp(logc)
        d[rows, cls] -= 1
        d /= len(y)
        grads["wc"], grads["bc"], dh = hidden.T @ d, d.sum(axis=0), d @ p["wc"].T
        grads["wo"], grads["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
    order = np.argsort(cls, kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        at = order[bounds[c]:bounds[c + 1]]
        if not len(at):
            continue
        n = int(min(size, p["k"] - c * size))  # the last class may be short
        word = y[at] - c * size
        logw = _log_softmax(hidden[at] @ p["wo"][c, :n].T + p["bo"][c, :n])
        total[at] += logw[np.arange(len(at)), word]
        if grads is not None:
            d = np.exp(logw)
            d[np.arange(len(at)), word] -= 1
            d /= len(y)
            grads["wo"][c, :n], grads["bo"][c, :n] = d.T @ hidden[at], d.sum(axis=0)
            dh[at] += d @ p["wo"][c, :n]
    return total if grads is None else (total, dh)


def log_prob(p: dict, texts: list[np.ndarray], lanes: int = 2048) -> np.ndarray:
    """Natural log probability of each text (word ids that finish with the end).

    Texts are read side by side, window after window, each with its state carried on."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for at in range(0, len(order), lanes):
        part = order[at:at + lanes]
        lengths = np.array([len(texts[i]) for i in part])
        stream = np.concatenate([texts[i] for i in part])
        starts = np.cumsum(lengths) - lengths
        h = np.zeros((len(part), HID), np.float32)
        for t in range(0, int(lengths.max(initial=0)), WINDOW):
            live = int((lengths > t).sum())
            at_ = starts[:live, None] + t + np.arange(WINDOW)
            real = np.arange(t, t + WINDOW) < lengths[:live, None]
            y = stream[np.minimum(at_, len(stream) - 1)]
            x = stream[np.clip(at_ - 1, 0, len(stream) - 1)]
            x[:, 0] = np.where(t == 0, int(p["end"]), x[:, 0])
            states, h, _ = _steps(p, x.T, h[:live])
            lane = np.broadcast_to(np.arange(live), real.T.shape)[real.T]
            out[part[:live]] += np.bincount(lane, _output(p, states[real.T], y.T[real.T]), live)
    return out


def train(p: dict, texts: list[np.ndarray], cache: dict, lanes: int = 512, rate: float = 0.1) -> None:
    """One pass of truncated backpropagation over the texts, in place; cache holds Adagrad's sums.

    The texts are laid end to end and read in so many lanes side by side, each from its own
    place on with the word before it as its first input. The last lanes may be a word shorter;
    every word is learned from once."""
    if not texts:
        return
    stream = np.concatenate(texts)
    lanes = max(1, min(lanes, len(stream) // WINDOW))
    n = -(-len(stream) // lanes)
    at = np.arange(n)[:, None] + np.arange(lanes) * n
    real = at < len(stream)
    at = np.minimum(at, len(stream) - 1)
    y, x = stream[at], np.where(at > 0, stream[at - 1], int(p["end"]))
    h = np.zeros((lanes, HID), np.float32)
    for t in range(0, n, WINDOW):
        xs, ys, here = x[t:t + WINDOW], y[t:t + WINDOW], real[t:t + WINDOW]
        states, h, tape = _steps(p, xs, h, keep=True)
        g: dict = {}
        dh = np.zeros_like(states)
        if here.any():
            dh[here] = _output(p, states[here], ys[here], g)[1]
        g["wh"], dgx = np.zeros_like(p["wh"]), np.empty((*xs.shape, 3 * HID), np.float32)
        back = np.zeros_like(h)
        for s in range(len(xs) - 1, -1, -1):
            prev, z, r, nn, gn = tape[s]
            d = dh[s] + back
            dn = d * (1 - z) * (1 - nn * nn)
            dz = d * (prev - nn) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dgh = np.concatenate([dz, dr, dn * r], axis=1)
            dgx[s] = np.concatenate([dz, dr, dn], axis=1)
            g["wh"] += prev.T @ dgh
            back = (d * z + dgh @ p["wh"].T) * (xs[s] != p["end"])[:, None]
        flat, ids = dgx.reshape(-1, 3 * HID), xs.reshape(-1)
        g["b"], g["wx"] = flat.sum(axis=0), p["emb"][ids].T @ flat
        g["emb"] = np.stack([np.bincount(ids, c, len(p["emb"])) for c in (flat @ p["wx"].T).T], axis=1).astype(np.float32)
        for name, grad in g.items():
            grad = np.clip(grad, -1, 1)
            cache[name] = cache.get(name, 0) + grad * grad
            p[name] -= rate * grad / (np.sqrt(cache[name]) + 1e-6)
