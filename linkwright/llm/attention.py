"""A causal self-attention model in numpy: forward, backward, training and parameter averaging.

The model predicts the class of the next token. Its logits are a prior (how often each class follows the token before,
from counts) plus what one attention layer reads from the window: e = embedding + place, o = attention of e over all
places up to its own, h = e + o, logits = prior + h W + b. Arrays that a batch needs are kept between batches.
"""

from __future__ import annotations

import numpy as np

#: Tokens that a window scores, tokens before them that it also sees, and sizes of the model.
STRIDE, CONTEXT, WIDTH, CLASSES, INPUTS = 32, 16, 16, 128, 2048
LENGTH = STRIDE + CONTEXT
BEGIN, PAD = INPUTS - 2, INPUTS - 1
SHAPES = {"embed": (INPUTS, WIDTH), "place": (LENGTH, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "mix": (WIDTH, WIDTH), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
#: Windows of a batch: its largest array stays in the cache.
BATCH = 32
#: Logits within this have exponentials, and sums of them, that single precision holds.
LARGE = 60
_FUTURE = np.where(np.arange(LENGTH)[None, :] > np.arange(CONTEXT, LENGTH)[:, None], np.float32(-1e9), np.float32(0))


def initial(seed: int) -> np.ndarray:
    """All parameters as one vector; the output layer starts at zero, so that the prior alone predicts."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    for name, part in views(flat).items():
        if name not in ("out", "bias"):
            part[...] = rng.standard_normal(part.shape) * (0.3 if name == "embed" else 0.1 if name == "place" else WIDTH**-0.5)
    return flat


def moderate(a: np.ndarray) -> bool:
    """Whether exponentials of a and their sums by row need no greatest value taken off first."""
    return bool(-LARGE < a.min() <= a.max() < LARGE)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


class Machine:
    """Batches of at most BATCH windows through the model with these parameters (a vector that training changes)."""

    def __init__(self, flat: np.ndarray, prior: np.ndarray):
        self.flat, self.p, self.prior = flat, views(flat), prior
        f = np.float32
        self.e, self.all = np.empty((BATCH, LENGTH, WIDTH), f), np.empty((BATCH * LENGTH, 3 * WIDTH), f)
        self.s, self.o = np.empty((BATCH, STRIDE, LENGTH), f), np.empty((BATCH, STRIDE, WIDTH), f)
        self.h, self.logits = np.empty((BATCH * STRIDE, WIDTH), f), np.empty((BATCH * STRIDE, CLASSES), f)
        self.rows = np.empty((BATCH * STRIDE, CLASSES), f)
        self.ds, self.dall = np.empty_like(self.s), np.empty_like(self.all)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Logits, but for a constant of each row, of the scored places of windows x (inputs; x[:, CONTEXT + j] is before place j)."""
        n, p = len(x), self.p
        e, s, o = self.e[:n], self.s[:n], self.o[:n]
        np.take(p["embed"], x, axis=0, out=e, mode="clip")
        e += p["place"]
        flat = np.matmul(e.reshape(-1, WIDTH), p["qkv"], out=self.all[: n * LENGTH]).reshape(n, LENGTH, 3 * WIDTH)
        np.matmul(flat[:, CONTEXT:, :WIDTH], flat[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1), out=s)
        s *= np.float32(WIDTH**-0.5)
        small = moderate(s)
        s += _FUTURE
        if (empty := x[:, :CONTEXT] == PAD).any():
            s[:, :, :CONTEXT] += np.where(empty, np.float32(-1e9), np.float32(0))[:, None, :]
        if not small:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= (s @ np.ones(LENGTH, np.float32))[:, :, None]
        np.matmul(s, flat[:, :, 2 * WIDTH :], out=o)
        h = np.matmul(o.reshape(-1, WIDTH), p["mix"], out=self.h[: n * STRIDE])
        h += e[:, CONTEXT:].reshape(-1, WIDTH)
        logits = np.matmul(h, p["out"], out=self.logits[: n * STRIDE])
        logits += np.take(self.prior, x[:, CONTEXT:].ravel(), axis=0, out=self.rows[: n * STRIDE], mode="clip")
        logits += p["bias"]
        if not moderate(logits):
            logits -= logits.max(axis=1, keepdims=True)
        return logits

    def log_probabilities(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of the class target[i, j] at scored place j of window i."""
        out = np.empty(target.shape, np.float64)
        for lo in range(0, len(x), BATCH):
            logits, y = self.forward(x[lo : lo + BATCH]), target[lo : lo + BATCH]
            chosen = logits[np.arange(len(logits)), y.ravel()]
            np.exp(logits, out=logits)
            out[lo : lo + BATCH] = (chosen - np.log(logits @ np.ones(CLASSES, np.float32))).reshape(y.shape)
        return out

    def gradient(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of the weighted mean cross entropy of one batch, as a vector."""
        n, p = len(x), self.p
        logits = self.forward(x)
        e, s, o, h = self.e[:n], self.s[:n], self.o[:n], self.h[: n * STRIDE]
        every = self.all[: n * LENGTH].reshape(n, LENGTH, 3 * WIDTH)
        q, k, v = every[:, CONTEXT:, :WIDTH], every[:, :, WIDTH : 2 * WIDTH], every[:, :, 2 * WIDTH :]
        np.exp(logits, out=logits)
        logits *= (weight.ravel() / max(1.0, float(weight.sum())) / (logits @ np.ones(CLASSES, np.float32)))[:, None]
        logits[np.arange(len(logits)), target.ravel()] -= weight.ravel() / np.float32(max(1.0, float(weight.sum())))
        out = np.zeros(SIZE, np.float32)
        g = views(out)
        np.matmul(h.T, logits, out=g["out"])
        logits.sum(axis=0, out=g["bias"])
        dh = logits @ p["out"].T
        np.matmul(o.reshape(-1, WIDTH).T, dh, out=g["mix"])
        do = (dh @ p["mix"].T).reshape(n, STRIDE, WIDTH)
        ds, dall = self.ds[:n], self.dall[: n * LENGTH].reshape(n, LENGTH, 3 * WIDTH)
        np.matmul(do, v.transpose(0, 2, 1), out=ds)
        np.matmul(s.transpose(0, 2, 1), do, out=dall[:, :, 2 * WIDTH :])
        ds -= np.einsum("ijk,ijk->ij", ds, s)[:, :, None]
        ds *= s
        ds *= np.float32(WIDTH**-0.5)
        dall[:, :CONTEXT, :WIDTH] = 0
        np.matmul(ds, k, out=dall[:, CONTEXT:, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=dall[:, :, WIDTH : 2 * WIDTH])
        flat = dall.reshape(-1, 3 * WIDTH)
        np.matmul(e.reshape(-1, WIDTH).T, flat, out=g["qkv"])
        de = (flat @ p["qkv"].T).reshape(n, LENGTH, WIDTH)
        de[:, CONTEXT:] += dh.reshape(n, STRIDE, WIDTH)
        de.sum(axis=0, out=g["place"])
        at = x.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
        g["embed"][...] = np.bincount(at.ravel(), de.ravel(), INPUTS * WIDTH).reshape(INPUTS, WIDTH)
        return out


def train(flat: np.ndarray, prior: np.ndarray, batches, rate: float = 0.01) -> int:
    """Adam over (x, target, weight) batches, once each; changes flat and returns the number of windows."""
    machine, first, second, seen, step = Machine(flat, prior), np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0, 0
    for x, target, weight in batches:
        step += 1
        seen += len(x)
        g = machine.gradient(x, target, weight)
        first += np.float32(0.1) * (g - first)
        g *= g
        second += np.float32(0.01) * (g - second)
        pace = rate * min(1.0, step / 50) / (1 + step / 2000) ** 0.5
        flat -= (pace / (1 - 0.9**step)) * first / (np.sqrt(second * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))
    return seen


def windows(inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, picks: np.ndarray | None = None):
    """(x, targets, which scored places hold a token, place of each in the stream) of overlapping windows.

    inputs and targets hold one value per token of all texts, first the offset of each text and of the end. Every
    token is scored in one window, after CONTEXT tokens of its text or as many as there are. picks limits the windows.
    """
    sizes = np.diff(first)
    per_text = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    if picks is not None:
        text, nth = text[picks], nth[picks]
    start = nth * STRIDE
    seen = start[:, None] - CONTEXT - 1 + np.arange(LENGTH)[None, :]
    inside = (seen >= 0) & (seen < sizes[text][:, None])
    at = first[text][:, None] + seen
    x = np.where(inside, inputs[np.where(inside, at, 0)], np.where(seen == -1, BEGIN, PAD))
    goal = start[:, None] + np.arange(STRIDE)[None, :]
    real = goal < sizes[text][:, None]
    place = np.where(real, first[text][:, None] + goal, 0)
    return x, targets[place], real, place
