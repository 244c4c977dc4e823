"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

Texts are read in overlapping windows, which give each character scores of its labels; where windows overlap, a
character takes those of the window in which it lies deeper.  The joined scores of a text are decoded by one Viterbi over
the CRF, so that its labels are the best sequence as a whole, wherever the windows were cut.

A caller may name the characters near which labels other than 0 are possible at all.  Then only stretches around them
are read; all other characters have label 0 and the best sequence is the one under that condition.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Character classes: 0 pads, ASCII has one each, then letters and other characters beyond ASCII.
_LIMIT = 0x300
CLASSES = np.full(_LIMIT + 1, 128, dtype=np.uint8)
CLASSES[:128] = np.maximum(1, np.arange(128))
for _c in range(128, _LIMIT):
    CLASSES[_c] = 128 if chr(_c).isalpha() else 129
CLASSES[_LIMIT] = 128
VOCABULARY = 130

Weights = dict[str, np.ndarray]


def classes(text: str) -> np.ndarray:
    return CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _LIMIT)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(w: Weights, d: str, x: np.ndarray) -> tuple:
    """All states of one direction over x (time, batch), for training."""
    steps, batch = x.shape
    hidden = w["U" + d].shape[0]
    h, c = np.zeros((steps + 1, batch, hidden), np.float32), np.zeros((steps + 1, batch, hidden), np.float32)
    gates = np.empty((steps, batch, 4 * hidden), np.float32)
    tc = np.empty((steps, batch, hidden), np.float32)
    for t in range(steps):
        z = w["T" + d][x[t]] + h[t] @ w["U" + d]
        z[:, : 3 * hidden] = _sigmoid(z[:, : 3 * hidden])
        z[:, 3 * hidden :] = np.tanh(z[:, 3 * hidden :])
        i, f, o, g = np.split(z, 4, axis=1)
        c[t + 1] = f * c[t] + i * g
        tc[t] = np.tanh(c[t + 1])
        h[t + 1] = o * tc[t]
        gates[t] = z
    return h, c, gates, tc


def _back(w: Weights, d: str, x: np.ndarray, states: tuple, dh_out: np.ndarray) -> dict[str, np.ndarray]:
    h, c, gates, tc = states
    steps, batch, hidden = tc.shape
    dz = np.empty_like(gates)
    dh, dc = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = np.split(gates[t], 4, axis=1)
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc[t] ** 2)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c[t] * f * (1 - f), dh * tc[t] * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dh, dc = dz[t] @ w["U" + d].T, dc * f
    flat = dz.reshape(-1, 4 * hidden)
    one_hot = np.zeros((steps * batch, VOCABULARY), np.float32)
    one_hot[np.arange(steps * batch), x.ravel()] = 1
    return {"T" + d: one_hot.T @ flat, "U" + d: h[:-1].reshape(-1, hidden).T @ flat}


def _crf(e: np.ndarray, a: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of labels y under scores e (time, batch, label), and its gradients.

    Forward and backward sums are kept as probabilities, scaled at each step.
    """
    steps, batch, k = e.shape
    top, most = e.max(axis=2, keepdims=True), a.max()
    own, move = np.exp(e - top), np.exp(a - most)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, batch, 1), e.dtype)
    for t in range(steps):
        now = own[t] * (alpha[t - 1] @ move) if t else own[0]
        scale[t] = now.sum(axis=1, keepdims=True)
        alpha[t] = now / scale[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = (own[t + 1] * beta[t + 1]) @ move.T / scale[t + 1]
    de = alpha * beta
    into = (own[1:] * beta[1:] / scale[1:]).reshape(-1, k)
    da = move * (alpha[:-1].reshape(-1, k).T @ into)
    total = np.log(scale).sum(axis=(0, 2)) + top.sum(axis=(0, 2)) + (steps - 1) * most
    rows = np.arange(batch)
    at = np.arange(steps)[:, None]
    gold = e[at, rows, y].sum(0) + a[y[:-1], y[1:]].sum(0)
    de[at, rows, y] -= 1
    da -= np.bincount((y[:-1] * k + y[1:]).ravel(), minlength=k * k).reshape(k, k)
    return float((total - gold).mean()), de / batch, da / batch


def train(batches, labels: int, hidden: int = 12, rate: float = 0.03, seed: int = 5) -> Weights:
    """Fits the tagger to an iterable of (classes, labels), both (time, batch), by Adam."""
    rng = np.random.default_rng(seed)
    w: Weights = {}
    for d in "fb":
        w["T" + d] = rng.normal(0, 0.3, (VOCABULARY, 4 * hidden)).astype(np.float32)
        w["T" + d][:, hidden : 2 * hidden] += 1
        w["U" + d] = rng.normal(0, 0.3, (hidden, 4 * hidden)).astype(np.float32)
        w["W" + d] = rng.normal(0, 0.3, (hidden, labels)).astype(np.float32)
    w["b"], w["A"] = np.zeros(labels, np.float32), np.zeros((labels, labels), np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    batches = list(batches)
    for step, (x, y) in enumerate(batches, 1):
        f, r = _run(w, "f", x), _run(w, "b", x[::-1])
        hf, hb = f[0][1:], r[0][1:][::-1]
        _, de, da = _crf(hf @ w["Wf"] + hb @ w["Wb"] + w["b"], w["A"], y)
        flat = de.reshape(-1, labels)
        g = {"A": da, "b": flat.sum(0), "Wf": hf.reshape(-1, hidden).T @ flat, "Wb": hb.reshape(-1, hidden).T @ flat}
        g |= _back(w, "f", x, f, de @ w["Wf"].T) | _back(w, "b", x[::-1], r, (de @ w["Wb"].T)[::-1])
        size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        now = rate * min(1.0, 4 * (1 - step / (len(batches) + 1)))
        for k in w:
            gk = g[k] * min(1.0, 5 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.99 * v[k] + 0.01 * gk**2
            w[k] = (w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w


class Tagger:
    def __init__(self, w: Weights, window: int = 256, overlap: int = 64, batch: int = 1024, context: int = 32, cells: int = 1 << 19):
        self.window, self.overlap, self.batch, self.context, self.cells = window, overlap, batch, context, cells
        self.hidden, self.labels = w["Wf"].shape
        half = np.ones(4 * self.hidden, np.float32)
        half[: 3 * self.hidden] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.directions = [(np.ascontiguousarray((w["T" + d] * half).T), np.ascontiguousarray((w["U" + d] * half).T), np.ascontiguousarray(w["W" + d].T)) for d in "fb"]
        self.bias, self.moves = w["b"], w["A"]

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores (time, label, batch) of windows x (time, batch)."""
        steps, batch = x.shape
        n = self.hidden
        out = np.empty((steps, self.labels, batch), np.float32)
        out[:] = self.bias[None, :, None]
        z, add = np.empty((4 * n, batch), np.float32), np.empty((4 * n, batch), np.float32)
        for (table, across, up), order in zip(self.directions, (range(steps), range(steps - 1, -1, -1)), strict=True):
            h, c = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32)
            ig = np.empty((n, batch), np.float32)
            for t in order:
                np.take(table, x[t], axis=1, out=z, mode="clip")
                np.matmul(across, h, out=add)
                z += add
                np.tanh(z, out=z)
                gates = z[: 3 * n]
                gates *= 0.5
                gates += 0.5
                np.multiply(z[:n], z[3 * n :], out=ig)
                c *= z[n : 2 * n]
                c += ig
                np.tanh(c, out=h)
                h *= z[2 * n : 3 * n]
                out[t] += up @ h
        return out

    def _viterbi(self, e: np.ndarray, lengths: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """The best paths through scores (time, label, batch) of sequences, longest first.

        `inner` and `outer` say which begin and end within their text, next to a character of label 0.
        """
        steps, k, batch = e.shape
        came = np.zeros((steps, k, batch), np.uint8)
        best = e[0] + np.where(inner, self.moves[0][:, None], 0)
        last = best + np.where(outer, self.moves[:, 0][:, None], 0)
        for t in range(1, steps):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # those longer than t
            now = best[:, None, :n] + self.moves[:, :, None]
            came[t, :, :n] = now.argmax(axis=0)
            best = now.max(axis=0) + e[t, :, :n]
            last[:, :n] = best + np.where(outer[:n], self.moves[:, 0][:, None], 0)
        path = np.zeros((steps, batch), np.uint8)
        rows = np.arange(batch)
        label = last.argmax(axis=0).astype(np.uint8)
        for t in range(steps - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            path[t, :n] = label[:n]
            if t:
                label[:n] = came[t, label[:n], rows[:n]]
        return path

    def _stretches(self, ends: np.ndarray, near: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of what is read, and the bounds of the texts they lie in."""
        starts = np.concatenate([[0], ends[:-1]])
        if near is None:
            some = ends > starts
            return starts[some], ends[some], starts[some], ends[some]
        text = np.searchsorted(ends, near, side="right")
        a, b = np.maximum(near - self.context, starts[text]), np.minimum(near + self.context + 1, ends[text])
        new = np.append(True, (a[1:] > b[:-1]) | (text[1:] != text[:-1]))[: len(a)]
        old = np.append(new[1:], True)[: len(a)]
        return a[new], b[old], starts[text[new]], ends[text[new]]

    def tag(self, texts: list[str], near: np.ndarray | None = None) -> list[np.ndarray]:
        """A label for each character of each text; `near` are places in the joined texts around which to read, in order."""
        codes = classes("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        labels = np.zeros(len(codes), np.uint8)
        a, b, text_a, text_b = self._stretches(ends, near) if len(codes) else [np.zeros(0, np.int64)] * 4
        if not len(a):
            return np.split(labels, ends[:-1])
        place = np.cumsum(b - a) - (b - a)  # where a stretch's scores begin
        scores = np.empty((int((b - a).sum()), self.labels), np.float32)
        step = self.window - self.overlap
        many = np.maximum(1, -(-(b - a - self.overlap) // step))
        own = np.repeat(np.arange(len(a)), many)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        start = a[own] + nth * step
        first = np.where(nth == 0, start, start + self.overlap // 2)
        last = np.where(nth == many[own] - 1, b[own], start + step + self.overlap // 2)
        stop = b[own]
        codes = np.append(codes, np.zeros(self.window, np.uint8))
        t = np.arange(self.window)[:, None]
        order = np.argsort(-np.minimum(self.window, stop - start), kind="stable")
        for i in range(0, len(start), self.batch):
            w = order[i : i + self.batch]
            at = start[w][None, :] + t
            at = at[: int(min(self.window, (stop[w] - start[w]).max()))]
            e = self._emissions(np.where(at < stop[w], codes[at], 0))
            keep = (at >= first[w]) & (at < last[w])
            to = place[own[w]][None, :] + at - a[own[w]][None, :]
            scores[to[keep]] = e.transpose(0, 2, 1)[keep]
        order = np.argsort(a - b, kind="stable")
        i = 0
        while i < len(order):
            longest = int((b - a)[order[i]])
            s = order[i : i + max(1, min(self.batch, self.cells // longest))]
            i += len(s)
            lengths = (b - a)[s]
            t = np.arange(longest)[:, None]
            inside = t < lengths[None, :]
            e = scores[np.where(inside, place[s][None, :] + t, 0)].transpose(0, 2, 1)
            path = self._viterbi(e, lengths, a[s] > text_a[s], b[s] < text_b[s])
            labels[(a[s][None, :] + t)[inside]] = path[inside]
        return np.split(labels, ends[:-1])


@lru_cache(2)
def loaded(parts: tuple) -> Tagger:
    return Tagger({k: np.frombuffer(raw, np.float32).reshape(shape) for k, shape, raw in parts})


def packed(w: Weights) -> tuple:
    return tuple((k, x.shape, x.astype(np.float32).tobytes()) for k, x in sorted(w.items()))
