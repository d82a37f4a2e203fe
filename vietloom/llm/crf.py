"""A linear-chain conditional random field in numpy: features of distinct tokens, batches of rows, Viterbi."""

from __future__ import annotations

import io
import zlib

import numpy as np


class TokenCrf:
    """Scores of a position are sums over ``offsets`` of the weights of that neighbour's features.

    Features belong to distinct tokens, so their weights are summed once per token, and a row only gathers.
    """

    def __init__(self, states: int, features, offsets: tuple[int, ...] = (-3, -2, -1, 0, 1, 2, 3), bits: int = 14):
        self.s, self.features, self.offsets, self.dim = states, features, offsets, 1 << bits
        self.w = np.zeros((len(offsets), self.dim, states), np.float32)
        self.t = np.zeros((states, states), np.float32)
        self.start = np.zeros(states, np.float32)
        self.cache: dict[str, int] = {}
        self.table = np.zeros((0, len(offsets), states), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "table": np.zeros((0, len(self.offsets), self.s), np.float32)}

    def dump(self) -> bytes:
        """The weights as an archive of arrays."""
        out = io.BytesIO()
        np.savez_compressed(out, w=self.w, t=self.t, start=self.start)
        return out.getvalue()

    def load(self, archive: bytes) -> TokenCrf:
        with np.load(io.BytesIO(archive), allow_pickle=False) as z:
            self.w, self.t, self.start = z["w"], z["t"], z["start"]
        self.cache, self.table = {}, self.table[:0]
        return self

    def ids(self, token: str) -> list[int]:
        return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & (self.dim - 1) for f in self.features(token)]

    # -- training ---------------------------------------------------------------------------------------------------
    def fit(self, rows: list[list[str]], labels: list[list[int]], epochs: int = 40, rate: float = 0.12, l2: float = 1e-4) -> TokenCrf:
        n, width = len(rows), max(map(len, rows))
        vocab: dict[str, int] = {}
        tok = np.full((n, width), -1, np.int64)
        y = np.zeros((n, width), np.int64)
        for i, (r, g) in enumerate(zip(rows, labels, strict=True)):
            tok[i, : len(r)] = [vocab.setdefault(t, len(vocab)) for t in r]
            y[i, : len(r)] = g
        on = tok >= 0
        feats = [self.ids(t) for t in vocab]
        fid, own = np.array([f for x in feats for f in x]), np.repeat(np.arange(len(vocab)), [len(x) for x in feats])
        shifted = []
        for o in self.offsets:
            s = np.full_like(tok, -1)
            if o < 0:
                s[:, -o:] = tok[:, :o]
            elif o > 0:
                s[:, :-o] = tok[:, o:]
            else:
                s = tok
            shifted.append(np.where(on & (s >= 0), s, -1))
        gold = np.eye(self.s, dtype=np.float32)[y] * on[..., None]
        gt = np.zeros_like(self.t)
        both = on[:, 1:]
        np.add.at(gt, (y[:, :-1][both], y[:, 1:][both]), 1)
        params = [self.w, self.t, self.start]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, epochs + 1):
            e = np.zeros((n, width, self.s), np.float32)
            for j in range(len(self.offsets)):
                a = np.zeros((len(vocab) + 1, self.s), np.float32)
                np.add.at(a, own, self.w[j][fid])
                e += a[shifted[j]]  # index -1 is the empty last row
            post, pair = self._posterior(e, on)
            g = (gold - post) / n
            gw = np.zeros_like(self.w)
            for j in range(len(self.offsets)):
                ok = shifted[j] >= 0
                where, val = shifted[j][ok], g[ok]
                per = np.stack([np.bincount(where, val[:, s], len(vocab)) for s in range(self.s)], 1)
                gw[j] = np.stack([np.bincount(fid, per[own, s], self.dim) for s in range(self.s)], 1)
            grads = [gw - l2 * self.w, (gt - pair) / n, g[:, 0].sum(0)]
            for k, (p, d) in enumerate(zip(params, grads, strict=True)):
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                p += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def _posterior(self, e: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width, _ = e.shape
        x = np.exp(e - e.max(axis=2, keepdims=True))
        t = np.exp(self.t)
        alpha, beta = np.zeros_like(x), np.ones_like(x)
        a = np.exp(self.start) * x[:, 0]
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for i in range(1, width):
            a = (alpha[:, i - 1] @ t) * x[:, i]
            a /= a.sum(1, keepdims=True)
            alpha[:, i] = np.where(on[:, i : i + 1], a, alpha[:, i - 1])
        pair = np.zeros_like(self.t)
        for i in range(width - 2, -1, -1):
            b = beta[:, i + 1] * x[:, i + 1]
            nb = b @ t.T
            nb /= nb.sum(1, keepdims=True)
            beta[:, i] = np.where(on[:, i + 1 : i + 2], nb, 1)
            live = on[:, i + 1]
            al, bl = alpha[live, i], b[live]
            z = ((al @ t) * bl).sum(1, keepdims=True)
            pair += (al / z).T @ bl * t
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        return post * on[..., None], pair

    # -- decoding ---------------------------------------------------------------------------------------------------
    def _rows(self, tokens: list[str]) -> np.ndarray:
        """Table row of each distinct token, computed once a task."""
        if len(self.cache) > 400_000:
            self.cache, self.table = {}, self.table[:0]
        new = [t for t in tokens if t not in self.cache]
        if new:
            add = np.empty((len(new), len(self.offsets), self.s), np.float32)
            for i, t in enumerate(new):
                self.cache[t] = len(self.table) + i
                add[i] = self.w[:, self.ids(t)].sum(1)
            self.table = np.concatenate([self.table, add])
        return np.array([self.cache[t] for t in tokens], np.int64)

    def emissions(self, off: np.ndarray, distinct: list[str], which: np.ndarray) -> np.ndarray:
        """Scores of every flat position; ``which`` points into ``distinct``."""
        rows = self._rows(distinct)[which]
        own = np.repeat(np.arange(len(off) - 1), np.diff(off))
        n = len(rows)
        e = np.zeros((n, self.s), np.float32)
        for j, o in enumerate(self.offsets):
            lo, hi = max(0, -o), n - max(0, o)
            if hi <= lo:
                continue
            add = self.table[rows[lo + o : hi + o], j]
            add[own[lo + o : hi + o] != own[lo:hi]] = 0
            e[lo:hi] += add
        return e

    def decode(self, off: np.ndarray, distinct: list[str], which: np.ndarray) -> np.ndarray:
        """The best state of every flat position; state 0 is the outside.

        Rows where no position can outweigh the best possible gain of transitions are all outside: that is exact, and
        the rest goes through Viterbi, rows of like length together.
        """
        e = self.emissions(off, distinct, which)
        out = np.zeros(len(e), np.int8)
        if not len(e):
            return out
        size = np.diff(off)
        gain = max(float(self.t.max() - self.t[0, 0]), float(self.start.max() - self.start[0]), 0.0)
        open_ = (e[:, 1:].max(1) - e[:, 0] + 2 * gain) >= 0
        live = np.nonzero((np.add.reduceat(np.append(open_, False).astype(np.int64), off[:-1].clip(max=len(e))) > 0) & (size > 0))[0]
        live = live[np.argsort(size[live], kind="stable")]
        i = 0
        while i < len(live):
            j = i
            while j < len(live) and (j == i or (j - i + 1) * size[live[j]] <= 60_000):
                j += 1
            part = live[i:j]
            width = int(size[part].max())
            at = off[part][:, None] + np.minimum(np.arange(width), size[part][:, None] - 1)
            x = e[at]
            on = np.arange(width) < size[part][:, None]
            score = self.start + x[:, 0]
            back = np.zeros((len(part), width, self.s), np.int8)
            for k in range(1, width):
                c = score[:, :, None] + self.t
                back[:, k] = c.argmax(1)
                new = c.max(1) + x[:, k]
                stay = ~on[:, k]
                new[stay] = score[stay]
                back[stay, k] = np.arange(self.s)
                score = new
            state = score.argmax(1)
            for k in range(width - 1, -1, -1):
                live_k = on[:, k]
                out[off[part][live_k] + k] = state[live_k]
                state = back[np.arange(len(part)), k, state]
            i = j
        return out
