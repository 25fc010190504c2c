"""A one-layer causal self-attention model over symbols (subword ids), in numpy.

Each position asks a window of symbols up to its own; what it gathers gives the shares of STATES latent states, and each state has a distribution over all symbols. The
next symbol's probability is the mixture's. Embeddings, attention and shares are learned by Adam steps, the states' distributions by online expectation-maximisation.
Relative distance enters as a learned factor of each weight.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a window, and how many of them, the last, are queries: windows overlap by the rest, and each token is scored once.
WINDOW, STRIDE = 64, 48
#: Width of keys, queries and values, and latent states.
WIDTH, STATES = 16, 32
#: Windows of one step.
BATCH = 64
#: Windows that are worked on at once, so that what belongs to them stays in a core's cache, in scoring and in training. Results don't depend on it.
SCORED, LEARNED_FROM = 32, 16
#: Columns of what a position gives: a key, a value and a 1; behind them, where gradients are taken back, is what it asks.
ASKS = 2 * WIDTH + 1
#: Bytes of a block that is asked for and given back, never touched: glibc then keeps freed arrays below that size for the next ones, whose pages would else be mapped and cleared again at each step.
HELD = 31 << 20
PARTS = ("emb", "wq", "wk", "wv", "dist", "mix", "bias", "stats")
LEARNED = PARTS[:-1]


def initial(share: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters to start from; share: of each symbol among all tokens, the border last."""
    r, n = np.random.default_rng(seed), len(share)
    normal = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
    stats = share[:, None] * np.exp(r.standard_normal((n, STATES)))
    return {
        "emb": normal(n, WIDTH, by=0.5), **{k: normal(WIDTH, WIDTH, by=0.25) for k in ("wq", "wk", "wv")}, "dist": np.zeros(WINDOW, np.float32),
        "mix": normal(WIDTH, STATES, by=0.3), "bias": np.zeros(STATES, np.float32), "stats": (stats / stats.sum()).astype(np.float32),
    }


def summed(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each key below n."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    ordered = keys.take(order)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[ordered[starts]] = np.add.reduceat(rows.take(order, axis=0), starts, axis=0)
    return out


class Attention:
    def __init__(self, params: dict[str, np.ndarray]):
        np.empty(HELD, np.uint8)
        self.params = params
        self.n = len(params["emb"])  # the last symbol is the text's border, before and after; n pads windows and gets no weight
        asks, gives = np.meshgrid(np.arange(WINDOW - STRIDE, WINDOW), np.arange(WINDOW), indexing="ij")
        self.distance = np.clip(asks - gives, 0, WINDOW - 1)
        self.causal = (gives <= asks).astype(np.float32)
        self.steps = 0
        self.moments = np.zeros((2, sum(params[k].size for k in LEARNED)), np.float32)
        self.refresh()

    def refresh(self) -> None:
        """What follows from the parameters alone, by symbol: what it gives (key, value and a 1 that sums the weights; pads have none) and what it asks."""
        p = self.params
        self.table = np.vstack([p["emb"], np.zeros((1, WIDTH), np.float32)])
        self.nearness = (np.exp(np.clip(p["dist"], -20, 20))[self.distance] * self.causal).astype(np.float32)
        self.scale = 1 / p["stats"].sum(0)  # makes distributions of the states of their counts
        self.mix = np.vstack([p["mix"], p["bias"]])
        # the last product, with zeros in place of the 1, takes gradients back to embeddings
        self.products = np.hstack([p["wk"], p["wv"], np.zeros((WIDTH, 1), np.float32), p["wq"] / np.float32(np.sqrt(WIDTH))])
        given = self.table @ self.products
        given[: self.n, 2 * WIDTH] = 1
        self.gives, self.asks = given[:, :ASKS].copy(), given[:, ASKS:].copy()

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (w, WINDOW) and targets (w, STRIDE) of texts given as symbols, border excluded; pads are n, and -1 in targets."""
        ins, outs, border = [], [], self.n - 1
        for c in texts:
            t = len(c) + 1
            blocks = -(-t // STRIDE)
            line = np.full(WINDOW - STRIDE + blocks * STRIDE, self.n, np.int32)
            line[WINDOW - STRIDE] = border
            line[WINDOW - STRIDE + 1 : WINDOW - STRIDE + t] = c
            goal = np.full(blocks * STRIDE, -1, np.int32)
            goal[: t - 1], goal[t - 1] = c, border
            ins.append(np.lib.stride_tricks.sliding_window_view(line, WINDOW)[::STRIDE])
            outs.append(goal.reshape(-1, STRIDE))
        return np.concatenate(ins), np.concatenate(outs)

    def attend(self, x: np.ndarray) -> tuple:
        """Queries, what all positions give, weights, what is gathered with a 1 behind it, and the sums of the weights."""
        q, given = self.asks.take(x[:, WINDOW - STRIDE :], axis=0), self.gives.take(x, axis=0)
        a = q @ given[..., :WIDTH].transpose(0, 2, 1)
        if a.max(initial=0) > 30:
            np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        a *= self.nearness
        h = a @ given[..., WIDTH:]
        total = np.maximum(h[..., WIDTH:], 1e-20)
        h /= total
        h[..., WIDTH] = 1
        return q, given, a, h, total

    def weights(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the states at each position, and their sum."""
        z = h.reshape(-1, WIDTH + 1) @ self.mix
        if max(z.max(initial=0), -z.min(initial=0)) > 60:  # else neither a sum nor a quotient can overflow
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z, z @ np.ones(STATES, np.float32)

    def log_probs(self, x: np.ndarray, y: np.ndarray, some: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each target, 0 at pads; and, if some symbols are marked, of any of these in its place."""
        out, states = np.zeros((2, *y.shape), np.float32), self.params["stats"] * self.scale
        marked = None if some is None else states[some].sum(0)
        for i in range(0, len(x), SCORED):
            z, total = self.weights(self.attend(x[i : i + SCORED])[3])
            goal = y[i : i + SCORED].ravel()
            log = lambda p, goal=goal, total=total: np.where(goal >= 0, np.log(np.maximum(p / total, 1e-30)), 0).reshape(-1, STRIDE)
            if some is not None:
                out[1, i : i + SCORED] = log(z @ marked)
            z *= states.take(np.maximum(goal, 0), axis=0)
            out[0, i : i + SCORED] = log(z @ np.ones(STATES, np.float32))
        return out[0] if some is None else (out[0], out[1])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss a token, its gradients, and each symbol's share of tokens by state."""
        p = self.params
        goals = np.maximum(y, 0).ravel()
        n = np.float32(max((y >= 0).sum(), 1))
        loss, near = 0.0, np.zeros(STRIDE * WINDOW, np.float32)
        mix, products = np.zeros_like(self.mix), np.zeros_like(self.products)
        given_back, shares = np.empty((x.size, WIDTH), np.float32), np.empty((y.size, STATES), np.float32)
        for i in range(0, len(x), LEARNED_FROM):
            xs, real = x[i : i + LEARNED_FROM], y[i : i + LEARNED_FROM].ravel() >= 0
            now = slice(i * STRIDE, i * STRIDE + len(real))
            q, given, a, h, total = self.attend(xs)
            pi, every = self.weights(h)
            weight = (real / n).astype(np.float32)
            r = shares[now]
            p["stats"].take(goals[now], axis=0, out=r, mode="clip")
            r *= self.scale
            r *= pi
            prob = np.maximum(r @ np.ones(STATES, np.float32), every * np.float32(1e-30))
            r *= (weight / prob)[:, None]
            pi *= (weight / every)[:, None]
            pi -= r
            mix += h.reshape(-1, WIDTH + 1).T @ pi
            dh = np.empty_like(h)  # of the sums, the last of them that of the weights
            np.divide((pi @ p["mix"].T).reshape(*h.shape[:2], WIDTH), total, out=dh[..., :WIDTH])
            np.einsum("wqd,wqd->wq", dh[..., :WIDTH], h[..., :WIDTH], out=dh[..., WIDTH])
            np.negative(dh[..., WIDTH], out=dh[..., WIDTH])
            da = dh @ given[..., WIDTH:].transpose(0, 2, 1)
            da *= a
            near += np.ones(len(xs), np.float32) @ da.reshape(len(xs), -1)
            back = np.empty((*xs.shape, ASKS + WIDTH), np.float32)
            np.matmul(da.transpose(0, 2, 1), q, out=back[..., :WIDTH])
            np.matmul(a.transpose(0, 2, 1), dh, out=back[..., WIDTH:ASKS])
            back[:, : WINDOW - STRIDE, ASKS:] = 0
            np.matmul(da, given[..., :WIDTH], out=back[:, WINDOW - STRIDE :, ASKS:])
            back = back.reshape(xs.size, -1)
            products += self.table.take(xs.ravel(), axis=0).T @ back
            np.matmul(back, self.products.T, out=given_back[i * WINDOW : i * WINDOW + xs.size])
            loss -= float(np.log(prob[real] / every[real]).sum()) / float(n)
        g = {
            "emb": summed(given_back, x.ravel(), self.n + 1)[: self.n], "wq": products[:, ASKS:] / np.float32(np.sqrt(WIDTH)), "wk": products[:, :WIDTH], "wv": products[:, WIDTH : 2 * WIDTH],
            "dist": np.bincount(self.distance.ravel(), near * self.causal.ravel(), WINDOW).astype(np.float32), "mix": mix[:WIDTH], "bias": mix[WIDTH],
        }
        return loss, g, summed(shares, goals, self.n)  # rows of pads are zero

    def train(self, x: np.ndarray, y: np.ndarray, rate: float = 0.02) -> None:
        """One step for each BATCH of windows, in their order."""
        m, s = self.moments
        for i in range(0, len(x), BATCH):
            _, g, seen = self.gradients(x[i : i + BATCH], y[i : i + BATCH])
            self.steps += 1
            k = self.steps
            now = rate / np.sqrt(1 + k / 100)
            d = np.concatenate([g[name].ravel() for name in LEARNED])
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            d = now * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-6)
            at = 0
            for name in LEARNED:
                old = self.params[name]
                self.params[name] = (old - d[at : at + old.size].reshape(old.shape)).astype(np.float32)
                at += old.size
            kept = np.float32((k + 10) ** -0.7)
            self.params["stats"] = (1 - kept) * self.params["stats"] + kept * seen
            self.params["stats"] += np.float32(1e-9)
            self.refresh()
