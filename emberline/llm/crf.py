"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows are rows of symbol numbers (0 is padding, only at the end). Training maximises
the CRF likelihood of labelled windows with Adam; everything is seeded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols: padding, letters beyond ASCII, other code points beyond ASCII, then the ASCII codes.
SYMBOLS = 3 + 128


def symbols(text: str, width: int) -> np.ndarray:
    codes = np.frombuffer(text[:width].encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    out = np.zeros(width, dtype=np.int64)
    out[:len(codes)] = np.where(codes < 128, codes + 3, np.where(codes < 0x2000, 1, 2))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name; ``hidden`` cells in each direction."""

    params: dict[str, np.ndarray]
    hidden: int
    tags: int
    #: Least posterior of a span, and precision and recall of such spans on held-out windows.
    sure: float = 0.99
    precision: float = 0.0
    recall: float = 0.0

    @classmethod
    def new(cls, tags: int, hidden: int = 24, embedding: int = 16, seed: int = 1) -> Tagger:
        rng = np.random.default_rng(seed)

        def drawn(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        params = {"embed": drawn(SYMBOLS, embedding) * 4, "out": drawn(2 * hidden, tags), "out_b": np.zeros(tags, np.float32),
                  "trans": np.zeros((tags, tags), np.float32)}
        for side in "fb":
            params[f"{side}_x"], params[f"{side}_h"] = drawn(embedding, 4 * hidden), drawn(hidden, 4 * hidden)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1  # remember at first
            params[f"{side}_b"] = bias
        return cls(params, hidden, tags)

    def _lstm(self, x: np.ndarray, side: str, mask: np.ndarray, keep: bool):
        """Outputs (rows, steps, hidden); the state stays where the mask is 0."""
        p, n = self.params, self.hidden
        pre = x @ p[f"{side}_x"] + p[f"{side}_b"]
        h = np.zeros((len(x), n), np.float32)
        c = np.zeros_like(h)
        outs, tape = np.zeros((*x.shape[:2], n), np.float32), []
        for t in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
            gates = pre[:, t] + h @ p[f"{side}_h"]
            s = _sigmoid(gates[:, :3 * n])
            i, f, o, g = s[:, :n], s[:, n:2 * n], s[:, 2 * n:], np.tanh(gates[:, 3 * n:])
            m = mask[:, t, None]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if keep:
                tape.append((t, h, c, i, f, o, g, tanh_c, m))
            c = np.where(m, new_c, c)
            h = np.where(m, o * tanh_c, h)
            outs[:, t] = h
        return outs, tape

    def emissions(self, rows: np.ndarray, keep: bool = False):
        mask = rows > 0
        x = self.params["embed"][rows]
        forward, tape_f = self._lstm(x, "f", mask, keep)
        backward, tape_b = self._lstm(x, "b", mask, keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.params["out"] + self.params["out_b"], (rows, x, both, tape_f, tape_b, mask)

    def _alphas(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        trans, out = self.params["trans"], [scores[:, 0]]
        for t in range(1, scores.shape[1]):
            step = _lse(out[-1][:, :, None] + trans, 1) + scores[:, t]
            out.append(np.where(mask[:, t, None], step, out[-1]))
        return np.stack(out, axis=1)

    def _betas(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        trans, steps = self.params["trans"], scores.shape[1]
        out = [np.zeros_like(scores[:, 0])]
        for t in range(steps - 2, -1, -1):
            step = _lse(trans + (scores[:, t + 1] + out[-1])[:, None, :], 2)
            out.append(np.where(mask[:, t + 1, None], step, out[-1]))
        return np.stack(out[::-1], axis=1)

    def marginals(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        alpha, beta = self._alphas(scores, mask), self._betas(scores, mask)
        return np.exp(alpha + beta - _lse(alpha[:, -1], 1)[:, None, None])

    def decode(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The best tag sequence of each row (padding repeats the last tag)."""
        trans = self.params["trans"]
        best, back = scores[:, 0], []
        for t in range(1, scores.shape[1]):
            ways = best[:, :, None] + trans
            at = ways.argmax(axis=1)
            m = mask[:, t, None]
            back.append(np.where(m, at, np.arange(self.tags)))
            best = np.where(m, np.take_along_axis(ways, at[:, None], 1)[:, 0] + scores[:, t], best)
        tag = best.argmax(axis=1)
        out = [tag]
        for at in reversed(back):
            tag = np.take_along_axis(at, tag[:, None], 1)[:, 0]
            out.append(tag)
        return np.stack(out[::-1], axis=1)

    def gradients(self, rows: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a batch and its gradients."""
        p, n = self.params, self.hidden
        scores, (_, x, both, tape_f, tape_b, mask) = self.emissions(rows, keep=True)
        count = len(rows)
        alpha, beta = self._alphas(scores, mask), self._betas(scores, mask)
        total = _lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        hot = np.eye(self.tags, dtype=np.float32)[gold] * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + p["trans"] + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        pair *= mask[:, 1:, None, None]
        gold_pair = np.einsum("bti,btj->ij", hot[:, :-1] * mask[:, 1:, None], hot[:, 1:])
        reached = (scores * hot).sum() + (p["trans"] * gold_pair).sum()
        loss = float((total.sum() - reached) / count)
        d_scores = ((node - hot) / count).astype(np.float32)
        grad = {"trans": ((pair.sum(axis=(0, 1)) - gold_pair) / count).astype(np.float32),
                "out": np.einsum("bth,btk->hk", both, d_scores), "out_b": d_scores.sum(axis=(0, 1))}
        d_both = d_scores @ p["out"].T
        d_x = np.zeros_like(x)
        for side, tape, d_out in (("f", tape_f, d_both[:, :, :n]), ("b", tape_b, d_both[:, :, n:])):
            d_h, d_c = np.zeros((count, n), np.float32), np.zeros((count, n), np.float32)
            d_pre = np.zeros((*x.shape[:2], 4 * n), np.float32)
            d_rec = np.zeros_like(p[f"{side}_h"])
            for t, h, c, i, f, o, g, tanh_c, m in reversed(tape):
                d_h = d_h + d_out[:, t]
                now = d_c + d_h * o * (1 - tanh_c ** 2)
                d = np.concatenate([now * g * i * (1 - i), now * c * f * (1 - f), d_h * tanh_c * o * (1 - o), now * i * (1 - g ** 2)], axis=1) * m
                d_pre[:, t] = d
                d_rec += h.T @ d
                d_h = np.where(m, d @ p[f"{side}_h"].T, d_h)
                d_c = np.where(m, now * f, d_c)
            grad[f"{side}_x"] = np.einsum("bte,btk->ek", x, d_pre)
            grad[f"{side}_h"], grad[f"{side}_b"] = d_rec, d_pre.sum(axis=(0, 1))
            d_x += d_pre @ p[f"{side}_x"].T
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], rows.reshape(-1), d_x.reshape(-1, x.shape[2]))
        return loss, grad

    def train(self, rows: np.ndarray, gold: np.ndarray, steps: int = 300, batch: int = 48, rate: float = 0.01, seed: int = 2) -> list[float]:
        """Adam with a rate that falls to zero; gives the losses."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(rows), size=min(batch, len(rows)))
            loss, grad = self.gradients(rows[pick], gold[pick])
            size = np.sqrt(sum(float((g ** 2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(size, 1e-12))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                move = (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
                self.params[k] = (self.params[k] - rate * (1 - step / (steps + 1)) * move).astype(np.float32)
            losses.append(loss)
        return losses
