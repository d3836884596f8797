"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, emissions, decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD = 0
#: Symbols: 0 pads, 1-95 are printable ASCII, then other letters, other digits, other white space, anything else.
SYMBOLS = 100


def symbols(text: str) -> list[int]:
    out = []
    for c in text:
        o = ord(c)
        if 32 <= o < 127:
            out.append(o - 31)
        else:
            out.append(96 if c.isalpha() else 97 if c.isdigit() else 98 if c.isspace() else 99)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class BiLstmCrf:
    """params: E (symbols x embedding), for each direction W (embedding + hidden x 4 hidden) and b, then U, c (emissions), T (transitions), S (start), F (end)."""

    params: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.params["bf"].shape[0] // 4

    @classmethod
    def fresh(cls, tags: int, embedding: int = 16, hidden: int = 24, seed: int = 0) -> BiLstmCrf:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"E": draw(SYMBOLS, embedding) * 4, "U": draw(2 * hidden, tags), "c": np.zeros(tags, np.float32), "T": np.zeros((tags, tags), np.float32), "S": np.zeros(tags, np.float32), "F": np.zeros(tags, np.float32)}
        for d in "fb":
            p[f"W{d}"] = draw(embedding + hidden, 4 * hidden)
            p[f"b{d}"] = np.zeros(4 * hidden, np.float32)
            p[f"b{d}"][hidden : 2 * hidden] = 1
        return cls(p)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: time, rows, embedding. The state of rows past their end stays as it is."""
        p, h_n = self.params, self.hidden
        steps, rows, _ = x.shape
        W, b = p[f"W{d}"], p[f"b{d}"]
        pre = (x.reshape(steps * rows, -1) @ W[: x.shape[2]] + b).reshape(steps, rows, -1)
        R = W[x.shape[2] :]
        h, c = np.zeros((rows, h_n), np.float32), np.zeros((rows, h_n), np.float32)
        out, kept = np.zeros((steps, rows, h_n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ R
            gates = _sigmoid(z[:, : 3 * h_n])
            i, f, o, g = gates[:, :h_n], gates[:, h_n : 2 * h_n], gates[:, 2 * h_n :], np.tanh(z[:, 3 * h_n :])
            m = mask[t][:, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c2)
            h2 = m * (o * tc) + (1 - m) * h
            if keep:
                kept.append((t, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[t] = h
        return out, kept

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """ids: rows, time; PAD past the end. Emissions: time, rows, tags."""
        p = self.params
        mask = (ids != PAD).astype(np.float32).T
        x = p["E"][ids.T]
        hf, kf = self._run(x, mask, "f", keep)
        hb, kb = self._run(x, mask, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return both @ p["U"] + p["c"], (x, mask, both, kf, kb)

    def viterbi(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (rows, time) and, by position, how far the tag's emission is above that of tag 0."""
        e, (_, mask, *_) = self.emissions(ids)
        p = self.params
        steps, rows, _ = e.shape
        score, back = p["S"] + e[0], []
        for t in range(1, steps):
            total = score[:, :, None] + p["T"][None]
            best = total.argmax(1)
            new = np.take_along_axis(total, best[:, None], 1)[:, 0] + e[t]
            on = mask[t][:, None] > 0
            back.append(np.where(on, best, np.arange(best.shape[1])[None]))
            score = np.where(on, new, score)
        last = (score + p["F"]).argmax(1)
        tags = np.zeros((rows, steps), np.int64)
        tags[:, -1] = last
        for t in range(steps - 1, 0, -1):
            last = back[t - 1][np.arange(rows), last]
            tags[:, t - 1] = last
        tags[mask.T == 0] = 0
        margin = np.take_along_axis(e, tags.T[:, :, None], 2)[:, :, 0].T - e[:, :, 0].T
        return tags, margin

    def loss_and_gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log likelihood of the tags, by the CRF's forward-backward sums."""
        p = self.params
        e, (x, mask, both, kf, kb) = self.emissions(ids, keep=True)
        steps, rows, n = e.shape
        # Forward-backward sums over scaled probabilities; rows past their end keep what they have.
        on, high = mask > 0, e.max(2, keepdims=True)
        E, T, end = np.exp(e - high), np.exp(p["T"]), np.exp(p["F"])
        alpha, beta, scale = np.zeros_like(e), np.zeros_like(e), np.ones((steps, rows), e.dtype)
        alpha[0] = np.exp(p["S"]) * E[0]
        scale[0] = alpha[0].sum(1)
        alpha[0] /= scale[0][:, None]
        for t in range(1, steps):
            a = (alpha[t - 1] @ T) * E[t]
            scale[t] = np.where(on[t], a.sum(1), 1)
            alpha[t] = np.where(on[t][:, None], a / scale[t][:, None], alpha[t - 1])
        z = alpha[-1] @ end
        log_z = np.log(z) + (np.log(scale) + high[:, :, 0] * mask).sum(0)
        beta[-1] = end / z[:, None]
        weighted = np.zeros_like(e)
        for t in range(steps - 1, -1, -1):
            weighted[t] = E[t] * beta[t] / scale[t][:, None] * mask[t][:, None]
            if t:
                beta[t - 1] = np.where(on[t][:, None], weighted[t] @ T.T, beta[t])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        gold = np.zeros_like(e)
        np.put_along_axis(gold, tags.T[:, :, None], 1, 2)
        gold *= mask[:, :, None]
        de = (alpha * beta * mask[:, :, None] - gold) / rows
        flat2 = lambda v: v.reshape(-1, v.shape[2])
        pair = T * (flat2(alpha[:-1]).T @ flat2(weighted[1:])) - flat2(gold[:-1] * mask[1:, :, None]).T @ flat2(gold[1:])
        steps_gold = (p["T"][tags[:, :-1], tags[:, 1:]] * mask.T[:, 1:]).sum(1)
        ends = tags[np.arange(rows), mask.sum(0).astype(int) - 1]
        gold_score = (e * gold).sum((0, 2)) + p["S"][tags[:, 0]] + steps_gold + p["F"][ends]
        g["T"] = pair / rows
        g["S"] = de[0].sum(0)
        np.add.at(g["F"], ends, -1.0 / rows)
        g["F"] += (alpha[-1] * end / z[:, None]).sum(0) / rows
        flat = both.reshape(steps * rows, -1)
        g["U"], g["c"] = flat.T @ de.reshape(steps * rows, -1), de.sum((0, 1))
        dh = de @ p["U"].T
        n_h, dx = self.hidden, np.zeros_like(x)
        for d, kept, part in (("f", kf, dh[:, :, :n_h]), ("b", kb, dh[:, :, n_h:])):
            W = p[f"W{d}"]
            R, width = W[x.shape[2] :], x.shape[2]
            h_next, c_next = np.zeros((rows, n_h), np.float32), np.zeros((rows, n_h), np.float32)
            dz_all, h_all = np.zeros((steps, rows, 4 * n_h), np.float32), np.zeros((steps, rows, n_h), np.float32)
            for t, h, c, i, f, o, gg, tc, m in reversed(kept):
                dh_t = part[t] + h_next
                do = dh_t * m
                dc = c_next + do * o * (1 - tc * tc)
                dcm = dc * m
                dz = np.concatenate([dcm * gg * i * (1 - i), dcm * c * f * (1 - f), do * tc * o * (1 - o), dcm * i * (1 - gg * gg)], axis=1)
                dz_all[t], h_all[t] = dz, h
                h_next = dz @ R.T + dh_t * (1 - m)
                c_next = dcm * f + dc * (1 - m)
            flat_z = dz_all.reshape(steps * rows, -1)
            g[f"W{d}"] = np.concatenate([x.reshape(steps * rows, -1).T @ flat_z, h_all.reshape(steps * rows, -1).T @ flat_z])
            g[f"b{d}"] = flat_z.sum(0)
            dx += (flat_z @ W[:width].T).reshape(steps, rows, -1)
        np.add.at(g["E"], ids.T, dx)
        return float((log_z - gold_score).mean()), g


def train(examples: list[tuple[list[int], list[int]]], tags: int, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0, hidden: int = 24) -> BiLstmCrf:
    """Adam over shuffled batches of examples of like length; deterministic for a seed."""
    model, rng = BiLstmCrf.fresh(tags, hidden=hidden, seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.params.items()}
    v = {k: np.zeros_like(x) for k, x in model.params.items()}
    order, step = sorted(range(len(examples)), key=lambda i: len(examples[i][0])), 0
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    total = epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            some = [examples[i] for i in batches[k]]
            width = max(len(s) for s, _ in some)
            ids = np.array([s + [PAD] * (width - len(s)) for s, _ in some])
            gold = np.array([t + [0] * (width - len(t)) for _, t in some])
            _, g = model.loss_and_gradients(ids, gold)
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now, cut = rate * (1 - step / (total + 1)), min(1.0, 5.0 / (norm + 1e-9))
            for name, x in g.items():
                x = x * cut
                m[name] = 0.9 * m[name] + 0.1 * x
                v[name] = 0.999 * v[name] + 0.001 * x * x
                model.params[name] = (model.params[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model
