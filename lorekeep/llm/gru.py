"""A bidirectional gated recurrent network with attention pooling, in numpy.

Arrays hold features first and windows last, so gates are contiguous. An input word is the
concatenation of its own hashed embedding and the mean of its hashed character-trigram embeddings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from lorekeep.llm.common import mix64

WORD_BUCKETS, GRAM_BUCKETS, WORD_DIM, GRAM_DIM, HIDDEN = 1 << 15, 1 << 13, 8, 8, 8
_MASKED = np.float32(-1e9)


@dataclass
class WordCodes:
    """Buckets of words and of their trigrams; trigrams of word i are grams[starts[i]:starts[i] + counts[i]]."""

    words: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    counts: np.ndarray


def encode_words(words: list[str]) -> WordCodes:
    """Hash buckets of non-empty ``words``."""
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    counts = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(int(counts.sum())) + 2 * np.repeat(np.arange(len(words)), counts)
    with np.errstate(over="ignore"):
        grams = mix64((codes[at] * np.uint64(1 << 42)) ^ (codes[at + 1] << np.uint64(21)) ^ codes[at + 2])
        place = (np.arange(len(at)) - np.repeat(starts, counts)).astype(np.uint64)
        whole = np.add.reduceat(mix64(grams + place), starts)
    return WordCodes((mix64(whole) % np.uint64(WORD_BUCKETS)).astype(np.int64), (grams % np.uint64(GRAM_BUCKETS)).astype(np.int64), starts, counts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gathered(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by their place among n."""
    return np.stack([np.bincount(at, weights=column, minlength=n) for column in rows.T], axis=1).astype(np.float32)


@dataclass
class Network:
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def initial(cls, seed: int) -> Network:
        draw = np.random.default_rng(seed)
        inputs = WORD_DIM + GRAM_DIM
        w = {"word": draw.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "gram": draw.normal(0, 0.3, (GRAM_BUCKETS, GRAM_DIM))}
        for d in "fb":
            w |= {f"{d}_in": draw.normal(0, inputs**-0.5, (3 * HIDDEN, inputs)), f"{d}_gates": draw.normal(0, HIDDEN**-0.5, (2 * HIDDEN, HIDDEN)), f"{d}_new": draw.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)), f"{d}_bias": np.zeros((3 * HIDDEN, 1))}
        w |= {"attend": draw.normal(0, 0.1, (2 * HIDDEN,)), "out": draw.normal(0, 0.5, (2 * HIDDEN,)), "bias": np.zeros(1)}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def inputs(self, codes: WordCodes) -> np.ndarray:
        """The input vectors of words, one column each; column 0 is padding."""
        grams = np.add.reduceat(self.weights["gram"][codes.grams], codes.starts) / codes.counts[:, None]
        both = np.concatenate([self.weights["word"][codes.words], grams], axis=1).T
        return np.concatenate([np.zeros((both.shape[0], 1), np.float32), both], axis=1).astype(np.float32)

    def projected(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the gates in both directions: what a word adds doesn't depend on its place."""
        w = self.weights
        return w["f_in"] @ inputs + w["f_bias"], w["b_in"] @ inputs + w["b_bias"]

    def _run(self, d: str, table: np.ndarray, index: np.ndarray, keep: list | None) -> np.ndarray:
        steps, n = index.shape
        gates, new = self.weights[f"{d}_gates"], self.weights[f"{d}_new"]
        states, h = np.empty((steps, HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = table[:, index[t]]
            a = gates @ h
            a += x[: 2 * HIDDEN]
            a *= 0.5
            np.tanh(a, out=a)
            a *= 0.5
            a += 0.5
            c = new @ (a[HIDDEN:] * h)
            c += x[2 * HIDDEN :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, h, a, c))
            h = h + a[:HIDDEN] * (c - h)
            states[t] = h
        return states

    def forward(self, tables: tuple[np.ndarray, np.ndarray], index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``index`` (steps, windows) points at table columns, 0 for padding."""
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        forth, back = (self._run(d, table, index, kept[d]) for d, table in zip("fb", tables, strict=True))
        attend, out = self.weights["attend"], self.weights["out"]
        e = np.einsum("thn,h->tn", forth, attend[:HIDDEN]) + np.einsum("thn,h->tn", back, attend[HIDDEN:])
        e[index == 0] = _MASKED
        e -= e.max(0)
        a = np.exp(e)
        a /= a.sum(0)
        score = np.einsum("thn,h->tn", forth, out[:HIDDEN]) + np.einsum("thn,h->tn", back, out[HIDDEN:])
        if keep is not None:
            keep |= {"kept": kept, "states": (forth, back), "a": a}
        return (a * score).sum(0) + self.weights["bias"]

    def gradients(self, codes: WordCodes, index: np.ndarray, y: np.ndarray, weight: np.ndarray, drop: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss. ``drop`` marks words whose own embedding is hidden, so that characters have to do."""
        w, keep, g = self.weights, {}, {}
        inputs = self.inputs(codes)
        inputs[:WORD_DIM, 1:][:, drop] = 0
        logits = self.forward(self.projected(inputs), index, keep)
        dlogit = ((_sigmoid(logits) - y) * weight / weight.sum()).astype(np.float32)
        a, (forth, back) = keep["a"], keep["states"]
        g["bias"] = dlogit.sum(keepdims=True)
        pooled = [np.einsum("tn,thn->hn", a, s) for s in (forth, back)]
        g["out"] = np.concatenate([p @ dlogit for p in pooled])
        ds = [w["out"][k * HIDDEN : (k + 1) * HIDDEN, None] * dlogit for k in (0, 1)]
        da = sum(np.einsum("hn,thn->tn", d, s) for d, s in zip(ds, (forth, back), strict=True))
        de = a * (da - (a * da).sum(0))
        g["attend"] = np.concatenate([np.einsum("tn,thn->h", de, s) for s in (forth, back)])
        dinputs, order = np.zeros_like(inputs), np.argsort(index, axis=None, kind="stable")
        columns, first = np.unique(index.ravel()[order], return_index=True)
        for k, d in enumerate("fb"):
            gates, new, attend = w[f"{d}_gates"], w[f"{d}_new"], w["attend"][k * HIDDEN : (k + 1) * HIDDEN, None]
            dgates, dnew, dtable = np.zeros_like(gates), np.zeros_like(new), np.zeros((3 * HIDDEN, inputs.shape[1]), np.float32)
            carry, dx = 0.0, np.empty((len(a), index.shape[1], 3 * HIDDEN), np.float32)
            for t, h, s, c in reversed(keep["kept"][d]):
                dh = carry + a[t] * ds[k] + de[t] * attend
                z, r = s[:HIDDEN], s[HIDDEN:]
                dc = dh * z * (1 - c * c)
                drh = new.T @ dc
                ds_ = np.concatenate([dh * (c - h), drh * h]) * s * (1 - s)
                dnew += dc @ (r * h).T
                dgates += ds_ @ h.T
                carry = dh * (1 - z) + drh * r + gates.T @ ds_
                dx[t] = np.concatenate([ds_, dc]).T
            dtable[:, columns] = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first).T
            g[f"{d}_gates"], g[f"{d}_new"], g[f"{d}_bias"] = dgates, dnew, dtable.sum(1, keepdims=True)
            g[f"{d}_in"] = dtable @ inputs.T
            dinputs += w[f"{d}_in"].T @ dtable
        dwords = dinputs[:, 1:].T
        g["word"] = _gathered(codes.words[~drop], dwords[~drop, :WORD_DIM], WORD_BUCKETS)
        g["gram"] = _gathered(codes.grams, np.repeat(dwords[:, WORD_DIM:] / codes.counts[:, None], codes.counts, axis=0), GRAM_BUCKETS)
        return g


class Adam:
    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.steps = network, rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in network.weights.items()} for _ in range(2))

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
        for k, g in gradients.items():
            g = g * np.float32(min(1.0, 5.0 / (norm + 1e-12)))
            m, v = self.first[k], self.second[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            rate = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
            self.network.weights[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
