"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input joins a word vector (frequent words of the sample; one vector for all others) and the mean of its
letter n-gram vectors, so unseen words are read by their letters. Two gated recurrent layers run over a window of
`window` words in both directions; attention pools their states into the window's logit. A text's score is that of its
highest window among all overlapping windows (a new one every `stride` words, the last one reaching the end).

Training knows labels of whole texts only. It starts with random windows under their text's label, then goes on with
the highest windows of each text (of a text without the label, every window is a negative). The final bias is set so
that 0.5 splits the sample best. The sample is bounded: about `sample_docs` texts of each label, picked by hash.

Defined results. Null text and text without letters: score 0. Repeated rows: equal scores. Repeated or conflicting
labels of a document: the largest counts. Without both labels in the sample every score is 0. Null ids: scored, never
learnt from. Very long texts: all windows. Empty tables: empty results. Extra columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import small_batches
from keyloom.llm.language_id import grams, words_of
from keyloom.llm.packing import slices

GRAM_ROWS = 1 << 15
WORD_DIM, GRAM_DIM, HIDDEN = 8, 8, 8
BATCH, LEAST_STEPS = 192, 40


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    """Parameters by name, all float32. fw and bw: input, recurrent and bias weights of the gates z, r and state c."""

    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]
    shift: float = 0.0

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of distinct words."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        hashed, owner = grams(words)
        return np.concatenate([self.weights["words"][ids], mean_rows(self.weights["grams"], hashed % GRAM_ROWS, owner, len(words))], axis=1)

    def logits(self, projected: tuple[np.ndarray, np.ndarray], index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows: index [windows, steps] into the projected inputs, mask of real words."""
        w = self.weights
        n, steps = index.shape
        both = np.empty((steps, n, 2 * HIDDEN), np.float32)
        full = mask.all()
        for side, name, order in ((0, "fw", range(steps)), (1, "bw", range(steps - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            uzr, uc = w[f"{name}_u"][:, : 2 * HIDDEN], w[f"{name}_u"][:, 2 * HIDDEN :]
            for t in order:
                p = projected[side][index[:, t]]
                zr = sigmoid(p[:, : 2 * HIDDEN] + h @ uzr)
                c = np.tanh(p[:, 2 * HIDDEN :] + (zr[:, HIDDEN:] * h) @ uc)
                c -= h
                c *= zr[:, :HIDDEN]
                if not full:
                    c *= mask[:, t, None]
                h = h + c
                both[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        a = np.tanh(both @ w["att_w"]) @ w["att_v"]
        if not full:
            a = np.where(mask.T, a, np.float32(-1e9))
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, both)
        return pooled @ w["out_w"] + w["out_b"][0] + np.float32(self.shift)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((x @ self.weights[f"{d}_w"] + self.weights[f"{d}_b"]).astype(np.float32) for d in ("fw", "bw"))


def mean_rows(table: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean of the table's rows of each owner; owners without rows get zeros."""
    count = np.maximum(np.bincount(owner, minlength=n), 1).astype(np.float32)
    out = np.stack([np.bincount(owner, weights=table[rows, k], minlength=n) for k in range(table.shape[1])], axis=1)
    return (out / count[:, None]).astype(np.float32)


def start(vocabulary: dict[str, int], rng: np.random.Generator) -> Network:
    def small(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    d, h = WORD_DIM + GRAM_DIM, HIDDEN
    w = {"words": small(len(vocabulary) + 1, WORD_DIM) * np.sqrt(len(vocabulary) + 1) * np.float32(0.1), "grams": rng.standard_normal((GRAM_ROWS, GRAM_DIM)).astype(np.float32)}
    w["words"] = w["words"].astype(np.float32)
    for name in ("fw", "bw"):
        w |= {f"{name}_w": small(d, 3 * h), f"{name}_u": small(h, 3 * h), f"{name}_b": np.zeros(3 * h, np.float32)}
    w |= {"att_w": small(2 * h, h), "att_v": small(h), "out_w": small(2 * h), "out_b": np.zeros(1, np.float32)}
    return Network(vocabulary, w)


def gradients(net: Network, x: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean log-loss of windows for all weights but the input tables, and for the inputs x."""
    w, h_dim = net.weights, HIDDEN
    n, steps = index.shape
    proj = net.project(x)
    m = mask.astype(np.float32)
    tape: dict[str, list] = {"fw": [], "bw": []}
    both = np.zeros((steps, n, 2 * h_dim), np.float32)
    orders = {"fw": list(range(steps)), "bw": list(range(steps - 1, -1, -1))}
    for side, name in enumerate(("fw", "bw")):
        h = np.zeros((n, h_dim), np.float32)
        u = w[f"{name}_u"]
        for t in orders[name]:
            p = proj[side][index[:, t]]
            zr = sigmoid(p[:, : 2 * h_dim] + h @ u[:, : 2 * h_dim])
            z, r = zr[:, :h_dim], zr[:, h_dim:]
            c = np.tanh(p[:, 2 * h_dim :] + (r * h) @ u[:, 2 * h_dim :])
            tape[name].append((t, h, z, r, c))
            h = h + m[:, t, None] * z * (c - h)
            both[t, :, side * h_dim : (side + 1) * h_dim] = h
    q = np.tanh(both @ w["att_w"])
    a = np.where(mask.T, q @ w["att_v"], np.float32(-1e9))
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, both)
    logit = pooled @ w["out_w"] + w["out_b"][0]
    p1 = sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    g: dict[str, np.ndarray] = {}
    dl = ((p1 - y) / n).astype(np.float32)
    g["out_w"], g["out_b"] = pooled.T @ dl, dl.sum(keepdims=True)
    dpool = dl[:, None] * w["out_w"]
    dboth = a[:, :, None] * dpool[None]
    da = np.einsum("tnh,nh->tn", both, dpool)
    ds = a * (da - (a * da).sum(axis=0))
    g["att_v"] = np.einsum("tnk,tn->k", q, ds)
    dq = ds[:, :, None] * w["att_v"] * (1 - q * q)
    g["att_w"] = np.einsum("tnh,tnk->hk", both, dq)
    dboth += dq @ w["att_w"].T
    dx = np.zeros_like(x)
    for side, name in enumerate(("fw", "bw")):
        u, dproj = w[f"{name}_u"], np.zeros_like(proj[side])
        gu = np.zeros_like(u)
        dh = np.zeros((n, h_dim), np.float32)
        for t, h, z, r, c in reversed(tape[name]):
            dh = dh + dboth[t, :, side * h_dim : (side + 1) * h_dim]
            dm = dh * m[:, t, None]
            dc = dm * z * (1 - c * c)
            dz = dm * (c - h) * z * (1 - z)
            drh = dc @ u[:, 2 * h_dim :].T
            dr = drh * h * r * (1 - r)
            dp = np.concatenate([dz, dr, dc], axis=1)
            gu[:, : 2 * h_dim] += h.T @ dp[:, : 2 * h_dim]
            gu[:, 2 * h_dim :] += (r * h).T @ dc
            np.add.at(dproj, index[:, t], dp)
            dh = dh - dm * z + drh * r + dp[:, : 2 * h_dim] @ u[:, : 2 * h_dim].T
        g[f"{name}_u"], g[f"{name}_w"], g[f"{name}_b"] = gu, x.T @ dproj, dproj.sum(axis=0)
        dx += dproj @ w[f"{name}_w"].T
    return g, dx, loss


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            weights[k] -= (size * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


def window_starts(n: int, window: int, stride: int) -> list[int]:
    """Starts of all overlapping windows over n words; the last window reaches the last word."""
    if n == 0:
        return []
    return [0] if n <= window else [*range(0, n - window, stride), n - window]


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word numbers of all texts one after the other, and where each text's begin."""
    lists = words_of(texts)
    code = pc.dictionary_encode(lists.flatten())
    names = code.dictionary.to_pylist()
    real = np.array([w != "" for w in names], bool)
    index = code.indices.to_numpy()
    keep = real[index] if len(index) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return [w for w in names if w], (np.cumsum(real) - 1)[index[keep]] if len(index) else index, ends


def windows_of(index: np.ndarray, ends: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index [windows, window], mask, text of each window)."""
    starts, stops, owner = [], [], []
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for s in window_starts(b - a, window, stride):
            starts.append(a + s)
            stops.append(min(a + s + window, b))
            owner.append(k)
    at = np.array(starts, np.int64)[:, None] + np.arange(window)
    mask = at < np.array(stops, np.int64)[:, None]
    return (index[np.where(mask, at, 0)] if len(starts) else np.zeros((0, window), np.int64)), mask, np.array(owner, np.int64)


def window_logits(net: Network, projected: tuple, index: np.ndarray, mask: np.ndarray, block: int = 4096) -> np.ndarray:
    parts = [net.logits(projected, index[k : k + block], mask[k : k + block]) for k in range(0, len(index), block)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def train(texts: list[str], toxic: list[int], *, window: int, stride: int, rounds: int = 12, per_text: int = 5, rate: float = 0.01, seed: int = 3) -> Network | None:
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    words, flat, ends = coded(pa.array(texts, pa.string()))
    seen: Counter[int] = Counter()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        seen.update(set(flat[a:b].tolist()))
    vocabulary = {words[k]: 1 + i for i, (k, c) in enumerate((k, c) for k, c in sorted(seen.items()) if c >= 5)}
    net = start(vocabulary, rng)
    index, mask, owner = windows_of(flat, ends, window, stride)
    if not len(owner):
        return None
    ids = np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words))
    hashed, gram_owner = grams(words)
    hashed %= GRAM_ROWS
    order = np.argsort(gram_owner, kind="stable")
    hashed, gram_owner = hashed[order], gram_owner[order]
    bounds = np.searchsorted(gram_owner, np.arange(len(words) + 1))
    adam = Adam(net.weights, rate)
    first = np.searchsorted(owner, np.arange(len(texts)))
    last = np.searchsorted(owner, np.arange(len(texts)), "right")
    for r in range(rounds):
        score = None if r < rounds // 3 else window_logits(net, net.project(net.inputs(words)), index, mask)
        picked = []
        for k in range(len(texts)):
            here = np.arange(first[k], last[k])
            if score is not None and len(here) > 1:
                top = here[np.argsort(-score[here])]
                here = top[:1] if y[k] else np.concatenate([top[:2], rng.choice(here, min(per_text - 2, len(here)), replace=False)])
            elif len(here) > per_text:
                here = rng.choice(here, per_text, replace=False)
            picked.append(here)
        chosen = np.concatenate(picked)
        weight = y[owner[chosen]]
        if score is not None and weight.sum() > 0:  # repeat positives, so that both labels weigh alike
            times = max(1, int((1 - weight).sum() // weight.sum()))
            chosen = np.concatenate([chosen, *[chosen[weight == 1]] * (times - 1)])
        chosen = np.tile(chosen, max(1, -(-LEAST_STEPS * BATCH // len(chosen))))  # small samples are gone over more often
        rng.shuffle(chosen)
        for b in range(0, len(chosen), BATCH):
            some = chosen[b : b + BATCH]
            local, at = np.unique(index[some], return_inverse=True)
            at = at.reshape(len(some), window)
            word = np.where(rng.random(len(local)) < 0.3, 0, ids[local])
            sizes = bounds[local + 1] - bounds[local]
            own = np.repeat(np.arange(len(local)), sizes)
            rows = hashed[np.repeat(bounds[local] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            x = np.concatenate([net.weights["words"][word], mean_rows(net.weights["grams"], rows, own, len(local))], axis=1)
            g, dx, _ = gradients(net, x, at, mask[some], y[owner[some]])
            g["words"] = np.zeros_like(net.weights["words"])
            np.add.at(g["words"], word, dx[:, :WORD_DIM])
            share = (dx[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None])[own]
            g["grams"] = np.stack([np.bincount(rows, weights=share[:, k], minlength=GRAM_ROWS) for k in range(GRAM_DIM)], axis=1).astype(np.float32)
            adam.step(net.weights, g)
        adam.rate *= 0.88
    score = window_logits(net, net.project(net.inputs(words)), index, mask)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, owner, score)
    net.shift = -best_split(top[np.isfinite(top)], y[np.isfinite(top)])
    return net


def best_split(score: np.ndarray, y: np.ndarray) -> float:
    """Middle of the widest gap among the cuts with the fewest errors, both labels weighing alike."""
    order = np.argsort(score)
    s, t = score[order], y[order]
    wrong = np.concatenate([[0.0], np.cumsum(t / max(1, t.sum()))]) + np.concatenate([np.cumsum(((1 - t) / max(1, (1 - t).sum()))[::-1])[::-1], [0.0]])
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    cuts = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = cuts[np.argmax(edges[cuts + 1] - edges[cuts])]
    return float((edges[k] + edges[k + 1]) / 2)


def scores_of(net: Network, texts: pa.Array, window: int, stride: int) -> np.ndarray:
    """Scores of texts: the highest window's probability, 0 without words."""
    words, flat, ends = coded(texts)
    out = np.full(len(texts), -np.inf)
    index, mask, owner = windows_of(flat, ends, window, stride)
    if len(owner):
        np.maximum.at(out, owner, window_logits(net, net.project(net.inputs(words)), index, mask))
    return np.where(np.isfinite(out), 1 / (1 + np.exp(-np.clip(out, -60, 60))), 0.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = 800, window: int = 32, stride: int = 16) -> Network | None:
    """A network from about sample_docs labelled texts of each label; `learn` (over `__id`) marks usable documents."""
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("y")).filter(learn)
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return None
    share = F.when(F.col("y") == 1, F.lit(min(1.0, sample_docs / counts[1]))).otherwise(F.lit(min(1.0, sample_docs / counts[0])))
    picked = marks.filter(F.pmod(F.xxhash64("__id", F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("body")).filter(F.col("body").isNotNull()).join(F.broadcast(picked), "__id").collect()
    rows.sort(key=lambda r: (r["__id"], r["body"]))
    return train([r["body"] for r in rows], [r["y"] for r in rows], window=window, stride=stride)


def score(docs: DataFrame, net: Network | None, *, text: str = "text", window: int = 32, stride: int = 16) -> DataFrame:
    """docs with toxicity_score (an existing column of that name is replaced)."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop("toxicity_score")
    names = docs.columns
    at = names.index(text)
    schema = docs.withColumn("toxicity_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Network | None = shared.value
        for batch in batches:
            for some in slices(batch, at, 1 << 20):
                found = scores_of(model, some.column(at), window, stride) if model is not None else np.zeros(some.num_rows)
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(len(names))), pa.array(found, pa.float64())], names=[*names, "toxicity_score"])

    return docs.mapInArrow(run, schema)
