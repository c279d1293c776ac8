"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into windows; a small network reads each window in both
directions and gives every byte position a distribution over languages.  A
document's distribution is the mean over all its positions.  The network is
trained here, in numpy, by backpropagation through time.

Edge cases: a text that is null or has no letter is ``und`` with score 0.  If
nothing can be learned (no labelled text) every text is ``und``.  Rows with equal
ids are judged one by one; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.common import id_bucket, slices, table
from paceforge.llm.sampling import labelled_pieces

#: The input after a window's last byte.
PAD = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class Network:
    """For each direction d: inputs[d] (257, 3H), recurrent[d] (H, 3H), candidate bias[d] (H); output (2H, C), (C)."""

    languages: tuple[str, ...]
    inputs: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    bias: tuple[np.ndarray, np.ndarray]
    output: np.ndarray
    output_bias: np.ndarray
    window: int


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def layout(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of texts that lie one after the other: the text, the first byte, the bytes left from there."""
    counts = -(-sizes // width)
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * width
    return owner, (np.cumsum(sizes) - sizes)[owner] + first, sizes[owner] - first


def windows_at(data: np.ndarray, at: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """(len(at), width) codes of windows, padded."""
    place = np.arange(width)
    out = data[np.minimum(at[:, None] + place, max(len(data) - 1, 0))].astype(np.int16)
    out[place >= left[:, None]] = PAD
    return out


def states(net_inputs: np.ndarray, recurrent: np.ndarray, bias: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hidden states (T, B, H) of one direction; ``codes`` (T, B) in reading order."""
    steps, batch = codes.shape
    size = recurrent.shape[0]
    # sigmoid(x) = (tanh(x / 2) + 1) / 2: halve the gates' weights once
    half = np.ones(3 * size, np.float32)
    half[: 2 * size] = 0.5
    table_ = (net_inputs * half).astype(np.float32)
    turn = (recurrent * half).astype(np.float32)
    out = np.empty((steps, batch, size), np.float32)
    h = np.zeros((batch, size), np.float32)
    a = np.empty((batch, 3 * size), np.float32)
    g = np.empty((batch, 2 * size), np.float32)
    n = np.empty((batch, size), np.float32)
    for t in range(steps):
        x = table_[codes[t]]
        np.matmul(h, turn, out=a)
        np.add(a[:, : 2 * size], x[:, : 2 * size], out=g)
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        np.add(a[:, 2 * size :], bias, out=n)
        n *= g[:, size:]
        n += x[:, 2 * size :]
        np.tanh(n, out=n)
        h = np.subtract(h, n, out=out[t])
        h *= g[:, :size]
        h += n
    return out


def position_probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """(T, B, C): each position's distribution; ``codes`` (B, T)."""
    by_time = np.ascontiguousarray(codes.T)
    ahead = states(net.inputs[0], net.recurrent[0], net.bias[0], by_time)
    back = states(net.inputs[1], net.recurrent[1], net.bias[1], by_time[::-1])[::-1]
    size = ahead.shape[2]
    logits = ahead @ net.output[:size] + back @ net.output[size:] + net.output_bias
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def predict(net: Network, texts: list[bytes], batch: int = 1024) -> np.ndarray:
    """(len(texts), C): the mean distribution over each text's positions; zeros for an empty text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner, at, left = layout(sizes, net.window)
    sums = np.zeros((len(texts), len(net.languages)))
    for a in range(0, len(owner), batch):
        part = windows_at(data, at[a : a + batch], left[a : a + batch], net.window)
        p = position_probabilities(net, part)
        p *= (part.T != PAD)[:, :, None]
        per_window = p.sum(axis=0)
        for c in range(per_window.shape[1]):
            sums[:, c] += np.bincount(owner[a : a + batch], per_window[:, c], len(texts))
    return sums / np.maximum(sizes, 1)[:, None]


class _Trainer:
    """Adam on the cross entropy of every position."""

    def __init__(self, classes: int, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"E{d}"] = rng.normal(0, 0.3, (257, 3 * hidden))
            self.p[f"U{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))
            self.p[f"c{d}"] = np.zeros(hidden)
        self.p["V"] = rng.normal(0, 0.3, (2 * hidden, classes))
        self.p["v"] = np.zeros(classes)
        self.m = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.steps = 0

    def _forward(self, d: str, codes: np.ndarray) -> tuple[np.ndarray, list]:
        size, e, u, c = self.h, self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"c{d}"]
        h = np.zeros((codes.shape[1], size))
        out, kept = [], []
        for code in codes:
            x, a = e[code], h @ u
            z = _sigmoid(x[:, :size] + a[:, :size])
            r = _sigmoid(x[:, size : 2 * size] + a[:, size : 2 * size])
            q = a[:, 2 * size :] + c
            n = np.tanh(x[:, 2 * size :] + r * q)
            kept.append((h, z, r, q, n))
            h = n + z * (h - n)
            out.append(h)
        return np.stack(out), kept

    def _backward(self, d: str, codes: np.ndarray, kept: list, grad_out: np.ndarray, grads: dict) -> None:
        size, u = self.h, self.p[f"U{d}"]
        de, du, dc = np.zeros_like(self.p[f"E{d}"]), np.zeros_like(u), np.zeros(size)
        dh = np.zeros(grad_out.shape[1:])
        for t in range(len(codes) - 1, -1, -1):
            h, z, r, q, n = kept[t]
            dh = dh + grad_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            dq = dn * r
            back = np.concatenate([dz, dr, dq], axis=1)
            np.add.at(de, codes[t], np.concatenate([dz, dr, dn], axis=1))
            du += h.T @ back
            dc += dq.sum(axis=0)
            dh = dh * z + back @ u.T
        grads[f"E{d}"], grads[f"U{d}"], grads[f"c{d}"] = de, du, dc

    def step(self, codes: np.ndarray, labels: np.ndarray, rate: float) -> float:
        """One update on windows (B, T) and their labels; returns the loss before it."""
        by_time, size = codes.T, self.h
        ahead, kept_f = self._forward("f", by_time)
        back, kept_b = self._forward("b", by_time[::-1])
        both = np.concatenate([ahead, back[::-1]], axis=2)
        logits = both @ self.p["V"] + self.p["v"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        mask = (by_time != PAD).astype(float)
        total = mask.sum()
        t, b = np.indices(by_time.shape)
        loss = -(np.log(prob[t, b, labels[b]] + 1e-12) * mask).sum() / total
        prob[t, b, labels[b]] -= 1
        prob *= (mask / total)[:, :, None]
        grads = {"V": np.einsum("tbh,tbc->hc", both, prob), "v": prob.sum(axis=(0, 1))}
        g = prob @ self.p["V"].T
        self._backward("f", by_time, kept_f, g[:, :, :size], grads)
        self._backward("b", by_time[::-1], kept_b, g[::-1, :, size:], grads)
        norm = np.sqrt(sum((x * x).sum() for x in grads.values()))
        self.steps += 1
        for k, x in grads.items():
            x = x * min(1.0, 1.0 / (norm + 1e-12))
            self.m[k] += 0.1 * (x - self.m[k])
            self.s[k] += 0.01 * (x * x - self.s[k])
            m, s = self.m[k] / (1 - 0.9**self.steps), self.s[k] / (1 - 0.99**self.steps)
            self.p[k] -= rate * m / (np.sqrt(s) + 1e-8)
        return float(loss)


def fit(
    pieces: list[tuple[str, bytes]],
    window: int = 64,
    hidden: int = 8,
    steps: int = 300,
    batch: int = 256,
    seed: int = 7,
) -> Network | None:
    """Train on (language, bytes); classes are drawn equally often."""
    languages = tuple(sorted({k for k, _ in pieces}))
    if not languages:
        return None
    data = [p for _, p in pieces]
    sizes = np.array([len(p) for p in data], np.int64)
    owner, at, left = layout(sizes, window)
    codes = windows_at(np.frombuffer(b"".join(data), np.uint8), at, left, window)
    label = np.array([languages.index(k) for k, _ in pieces])[owner]
    rng = np.random.default_rng(seed)
    trainer = _Trainer(len(languages), hidden, seed)
    rows = [np.flatnonzero(label == c) for c in range(len(languages))]
    for k in range(steps if len(languages) > 1 else 0):
        pick = np.concatenate([rng.choice(r, max(1, batch // len(rows))) for r in rows])
        trainer.step(codes[pick], label[pick], 0.02 * (1 - k / steps) + 0.001)
    p = {k: x.astype(np.float32) for k, x in trainer.p.items()}
    return Network(
        languages, (p["Ef"], p["Eb"]), (p["Uf"], p["Ub"]), (p["cf"], p["cb"]), p["V"], p["v"], window
    )


def train(docs: DataFrame, per_language: int = 400, pieces: int = 4) -> Network | None:
    """Fit on documents with a language whose crc32(id) mod 5 is not 0; at most ``per_language`` of each.

    The 1,000 commonest languages are learned, as labelled_pieces() bounds them.
    """
    usable = (id_bucket("doc_id", 5) != 0) & F.col("text").isNotNull()
    found = labelled_pieces(docs, None, "lang", usable, per_language, pieces, 128)
    return fit([(label, piece) for label, _, piece in found])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _judged(net: Network | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    known = [has_letter(t) for t in texts.to_pylist()]
    if net is None:
        return [UNKNOWN] * len(known), [0.0] * len(known)
    data = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    p = predict(net, data)
    best = p.argmax(axis=1)
    langs = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return langs, [min(1.0, float(x)) if k else 0.0 for x, k in zip(p.max(axis=1), known)]


def identify(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, lang_pred, score) for every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = _judged(net, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {id_type}, lang_pred string, score double")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(id_bucket("id", 5) == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def keep_identified(df: DataFrame, net: Network | None, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose language is found with a score of ``least`` or more."""
    at = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = _judged(net, batch.column(at))
            yield batch.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(langs, scores)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
