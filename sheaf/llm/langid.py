"""Language ID with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions, in segments side by side,
labels every position, and a document's probabilities are the mean over all its
positions. It is trained here, in numpy, by backpropagation through time, on a
bounded sample of labelled documents; prediction sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import materialise, small_batches

#: Units of each direction, bytes of a segment, segments side by side.
UNITS, SEGMENT, LANES = 8, 48, 2048
#: Labelled documents of a language that train the network, at most about, and segments of each.
TRAIN_DOCS, TRAIN_SEGMENTS = 400, 8
#: Stands for a place beyond the text's end.
NONE = 256
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Gru:
    """One direction: input weights by byte (with the bias) and recurrent weights, for update, reset and candidate."""

    inputs: np.ndarray  # 3 units x 257
    recurrent: np.ndarray  # 3 units x units

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the bytes `x` (steps x lanes)."""
        u = len(self.recurrent) // 3
        h = np.zeros((u, x.shape[1]), np.float32)
        out = np.empty((len(x), u, x.shape[1]), np.float32)
        for t in range(len(x)):
            given, own = self.inputs.take(x[t], axis=1), self.recurrent @ h
            gates = _sigmoid(given[: 2 * u] + own[: 2 * u])
            z, r, pre = gates[:u], gates[u:], own[2 * u :]
            n = np.tanh(given[2 * u :] + r * pre)
            if keep is not None:
                keep.append((h, z, r, n, pre))
            h = n + z * (h - n)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, kept: list, toward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of both weights, through time, from those of the states."""
        u = len(self.recurrent) // 3
        inputs, recurrent = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        later = np.zeros_like(toward[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, pre = kept[t]
            d = toward[t] + later
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * pre * r * (1 - r)
            own = np.concatenate([dz, dr, dn * r])
            recurrent += own @ h.T
            once = np.zeros((x.shape[1], NONE + 1), np.float32)
            once[np.arange(x.shape[1]), x[t]] = 1
            inputs += np.concatenate([dz, dr, dn]) @ once
            later = d * z + self.recurrent.T @ own
        return inputs, recurrent


@dataclass
class Network:
    """Both directions and the labels' weights."""

    labels: list[str]
    ahead: Gru
    back: Gru
    out: np.ndarray  # labels x (2 units + 1)
    losses: list[float] = field(default_factory=list)

    @classmethod
    def new(cls, labels: list[str], units: int = UNITS, seed: int = 3) -> Network:
        random = np.random.default_rng(seed)

        def gru() -> Gru:
            return Gru(random.normal(0, 0.3, (3 * units, NONE + 1)).astype(np.float32), random.normal(0, 0.3, (3 * units, units)).astype(np.float32))

        return cls(labels, gru(), gru(), random.normal(0, 0.3, (len(labels), 2 * units + 1)).astype(np.float32))

    def positions(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (steps x labels x lanes) of each position of some segments (steps x lanes), and both states."""
        a, b = keep or (None, None)
        states = np.concatenate([self.ahead.forward(x, a), self.back.forward(x[::-1], b)[::-1]], axis=1)
        scores = np.matmul(self.out[:, :-1], states) + self.out[:, -1:]
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores, states

    def train(self, segments: np.ndarray, label: np.ndarray, rounds: int = 400, lanes: int = 192, rate: float = 0.02, seed: int = 5) -> None:
        """Adam on the mean cross-entropy of all positions; segments are lanes x steps."""
        random = np.random.default_rng(seed)
        weights = [self.ahead.inputs, self.ahead.recurrent, self.back.inputs, self.back.recurrent, self.out]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        u = self.out.shape[1] // 2
        for step in range(1, rounds + 1):
            chosen = random.integers(0, len(segments), lanes)
            x, y = segments[chosen].T, label[chosen]
            kept: tuple[list, list] = ([], [])
            p, states = self.positions(x, kept)
            real = (x != NONE).astype(np.float32)
            total = max(1.0, real.sum())
            self.losses.append(float(-(np.log(p[:, y, np.arange(lanes)] + 1e-9) * real).sum() / total))
            p[:, y, np.arange(lanes)] -= 1
            p *= real[:, None] / total
            out = np.concatenate([np.einsum("tlb,tub->lu", p, states), p.sum((0, 2))[:, None]], axis=1)
            d = np.matmul(self.out[:, :-1].T, p)
            grads = [*self.ahead.backward(x, kept[0], d[:, :u]), *self.back.backward(x[::-1], kept[1], d[::-1, u:]), out]
            for k, (w, g) in enumerate(zip(weights, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w -= rate * min(1, (rounds - step) / (0.3 * rounds) + 0.05) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Pooled probabilities of whole texts (rows); zeros for texts without a byte."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        counts = np.array([-(-len(r) // SEGMENT) for r in raw], np.int64)
        whole = np.full((int(counts.sum()), SEGMENT), NONE, np.int16)
        at = 0
        for r, n in zip(raw, counts.tolist(), strict=True):
            whole[at : at + n].reshape(-1)[: len(r)] = np.frombuffer(r, np.uint8)
            at += n
        sums = np.zeros((len(whole), len(self.labels)), np.float32)
        for a in range(0, len(whole), LANES):
            x = np.ascontiguousarray(whole[a : a + LANES].T)
            p, _ = self.positions(x)
            sums[a : a + LANES] = np.einsum("tlb,tb->bl", p, (x != NONE).astype(np.float32))
        out = np.zeros((len(texts), len(self.labels)))
        np.add.at(out, np.repeat(np.arange(len(texts)), counts), sums)
        return out / np.maximum(1, np.array([len(r) for r in raw]))[:, None]


def sample(docs: DataFrame, text: str, lang: str, key: str, per_label: int = TRAIN_DOCS) -> DataFrame:
    """About `per_label` documents of each label, by a hash of their key and text: `lang`, `segment` (bytes drawn from all of the text).

    Which ones is settled on thin rows and written; texts meet only that table, whose
    size the planner then knows, so that they are not shuffled while it is small.
    """
    own = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("x"))
    thin = materialise(own.select("lang", "x"), "labelled")
    often = thin.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod("x", F.lit(1_000_000)).alias("h")
    chosen = thin.select("lang", "x", place).join(materialise(often, "labels"), "lang").where(F.col("h") < F.lit(1_000_000.0) * per_label / F.col("n"))
    chosen = materialise(chosen.select("x", "h").distinct().select(F.col("x").alias("__l_x"), "h"), "chosen")
    some = own.join(chosen, own["x"] == chosen["__l_x"]).select("lang", "text", "h")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang_, t, h in zip(b["lang"], b["text"], b["h"], strict=True):
                raw = t.encode("utf-8", "replace")
                starts = np.random.default_rng(h).integers(0, max(1, len(raw) - SEGMENT // 2), TRAIN_SEGMENTS)
                rows += [(lang_, raw[s : s + SEGMENT]) for s in sorted(starts)]
            yield pd.DataFrame(rows, columns=["lang", "segment"])

    return some.mapInPandas(task, "lang string, segment binary")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_label: int = TRAIN_DOCS) -> Network | None:
    """Train a network on labelled documents; None without any."""
    rows = sorted((r["lang"], bytes(r["segment"])) for r in sample(docs, text, lang, key, per_label).toLocalIterator())
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    segments = np.full((len(rows), SEGMENT), NONE, np.int16)
    for row, (_, raw) in zip(segments, rows, strict=True):
        row[: len(raw)] = np.frombuffer(raw, np.uint8)
    made = Network.new(labels)
    made.train(segments, np.array([labels.index(r[0]) for r in rows]))
    return made


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> Column:
    """A struct column: `lang` and `score` of each whole text.

    Null texts and texts without a letter are `und` with score 0, as is everything
    without a network. Equal scores go to the label that sorts first.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("lang string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for some in texts:
            p = own.documents(some.tolist())
            best = p.argmax(1)
            yield pd.DataFrame({"lang": [own.labels[i] for i in best], "score": np.minimum(1.0, p[np.arange(len(p)), best])})

    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if network is None:
        return none
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return F.when(letters, run(F.col(text))).otherwise(none)
