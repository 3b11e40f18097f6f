"""Quality classifier: document evidence, and host and path posteriors by empirical Bayes.

Two linear models over hashed words and a few shape features score each document
for quality and for toxicity. The scores, summed by path and by host, are shrunk
in two steps: a host's mean towards the global mean, a path's mean towards its
host's. How strongly is estimated from the spread of the hosts (and of the paths
in their hosts), so a sparse site adds next to nothing and a large one its own
rate. A document's log odds move by what the posterior of its path, made of all the
path's other documents, adds to the prior.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import looked_up, materialise, small_batches
from sheaf.llm.words import TABLE

#: Labelled rows that the document models are fitted on, at most.
TRAIN_ROWS = 4000
SLOTS = 1 << 18
HEADS = ("quality", "toxic")
#: Bytes of the beginnings of words that count beside the words.
STEMS = (5, 6, 7, 8)
#: What is no mark to blanks: letters, digits, bytes beyond ASCII, white space.
MARKS = bytes(32 if b >= 128 or chr(b).isalnum() or b < 33 else b for b in range(256))
SHAPES = 7
#: Slots that a head's model uses, at most: those most associated with its label.
CHOSEN = 400


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of the different words and mark runs of a whole text, and its shape features."""
    raw = (text or "").encode("utf-8", "replace")
    own = raw.translate(TABLE).split()
    marks = raw.translate(MARKS).split()
    different = set(own)
    # Inflected words share their beginnings.
    starts = {w[:k] for w in different for k in STEMS if len(w) > k}
    slots = {zlib.crc32(w) & (SLOTS - 1) for w in different} | {zlib.crc32(w, 1) & (SLOTS - 1) for w in starts} | {zlib.crc32(b"\0" + m[:3]) & (SLOTS - 1) for m in set(marks)}
    n = max(1, len(own))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shape = [len(marks) / n, len(different) / n, upper / max(1, len(raw)), sum(map(len, own)) / n / 10, np.log1p(n) / 10, raw.count(b"\n") / n, sum(a == b for a, b in zip(own, own[1:])) / n]
    return np.fromiter(slots, np.int64, len(slots)), np.array(shape)


@dataclass
class Linear:
    """Weights of both heads over slots, then shapes, then the bias."""

    weights: np.ndarray  # heads x (SLOTS + SHAPES + 1)

    def log_odds(self, text: str | None) -> np.ndarray:
        slots, shape = features(text)
        w = self.weights
        return w[:, slots].sum(1) + w[:, SLOTS:-1] @ shape + w[:, -1]

    @classmethod
    def fit(cls, rows: list[tuple[list[int], list[float], int, int]], penalty: float = 1.0) -> Linear:
        """Ridge logistic regression by Newton steps, for each head on the slots whose presence tells most about its label (log-likelihood ratio)."""
        sizes = np.array([len(r[0]) for r in rows])
        column = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
        row = np.repeat(np.arange(len(rows)), sizes)
        shape = np.array([r[1] for r in rows]).reshape(len(rows), SHAPES)
        mean, scale = shape.mean(0), shape.std(0) + 1e-9
        n = np.bincount(column, minlength=SLOTS).astype(float)
        out = np.zeros((len(HEADS), SLOTS + SHAPES + 1), np.float32)
        for head in range(len(HEADS)):
            y = np.array([float(r[2 + head]) for r in rows])
            chosen = _telling(n, np.bincount(column, y[row], SLOTS), y)
            place = np.full(SLOTS, -1)
            place[chosen] = np.arange(len(chosen))
            x = np.zeros((len(rows), len(chosen) + SHAPES + 1))
            here = place[column] >= 0
            x[row[here], place[column[here]]] = 1
            x[:, len(chosen) : -1], x[:, -1] = (shape - mean) / scale, 1
            w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
            ridge[-1] = 1e-3
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
                w += step
                if np.abs(step).max() < 1e-5:
                    break
            out[head, chosen] = w[: len(chosen)]
            out[head, SLOTS:-1] = w[len(chosen) : -1] / scale
            out[head, -1] = w[-1] - (w[len(chosen) : -1] * mean / scale).sum()
        return cls(out)


def _telling(n: np.ndarray, positive: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots with a clear association: twice the log-likelihood ratio of their 2 x 2 table, the largest `CHOSEN` above 11."""
    total, ones = len(y), y.sum()
    cells = [(positive, n * ones / total), (n - positive, n * (1 - ones / total)), (ones - positive, (total - n) * ones / total), (total - n - ones + positive, (total - n) * (1 - ones / total))]
    g = 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0) for o, e in cells)
    g[n < 3] = 0
    best = np.argsort(-g, kind="stable")[:CHOSEN]
    return np.sort(best[g[best] > 11])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Linear:
    """Fit the document models on at most `rows` labelled rows, those with the smallest hash of their key.

    Rows with a null label, key or text are left out. Of a key labelled twice both
    labels count. Without any usable row all log odds are 0.
    """
    chosen = labels.select(F.col(key).cast("string").alias("k"), *(F.col(h).cast("int").alias(h) for h in HEADS)).dropna()
    chosen = chosen.orderBy(F.xxhash64("k"), "k", *HEADS).limit(rows)
    texts = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).dropna()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(t) for t in batch["t"]]
            yield pd.DataFrame({"slots": [m[0] for m in made], "shape": [m[1] for m in made], **{h: batch[h] for h in HEADS}, "k": batch["k"]})

    # At most `rows` labels, so their broadcast is bounded.
    seen = texts.join(F.broadcast(chosen), "k").mapInPandas(task, "slots array<long>, shape array<double>, quality int, toxic int, k string")
    got = seen.orderBy(F.xxhash64("k"), "k", F.xxhash64("slots")).limit(rows).collect()
    return Linear.fit([(r["slots"], r["shape"], r["quality"], r["toxic"]) for r in got]) if got else Linear(np.zeros((len(HEADS), SLOTS + SHAPES + 1), np.float32))


def _probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _odds(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(bounded / (1 - bounded))


def _strength(groups: DataFrame, n: str, total: str, prior: Column) -> float:
    """How many rows a prior is worth: by moments from how far the group means lie from their priors beyond what n rows would scatter."""
    mean = F.col(total) / F.col(n)
    r = groups.agg(
        F.sum(n).alias("n"),
        F.count("*").alias("g"),
        F.sum(F.col(n) * (mean - prior) ** 2).alias("between"),
        F.sum(F.col(n) * prior * (1 - prior)).alias("within"),
    ).first()
    if not r["g"] or r["n"] <= r["g"]:
        return 1e6
    v = r["within"] / r["n"]
    extra = (r["between"] - r["g"] * v) / (r["n"] - r["g"])
    return min(max(v / extra - 1, 1.0), 1e6) if extra > 0 else 1e6


def _posterior(total: Column, n: Column, prior: Column, k: float) -> Column:
    return (total + k * prior) / (n + k)


@dataclass
class Sites:
    """What is known of hosts and paths: one row a path (`host`, `path`, counts and sums of both), and what holds for all."""

    rows: DataFrame
    prior: dict[str, float]
    host_strength: dict[str, float]
    path_strength: dict[str, float]

    def shift(self, head: str, own: Column) -> Column:
        """What a row's site adds to its log odds: the posterior of its path from all rows but itself, whose evidence `own` counts once."""
        c = F.col
        host = _posterior(c(f"__q_host_{head}") - own, c("__q_host_n") - 1, F.lit(self.prior[head]), self.host_strength[head])
        path = _posterior(c(f"__q_{head}") - own, c("__q_n") - 1, host, self.path_strength[head])
        return _odds(path) - _odds(F.lit(self.prior[head]))


def sites(scores: DataFrame) -> Sites:
    """From `host`, `path` and both heads' log odds: sums by path and host, and how strongly each level shrinks towards the one above.

    The global prior is the mean evidence of all rows. All sums are made with
    map-side aggregation; a host with a third of all rows is one number from each
    task. What passes through the driver is one row of numbers a level and head.
    """
    p = {h: _probability(F.col(h)) for h in HEADS}
    paths = materialise(scores.groupBy("host", "path").agg(F.count("*").alias("__q_n"), *(F.sum(p[h]).alias(f"__q_{h}") for h in HEADS)), "paths")
    whole = paths.agg(F.sum("__q_n").alias("n"), *(F.sum(f"__q_{h}").alias(h) for h in HEADS)).first()
    prior = {h: (whole[h] / whole["n"] if whole["n"] else 0.5) for h in HEADS}
    hosts = paths.groupBy(F.col("host").alias("__q_h")).agg(F.sum("__q_n").alias("__q_host_n"), *(F.sum(f"__q_{h}").alias(f"__q_host_{h}") for h in HEADS))
    host_strength = {h: _strength(hosts, "__q_host_n", f"__q_host_{h}", F.lit(prior[h])) for h in HEADS}
    rows = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("__q_h"))).drop("__q_h"), "sites")
    mean = {h: _posterior(F.col(f"__q_host_{h}"), F.col("__q_host_n"), F.lit(prior[h]), host_strength[h]) for h in HEADS}
    return Sites(rows, prior, host_strength, {h: _strength(rows, "__q_n", f"__q_{h}", mean[h]) for h in HEADS})


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS, result: str = "judged", keep: list[str] | None = None) -> DataFrame:
    """`docs` with a struct column: quality and toxicity (posterior probabilities), and `keep`.

    A document is kept if it is likelier good than not, and likelier clean than
    toxic. Null texts score as empty ones, null hosts and paths are sites of their
    own. The path level is language within a source by default, as documents have no
    URL path. Repeated rows count each. With `keep`, only these columns come back;
    a column named like the result gives way to it. Each text is scored once: rows
    are written with their scores, and read back for the result. Sites with many rows
    are looked up by broadcast; only rows of small ones are shuffled, once there are
    more of these than a broadcast takes.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c != result]
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, rows))

    @F.pandas_udf("quality double, toxic double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            yield pd.DataFrame(np.array([model.value.log_odds(t) for t in some]).reshape(len(some), len(HEADS)), columns=list(HEADS))

    named = docs.select(*columns, F.col(host).cast("string").alias("__q_own_host"), F.col(path).cast("string").alias("__q_own_path"), score(F.col(text)).alias("__q_s"))
    scored = materialise(named, "scores")
    known = sites(scored.select(F.col("__q_own_host").alias("host"), F.col("__q_own_path").alias("path"), "__q_s.*"))
    # Null hosts and paths are looked up like any other.
    named = lambda *cs: F.struct(*(x for k, c in enumerate(cs) for x in (F.col(c).isNull().alias(f"n{k}"), F.coalesce(F.col(c), F.lit("")).alias(f"c{k}"))))
    places = known.rows.withColumn("__q_by", named("host", "path")).withColumn("__q_rows", F.col("__q_n")).drop("host", "path")
    joined = looked_up(scored.withColumn("__q_by", named("__q_own_host", "__q_own_path")), places, ["__q_by"], n="__q_rows")
    p = {h: _probability(F.col("__q_s")[h] + known.shift(h, _probability(F.col("__q_s")[h]))) for h in HEADS}
    made = F.struct(p["quality"].alias("quality"), p["toxic"].alias("toxic"), ((p["quality"] >= 0.5) & (p["toxic"] < 0.5)).alias("keep"))
    return joined.withColumn(result, made).select(*columns, result)
