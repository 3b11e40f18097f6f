"""Benchmark decontamination with an FM-index per training shard.

Windows of ten consecutive words of the benchmark items are the test phrases. Each
task cuts its documents into shards of bounded size, indexes each shard, searches
all phrases backwards through the wavelet ranks, locates the occurrences from
sampled suffix positions, and merges them into removal spans. Nothing is shuffled.

A shard's alphabet is the benchmark's own words; runs of other words become one
break symbol, and stretches between breaks that are shorter than the shortest
phrase are left out of the index, as no phrase fits in. Both keep results exact.
A text longer than a shard lies in several that overlap by a phrase less a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import materialise, small_batches
from sheaf.llm.fmindex import FmIndex
from sheaf.llm.words import WORD, words

WINDOW = 10
#: Symbols of a shard; an index takes about 80 bytes for each.
SHARD = 1 << 20
#: Bytes of benchmark text that go to every task at once; a larger benchmark takes several rounds over the documents.
BLOCK_BYTES = 16 << 20
BREAK = 1


@dataclass
class Phrases:
    """Test phrases of a block of items, as symbols."""

    vocabulary: dict[bytes, int]
    phrases: np.ndarray  # padded on the left
    lengths: np.ndarray
    #: Items of a phrase: owners[offsets[p]:offsets[p + 1]].
    offsets: np.ndarray
    owners: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
        """An item with fewer words than a window is one phrase, one without words none."""
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            own = [vocabulary.setdefault(w, len(vocabulary) + BREAK + 1) for w in words(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(k)
        phrases, lengths = np.zeros((len(found), window), np.int64), np.array([len(p) for p in found], np.int64)
        for row, p in zip(phrases, found, strict=True):
            row[window - len(p) :] = p
        offsets = np.concatenate([[0], np.cumsum([len(o) for o in found.values()], dtype=np.int64)])
        owners = np.array([k for o in found.values() for k in sorted(o)], np.int64)
        return cls(vocabulary, phrases, lengths, offsets, owners, [i for i, _ in items])

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: its number of words, merged word spans of occurrences, and the ids of items that occur."""
        get, counts, parts = self.vocabulary.get, np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            own = words(text)
            counts[i] = len(own)
            parts.append(np.fromiter(map(get, own, repeat(BREAK)), np.int32, len(own)))
            parts.append(np.array([BREAK], np.int32))
        starts = np.concatenate([[0], np.cumsum(counts + 1)])
        out = [(int(n), [], []) for n in counts]
        if not len(self.lengths) or not texts:
            return out
        place, phrase = self._occurrences(np.concatenate(parts))
        if not len(place):
            return out
        doc = np.searchsorted(starts, place, "right") - 1
        begun = np.zeros(int(starts[-1]) + 1, np.int64)
        np.add.at(begun, place, 1)
        np.add.at(begun, place + self.lengths[phrase], -1)
        hit = np.concatenate([[False], np.cumsum(begun) > 0])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        for a, b in edges.reshape(-1, 2):
            d = int(np.searchsorted(starts, a, "right")) - 1
            out[d][1].append((int(a - starts[d]), int(b - starts[d])))
        pairs = np.unique(np.stack([doc, phrase], 1), axis=0)
        each = self.offsets[pairs[:, 1] + 1] - self.offsets[pairs[:, 1]]
        at = np.repeat(self.offsets[pairs[:, 1]] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
        for d, k in np.unique(np.stack([np.repeat(pairs[:, 0], each), self.owners[at]], 1), axis=0):
            out[d][2].append(self.items[k])
        return out

    def _occurrences(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `symbols` at which phrases occur, and which."""
        inside = np.concatenate([[False], symbols != BREAK, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= self.lengths.min()]
        size = edges[:, 1] - edges[:, 0] + 1  # with the break behind it
        if not len(edges):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        origin = np.repeat(edges[:, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        kept = symbols[origin]
        places, phrases = [], []
        overlap = self.phrases.shape[1] - 1
        for at in range(0, len(kept), SHARD):
            index = FmIndex(kept[at : at + SHARD + overlap])
            low, high = index.search(self.phrases, self.lengths)
            n = high - low
            found = np.flatnonzero(n)
            # Blocks of occurrences, so that a frequent phrase cannot fill the memory.
            block = (np.cumsum(n[found]) - 1) // SHARD
            for some in np.split(found, np.flatnonzero(np.diff(block)) + 1) if len(found) else []:
                each = n[some]
                rows = np.repeat(low[some] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
                places.append(origin[at + index.locate(rows)])
                phrases.append(np.repeat(some, each))
        return (np.concatenate(places), np.concatenate(phrases)) if places else (np.empty(0, np.int64), np.empty(0, np.int64))


class Blocks:
    """Phrases of all items, in as many blocks as the benchmark's checked size asks for, made one at a time. Items without an id are left out."""

    def __init__(self, benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> None:
        self.rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null")
        total = self.rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        self.n, self.window = max(1, -(-total // block_bytes)), window

    def __iter__(self) -> Iterator[Phrases]:
        for k in range(self.n):
            part = self.rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.n)) == k)
            yield Phrases.of([(r["i"], r["t"]) for r in part.toLocalIterator()], self.window)


def _slices(texts: list[str | None], size: int = 24 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters."""
    first = total = 0
    for i, x in enumerate(texts):
        total += len(x or "")
        if total > size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", result: str = "found", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with a struct column: number of words, merged word spans of occurrences, sorted item ids.

    Null and empty texts have no words. Every occurrence counts, repeated rows and
    all; an empty benchmark finds nothing. A column named like `result` gives way to
    it. Blocks of phrases are sent one at a time; what the ones before found is
    written between them.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    out = docs.withColumn(result, F.lit(None).cast(RESULT))
    parts = Blocks(benchmark, window=window, block_bytes=block_bytes)
    for k, phrases in enumerate(parts):
        sent = sc.broadcast(phrases)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                texts, before = batch.column(text).to_pylist(), batch.column(result).to_pylist()
                for a, b in _slices(texts):
                    rows = own.scan(texts[a:b])
                    for i, (_, spans, items) in enumerate(rows):
                        if old := before[a + i]:
                            rows[i] = (rows[i][0], _merged(spans, [(s["start"], s["end"]) for s in old["spans"]]), [*items, *old["items"]])
                    made = pa.array([{"n_words": n, "spans": [{"start": x, "end": y} for x, y in spans], "items": sorted(set(items))} for n, spans, items in rows], _ARROW)
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([made if c == result else part.column(c) for c in part.schema.names], names=part.schema.names)

        out = out.mapInArrow(task, out.schema)
        if k + 1 < parts.n:
            out = materialise(out, "contamination")
            sent.unpersist()
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of some word spans; what stood between two of them goes with them."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs`, the removal spans cut out of their texts, with the same rows and columns.

    Words that a cut brings together may spell a phrase again: the texts that were
    cut are searched again until nothing is found.
    """
    parts = Blocks(benchmark, window=window, block_bytes=block_bytes)
    if parts.n > 1:
        return _decontaminated_in_blocks(docs, benchmark, text, window, block_bytes)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(next(iter(parts)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            todo = list(range(len(texts)))
            while todo:
                changed = []
                for a, b in _slices([texts[i] for i in todo]):
                    some = todo[a:b]
                    for i, (_, spans, _) in zip(some, sent.value.scan([texts[i] for i in some]), strict=True):
                        if spans:
                            texts[i] = cut(texts[i], spans)
                            changed.append(i)
                todo = changed
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(task, docs.schema)


def _decontaminated_in_blocks(docs: DataFrame, benchmark: DataFrame, text: str, window: int, block_bytes: int) -> DataFrame:
    """The same for a benchmark of several blocks: spans of all blocks are found, then cut, and the texts that were cut searched again."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut(t, [(s["start"], s["end"]) for s in own]) for t, own in zip(texts, spans, strict=True)], dtype=object)

    todo, out = docs, None
    while out is None or not todo.isEmpty():
        found = materialise(contamination(todo, benchmark, text, "__d_found", window, block_bytes), "found")
        hit = F.size("__d_found.spans") > 0
        clean = found.where(~hit).select(*docs.columns)
        out = clean if out is None else out.unionByName(clean)
        todo = materialise(found.where(hit).withColumn(text, without(F.col(text), F.col("__d_found.spans"))).select(*docs.columns), "cut")
    return out


def digests(found: DataFrame, result: str = "found", key: str = "doc_id") -> DataFrame:
    """The result as plain columns."""
    r = F.col(result)
    hits = F.aggregate(r["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        key,
        r["n_words"].alias("n_words"),
        hits.alias("n_hit"),
        F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(r["items"], ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
