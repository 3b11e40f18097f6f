"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has one BPE encoding, and so one last token. A token is the
last one of a prefix if it ends there and goes with the last token of what is left
before it. Tokens ending at a place come from an automaton over the vocabulary's
suffixes; whether two tokens go together is read off their merge trees. The last
tokens, followed backwards, spell the ids. Work is linear in a word's length (times
that of the longest token), and words seen before come from bounded stores.

Words are split and put in lower case by the Unicode versions of the tokenizers
library; tables below hold what Python's `regex` and `str` tell otherwise.

The vocabulary file is that of a public tokenizer; its path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sheaf.llm.common import small_batches

END = "</w>"
#: White space as the file's own expressions mean it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The splitting pattern of the vocabulary, without white space. Fixed values.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Texts in work at once.
SLICE = 500
#: Prefixes longer than this are not remembered beyond their word.
SHARED = 32
#: What str.split() takes for white space beyond that.
SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
BLANK = regex.compile(f"[{SPACE}]+")
#: Words, pieces and token pairs that a task remembers at once.
STORE = 100_000
#: What a word may have behind its letters and still be two plain pieces.
STOPS = frozenset(".,;:!?")
#: Ranges of code points that count as letters in later Unicode versions only. Fixed values.
LATER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DF), (0xA7E0, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DFFF), (0x1E6C0, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Ranges of code points that count as numbers here and not to the tokenizers library. Fixed values.
LATER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
#: Capitals of later Unicode versions, as ranges with the distance of their small letters. Fixed values.
LATER_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
LOWER = {c: chr(c + by) for a, b, by in LATER_CAPITALS for c in range(a, b + 1)}
CAPITAL = regex.compile(f"[{''.join(map(chr, LOWER))}]")
_later = "".join(f"{chr(a)}-{chr(b)}" for a, b in (*LATER_LETTERS, *LATER_NUMBERS))
LATER = regex.compile(f"[{_later}]")
#: The splitting pattern for words with such characters, which count as symbols.
PIECE_LATER = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_later}]]+|[\p{{N}}--[{_later}]]|[[^{SPACE}\p{{L}}\p{{N}}]||[{_later}]]+")


def pieces(words: str) -> list[str]:
    """The pieces of what stands between white space."""
    return (PIECE if words.isascii() or not LATER.search(words) else PIECE_LATER).findall(words)


def lowered(text: str) -> str:
    """A text in composed form and lower case."""
    if text.isascii():
        return text.lower()
    own = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return (own.translate(LOWER) if CAPITAL.search(own) else own).lower()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """A vocabulary with word ends, lower case, and no decoder of its own."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.text = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t
        self._around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: Of a token: its bytes, and whether a word ends with it. The last byte of a word is a symbol of its own, 256 above.
        spelled: dict[int, tuple[bytes, bool]] = {}
        for b, c in enumerate(byte_letters()):
            spelled[vocab[c]] = (bytes([b]), False)
            spelled[vocab[c + END]] = (bytes([b]), True)
        #: Of a pair of tokens that merge (one number): its rank.
        self.rank: dict[int, int] = {}
        #: Of a token: how it was merged.
        self.tree: dict[int, tuple[int, int, int]] = {}
        for r, (left, right) in enumerate(data["model"]["merges"]):
            self.rank.setdefault(vocab[left] << 20 | vocab[right], r)
        for pair, r in sorted(self.rank.items(), key=lambda x: x[1]):
            left, right = pair >> 20, pair & 0xFFFFF
            # Only a token that its own encoding gives can be part of an encoding.
            if left not in spelled or right not in spelled or spelled[left][1] or not self._go_together(left, right, r):
                continue
            made = vocab[self.text[left] + self.text[right]]
            if made not in spelled:
                spelled[made] = (spelled[left][0] + spelled[right][0], spelled[right][1])
                self.tree[made] = (left, right, r)
        # The automaton: from a place in a word backwards, one state a symbol, with the token that ends there.
        self.steps: dict[int, int] = {}
        token = [-1]
        for i, (raw, ends) in spelled.items():
            at = 0
            for k in range(len(raw) - 1, -1, -1):
                step = at << 9 | raw[k] | (ends and k == len(raw) - 1) << 8
                if step not in self.steps:
                    self.steps[step] = len(token)
                    token.append(-1)
                at = self.steps[step]
            token[at] = i
        self.token = array("i", token)
        self._clear()

    def _clear(self) -> None:
        self._words, self._pairs, self._nodes = _Store(self), {}, {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_words", "_pairs", "_nodes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._clear()

    def _go_together(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether merging leaves the border between two tokens alone (at ranks below `before`).

        Along the border lie the right edge of the left token's merge tree and the left
        edge of the other's. A part stays there until its parent's merge; a pair across
        the border would merge if its rank comes first. Of equal ranks the one further
        left comes first.
        """
        rank, tree = self.rank, self.tree
        never = len(rank) + 1
        a, gone = left, never
        while True:
            b, taken = right, never
            while True:
                r = rank.get(a << 20 | b)
                if r is not None and r < gone and r <= taken and (before is None or r < before):
                    return False
                if b not in tree:
                    break
                b, _, taken = tree[b]
            if a not in tree:
                return True
            _, a, gone = tree[a]

    def word(self, piece: str) -> list[int]:
        """Ids of one piece of text.

        A node is the last token of a prefix and the node of what is left before it.
        Words share the nodes of their common prefixes, all but the end of a word.
        """
        s = piece.encode("utf-8", "replace")
        size = len(s)
        nodes, pairs, steps, token = self._nodes, self._pairs, self.steps, self.token
        if len(pairs) > STORE:
            pairs.clear()
        if len(nodes) > STORE:
            nodes.clear()
        local: list = [None] * (size + 1)
        known = min(size - 1, SHARED)
        while known and s[:known] not in nodes:
            known -= 1
        for end in range(known + 1, size + 1):
            k = end - 1
            at = steps[s[k] | (end == size) << 8]
            while True:  # the right token is met before the steps end
                t = token[at]
                if t >= 0:
                    if k == 0:
                        node = (t, None)
                        break
                    before = local[k] or nodes[s[:k]]
                    pair = before[0] << 20 | t
                    ok = pairs.get(pair)
                    if ok is None:
                        ok = pairs[pair] = self._go_together(before[0], t)
                    if ok:
                        node = (t, before)
                        break
                k -= 1
                at = steps[at << 9 | s[k]]
            local[end] = node
            if end <= SHARED and end < size:
                nodes[s[:end]] = node
        ids = []
        while node:
            ids.append(node[0])
            node = node[1]
        return ids[::-1]

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null has none."""
        if not text:
            return b""
        out = []
        for part in self._around.split(text) if self._around else [text]:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
                continue
            plain = lowered(part)
            self._words.turn()
            # No piece crosses white space, so what stands between is looked up whole.
            out.extend(map(self._words.__getitem__, plain.split() if SEPARATORS.isdisjoint(plain) else BLANK.split(plain)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids with blanks between, as a vocabulary without decoder has it."""
        return " ".join(map(self.text.__getitem__, ids))


class _Pieces(dict):
    """Packed ids of pieces: of the current generation, and of the one before it."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.old = bpe, {}

    def turn(self) -> None:
        """Start a new generation once this one is full."""
        if len(self) > STORE:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            ids = self.bpe.word(piece)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 40:
            self[piece] = out
        return out


class _Store(_Pieces):
    """Packed ids of what stands between white space, put together from those of its pieces."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__(bpe)
        self.pieces = _Pieces(bpe)

    def turn(self) -> None:
        super().turn()
        self.pieces.turn()

    def __missing__(self, words: str) -> bytes:
        out = self.old.get(words)
        if out is None:
            each = self.pieces
            if words.isalpha():
                out = each[words]
            elif words[-1:] in STOPS and words[:-1].isalpha():
                out = each[words[:-1]] + each[words[-1]]
            else:
                out = b"".join(map(each.__getitem__, pieces(words)))
        if len(words) < 40:
            self[words] = out
        return out


def unpacked(packed: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def word_vocabulary() -> str:
    """The path of the public vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _mapped(docs: DataFrame, text: str, keep: list[str], made: dict[str, pa.DataType], schema: StructType, vocabulary: str | None, run: Callable[[Bpe, list[str | None]], list[list]]) -> DataFrame:
    """Columns `keep` and new ones from the texts, a few hundred at a time, so that a task holds few texts and ids at once."""
    small_batches(docs.sparkSession)
    bpe = docs.sparkSession.sparkContext.broadcast(Bpe(vocabulary or word_vocabulary()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                columns = run(bpe.value, some.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(columns, made.values(), strict=True))], names=[*keep, *made])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(task, schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", keep: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """Columns `keep` (all by default) with an array of token ids; null and empty texts have an empty one. A column that is named like the ids gives way to them."""
    import numpy as np

    keep = [k for k in (docs.columns if keep is None else keep) if k != ids]
    schema = StructType([*(docs.schema[k] for k in keep), StructField(ids, ArrayType(IntegerType()))])
    return _mapped(docs, text, keep, {ids: pa.list_(pa.int32())}, schema, vocabulary, lambda bpe, texts: [[np.frombuffer(bpe.packed(t), "<u4").astype("int32") for t in texts]])


def decode(frame: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """`frame` with the text of an array of ids; a null array gives null, an empty one ''."""
    bpe = frame.sparkSession.sparkContext.broadcast(Bpe(vocabulary or word_vocabulary()))

    @F.pandas_udf("string")
    def run(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in arrays:
            yield pd.Series([None if a is None else bpe.value.decode([int(i) for i in a]) for a in some], dtype=object)

    return frame.withColumn(text, run(F.col(ids)))


def round_trip(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """Columns `keep` with `n_tokens`, and SHA-256 of the ids and of the text decoded from them. Columns with these names give way to them."""

    def run(bpe: Bpe, texts: list[str | None]) -> list[list]:
        rows = []
        for t in texts:
            packed = bpe.packed(t)
            ids = unpacked(packed)
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]

    made = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in made]
    schema = StructType([*(docs.schema[k] for k in keep), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return _mapped(docs, text, keep, made, schema, vocabulary, run)
