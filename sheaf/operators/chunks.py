"""Text in overlapping chunks. Each cut depends on the one before, so this is a helper over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import or_empty, trimmed
from sheaf.sources.shared import small_batches

#: Characters of a chunk, of what it shares with the next one, and the share of a chunk before which it is not cut. Fixed values.
SIZE, OVERLAP, EARLIEST = 3000, 300, 0.55
#: Kinds of places where a chunk may end, the best first.
PARAGRAPH, HEADING, TITLE, SENTENCE, BLANK = range(5)
#: What a title line may hold beside letters, and its shortest and longest length. Fixed values.
TITLE_MARKS, TITLE_LENGTH = " /&(),.-", range(3, 82)
_GAP = re.compile(r"\s+")


def _is_title(line: str) -> bool:
    return len(line) in TITLE_LENGTH and line.isascii() and line[0].isupper() and all(x.isalpha() or x in TITLE_MARKS for x in line)


def gap_kind(text: str, start: int, a: int, b: int) -> tuple[int, int]:
    """Of the gap `text[a:b]` (white space) in a chunk that began at `start`: its kind, and where a chunk that ends there would end."""
    gap = text[a:b]
    feed = gap.find("\n")
    if feed >= 0 and gap.find("\n", feed + 1) >= 0:
        return PARAGRAPH, a + gap.rindex("\n") + 1
    line = text.rfind("\n", start, a)  # the line feed before the line that the gap follows
    if line >= 0:
        word = text[line + 1 : a]
        if word and len(word) <= 6 and not word.strip("#"):
            return HEADING, b
        if feed == 0 and _is_title(word):
            return TITLE, a + 1
    return (SENTENCE if a > start and text[a - 1] in ".!?" else BLANK), b


def cut_place(text: str, start: int, stop: int, least: int) -> int:
    """Where the chunk from `start` ends, `stop` at the latest: behind the last gap of the best kind that ends at `least` or later, else at `stop`."""
    best: dict[int, int] = {}
    # Gaps that end before `least` do not count; one that ends there may begin before.
    first = least
    while first > start and text[first - 1].isspace():
        first -= 1
    for m in _GAP.finditer(text, first, stop):
        if m.end() >= least:
            kind, end = gap_kind(text, start, *m.span())
            if end >= least:
                best[kind] = end
    return best[min(best)] if best else stop


def cuts(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges of the chunks of a trimmed text.

    The next chunk starts `overlap` characters before the end of the last one, or at
    its end if that would not be further on.
    """
    size = size if size > 0 else SIZE
    shared = min(overlap if overlap > 0 else OVERLAP, size - 1)
    out: list[tuple[int, int]] = []
    start = 0
    while not out or out[-1][1] < len(text):
        stop = start + size
        end = len(text) if stop >= len(text) else cut_place(text, start, stop, start + int(size * EARLIEST))
        out.append((start, end))
        start = end - shared if end - shared > start else end
    return out if text else []


def chunk_text(rows: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """`id`, `chunk_id`, `chunk_index`, `chunk_count`, `text`, `char_start`, `char_end`, and the columns `keep`; other fields of a record stay with its id.

    Texts are trimmed; null and blank ones have no chunk. An overlap that is not
    positive means the default one.
    """

    @F.pandas_udf("array<struct<text:string,char_start:int,char_end:int>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([[{"text": t[a:b], "char_start": a, "char_end": b} for a, b in cuts(t, size, overlap)] for t in ((x or "").strip() for x in some)], dtype=object)

    small_batches(rows.sparkSession)
    made = rows.select("id", *keep, run(F.col(text)).alias("c"))
    each = made.select("id", *keep, F.size("c").alias("chunk_count"), F.posexplode("c").alias("chunk_index", "c"))
    number = F.lpad((F.col("chunk_index") + 1).cast("string"), 4, "0")
    return each.select("id", F.concat("id", F.lit(":chunk:"), number).alias("chunk_id"), "chunk_index", "chunk_count", "c.text", "c.char_start", "c.char_end", *keep)


def count_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """How many chunks a text has, without making them. Only texts of more than one chunk are sent to Python."""
    limit = size if size > 0 else SIZE

    @F.pandas_udf("int")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([None if t is None else len(cuts(t.strip(), size, overlap)) for t in some], dtype="Int32")

    long = F.length(trimmed(or_empty(text)))
    return F.coalesce(run(F.when(long > limit, text)), (long > 0).cast("int"))
