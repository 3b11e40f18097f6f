"""Text columns. Output columns hold '' rather than null, and blank means white space only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space characters. Fixed values.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: White space with no-break and other Unicode spaces, as everywhere in this library.
SPACES = r"(?U)\s+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once a row, wherever `use` has it, lambdas included."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_nonempty(*cs: Column | str) -> Column:
    """The first that is neither null nor ''; '' if there is none. Blank text counts as text."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cs), F.lit(""))


def trimmed(c: Column) -> Column:
    """Without any white space at either end (`trim` alone takes blanks only)."""
    return F.btrim(c, F.lit(BLANKS))


def squashed(c: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def folded(c: Column) -> Column:
    """For comparing labels: squashed, lower case."""
    return F.lower(squashed(or_empty(c)))


#: White space in a line that is no blank, as part of a class of a regular expression.
_INNER = r"\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a text may need squashing for: most texts have none of it, and one quick search tells.
ODD = r"[^ -~\n]|[ \n](?:[ \n]|\z)|\A[ \n]"
#: What a text with other characters is searched for then: letters with accents need no squashing.
UNEVEN = rf"[{_INNER}]|[ \n](?:[ \n]|\z)|\A[ \n]"
#: What of white space is not as it should be: runs and other characters within lines, about line ends, and at a text's ends.
_UNEVEN, _ENDS, _OUTER = rf" [ {_INNER}]++|(?=[^ -~])[{_INNER}][ {_INNER}]*+", r" \n[ \n]*+|\n[ \n]++", r"\A[ \n]|[ \n]\z"


def lines(c: Column) -> Column:
    """Non-empty lines, each squashed; a carriage return ends a line too."""
    return let(normalize_text(c), lambda own: F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, "\n", -1)))


def normalize_text(c: Column) -> Column:
    """Lines squashed, empty ones dropped, line ends kept. Only what changes is matched, in the whole text, not line by line."""

    def squash(own: Column) -> Column:
        ended = F.regexp_replace(F.replace(own, F.lit("\r"), F.lit("\n")), _UNEVEN, " ")
        return F.when(own.rlike(ODD) & own.rlike(UNEVEN), F.regexp_replace(F.regexp_replace(ended, _ENDS, "\n"), _OUTER, "")).otherwise(own)

    return let(or_empty(c), squash)


def labelize(c: Column) -> Column:
    """`a-b` as `A B`; only first letters change."""
    return F.array_join(F.transform(F.split(or_empty(c), "-", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def text_hash(c: Column) -> Column:
    """A 32-bit hash in base 36: from 5381, times 33 and xor with each character's code.

    Short ids need it for compatibility; at scale two texts in a scope collide near
    77,000 rows, so merges also go by `content_key`.
    """
    codes = F.transform(F.split(or_empty(c), "(?!^)(?!$)"), lambda x: F.ascii(x).cast("long"))
    own = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, x: (h * 33).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(x))
    return F.lower(F.conv(F.when(or_empty(c) == "", 5381).otherwise(own).cast("string"), 10, 36))


def _hashes(texts: Sequence[str]) -> np.ndarray:
    """The number of `text_hash` of each text, a character of all texts at a time."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    codes = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    starts, own = np.cumsum(sizes) - sizes, np.full(len(texts), 5381, dtype=np.int64)
    longest, at = int(sizes[0]) if len(sizes) else 0, 0
    # Texts that still have a character stand first; the last few go one by one.
    while at < longest and (left := int(np.searchsorted(-sizes, -at, "left"))) >= FEW:
        own[:left] = ((own[:left] * 33) & 0xFFFFFFFF) ^ codes[starts[:left] + at]
        at += 1
    for k in range(int(np.searchsorted(-sizes, -at, "left"))):
        h = int(own[k])
        for code in codes[starts[k] + at : starts[k] + sizes[k]].tolist():
            h = ((h * 33) & 0xFFFFFFFF) ^ code
        own[k] = h
    out = np.empty(len(texts), dtype=np.int64)
    out[order] = own
    return out


#: Texts of a batch that are hashed at once at least.
FEW = 32


def text_hash_batched(c: Column) -> Column:
    """`text_hash` in batches, for rows that go to Python anyway: columns take a text apart into an array of characters."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_hashes(list(texts)), dtype="int64")

    return F.lower(F.conv(run.asNondeterministic()(or_empty(c)).cast("string"), 10, 36))


def content_key(*cs: Column | str) -> Column:
    """A 256-bit key of several texts, nulls as ''."""
    return F.sha2(F.concat_ws("\0", *(or_empty(c) for c in cs)), 256)
