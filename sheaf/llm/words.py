"""Words for shingles and phrases: runs of ASCII digits, ASCII letters in lower case, and anything beyond ASCII."""

from __future__ import annotations

import re

#: Byte by byte: letters to lower case, what is no word to blanks. Bytes of characters beyond ASCII stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8; none for null."""
    return text.encode("utf-8", "replace").translate(TABLE).split() if text else []
