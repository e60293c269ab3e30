"""Word normalisation shared by the text operators."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

_WORD = re.compile(r"[^\W_]+")


@cache
def _dropped() -> dict[int, None]:
    """Marks (accents) and format characters (zero-width, soft hyphen, direction): they do not count."""
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf")}


def fold(text: str) -> str:
    """Text without regard to case, accents, compatibility forms and invisible characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", text).translate(_dropped()).casefold()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text; every other character separates."""
    return _WORD.findall(fold(text)) if text else []


def words_at(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words with the places in ``text`` where they begin and end (exclusive)."""
    pieces, origin = [], []
    for i, c in enumerate(text):
        piece = fold(c)
        pieces.append(piece)
        origin += [i] * len(piece)
    folded = "".join(pieces)
    spans = [m.span() for m in _WORD.finditer(folded)]
    return [folded[a:b] for a, b in spans], [origin[a] for a, _ in spans], [origin[b - 1] + 1 for _, b in spans]
