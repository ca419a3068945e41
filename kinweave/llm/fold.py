"""Folding of names and words as people write them, shared by the operators on free text."""

from __future__ import annotations

import unicodedata

#: Letters that do not decompose, as they are written without the right type. Fixed values.
_LETTERS = str.maketrans({"þ": "th", "ð": "d", "æ": "ae", "ö": "o", "ø": "o", "å": "a", "ß": "ss", "œ": "oe", "ł": "l", "đ": "d"})


def folded(text: str) -> str:
    """Lower case without accents, Icelandic letters as plain ones."""
    t = unicodedata.normalize("NFC", text).lower().translate(_LETTERS)
    if t.isascii():
        return t
    return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
