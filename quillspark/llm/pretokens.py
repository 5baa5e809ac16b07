"""Pre-token splitting, as the public byte-level vocabularies expect it."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

#: Code points below this are split by a compiled class table; a text with any other takes the general pattern.
FAST_BELOW = 0x250


def _ranges(of: str) -> str:
    """The code points under FAST_BELOW whose general category begins with the letter, as a character class."""
    return "".join(re.escape(chr(c)) for c in range(FAST_BELOW) if unicodedata.category(chr(c)).startswith(of))


@lru_cache(1)
def _fast() -> tuple[re.Pattern, re.Pattern]:
    letter, number = _ranges("L"), _ranges("N")
    space = "".join(re.escape(chr(c)) for c in range(FAST_BELOW) if regex.match(r"\s", chr(c)))
    parts = (
        f" ?[{letter}]+",
        "'(?:s|t|re|ve|m|ll|d)",
        f" ?[{number}]+",
        f" ?[^{space}{letter}{number}]+",
        f"[{space}]+(?![^{space}])",
        f"[{space}]+",
    )
    return re.compile("|".join(parts)), re.compile(f"[^\\x00-\\u{FAST_BELOW - 1:04x}]")


@lru_cache(8)
def splitter(pattern: str):
    """A function that lists the matches of the pattern in a text.

    The usual pattern (letters, numbers, other signs, white space) has a twin over a class table, about twice as fast, for texts
    in Latin script; it lists the same matches, since its alternatives begin with different characters and may be reordered.
    """
    general = regex.compile(pattern)
    import public_tokenizers

    if pattern != public_tokenizers.PATTERN:
        return general.findall
    fast, beyond = _fast()

    def split(text: str) -> list[str]:
        if text.isascii() or beyond.search(text) is None:
            return fast.findall(text)
        return general.findall(text)

    return split
