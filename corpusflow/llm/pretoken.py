"""Splitting a text into the words a public tokenizer file works on, as that library does.

The library's character classes follow an older Unicode version than the ones Python and ``regex`` have here.
A text with a code point that was unassigned in the older one ("unsettled") is left to the library itself.
"""

from __future__ import annotations

import json
import unicodedata

import regex

#: The split patterns of the two public tokenizer files.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same in texts of ASCII characters only.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""


#: Tokenizer files, and which letters are unsettled, as far as this task has met them.
_FILES: dict[str, dict] = {}
_UNSETTLED: dict[str, bool] = {}


def spec(path: str) -> dict:
    """The tokenizer file, read once."""
    if path not in _FILES:
        with open(path, encoding="utf-8") as file:
            _FILES[path] = json.load(file)
    return _FILES[path]


def byte_letters() -> tuple[str, ...]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next of U+0100 and up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return tuple(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


def _unsettled(letter: str) -> bool:
    known = _UNSETTLED.get(letter)
    if known is None:
        known = _UNSETTLED[letter] = unicodedata.category(letter) == "Cn"
    return known


def settled(text: str) -> bool:
    """Whether both sides classify every character of the text alike."""
    return text.isascii() or not any(map(_unsettled, set(text)))


def specials(path: str) -> regex.Pattern | None:
    """Matches the special tokens that the library recognises inside a raw text."""
    found = [regex.escape(t["content"]) for t in spec(path)["added_tokens"]]
    return regex.compile("(" + "|".join(found) + ")") if found else None


def lowered(text: str) -> str:
    """NFC, then lower case letter by letter (no special form for a sigma that ends a word)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
