"""Text expressions: sentences, tokens, stems, byte vectors and character embeddings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUL = b"\x00"


def _never_null(strings: Column) -> Column:
    """Where Catalyst knows an array cannot be null it infers no null filter, which would compute it again."""
    return F.coalesce(strings, F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Array of sentences: cut after ``.!?`` plus whitespace and at line breaks, trimmed, empties dropped.

    Empty for a null text.
    """
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n+")
    return _never_null(F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != ""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; empty for a null text."""
    return _never_null(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def s_stem(term: Column) -> Column:
    """Plural-suffix stemming (Harman 1991): first rule whose suffix fits decides."""
    def ends(*suffixes: str) -> Column:
        hit = F.lit(False)
        for suffix in suffixes:
            hit = hit | term.endswith(suffix)
        return hit

    def cut(n: int) -> Column:
        return F.left(term, F.length(term) - n)

    return (
        F.when(ends("ies") & ~ends("eies", "aies"), F.concat(cut(3), F.lit("y")))
        .when(ends("es") & ~ends("aes", "ees", "oes"), cut(1))
        .when(ends("s") & ~ends("us", "ss"), cut(1))
        .otherwise(term)
    )


# The suffix tables of Porter's algorithm (Porter 1980), steps 2, 3 and 4.
PORTER_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble",
}
PORTER_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
PORTER_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """The word as c(onsonant) / v(owel) letters; y after a consonant is a vowel."""
    shape = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _closed(stem: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) >= least else word
    return word


def porter(word: str) -> str:
    """Stem of one lower-case ASCII word (Porter 1980); other words come back unchanged."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                doubled = len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"
                if stem.endswith(("at", "bl", "iz")):
                    word = stem + "e"
                elif doubled and stem[-1] not in "lsz":
                    word = stem[:-1]
                elif _measure(stem) == 1 and _closed(stem):
                    word = stem + "e"
                else:
                    word = stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, PORTER_STEP2, 1)
    word = _swap(word, PORTER_STEP3, 1)
    for suffix in sorted(PORTER_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _closed(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def porter_stem(terms: pd.Series) -> pd.Series:
    """Apply to a table of distinct terms, then join back; never to every token."""
    return terms.map(porter)


def byte_cut(text: Column, size: int) -> Column:
    """Bytes of the longest whole-character prefix that fits ``size`` UTF-8 bytes."""
    raw = F.encode(text, "UTF-8")

    def inside(position: int) -> Column:
        """Whether the byte at this 1-based position continues a character."""
        return F.hex(F.substring(raw, position, 1)).between("80", "BF")

    return (
        F.when(F.length(raw) <= size, F.length(raw))
        .when(~inside(size + 1), size)
        .when(~inside(size), size - 1)
        .when(~inside(size - 1), size - 2)
        .otherwise(size - 3)
    )


def byte_encode(text: Column, size: int) -> Column:
    """UTF-8 bytes of the text in exactly ``size`` bytes: cut at a whole character, padded with zeros."""
    raw = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte_cut(text, size))
    return F.rpad(raw, size, F.lit(NUL))


def byte_decode(vector: Column) -> Column:
    """Text of a byte vector, without its trailing zeros."""
    return F.rtrim(F.decode(vector, "UTF-8"), F.char(F.lit(0)))


def md5_int(text: Column, digits: int) -> Column:
    """The first hex digits of the text's md5 as a number."""
    return F.conv(F.left(F.md5(text), F.lit(digits)), 16, 10).cast("long")


# Multiplier of the gram hash and the factor that mixes it (hash * MIX / 65536).
GRAM_BASE, GRAM_MIX = 131, 40503


def gram_embedding(text: str | None, dim: int, n: int) -> np.ndarray:
    """Bucket counts of the text's character n-grams, scaled to length 1; zero for texts shorter than n."""
    letters = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(letters) < n:
        return np.zeros(dim)
    grams = np.zeros(len(letters) - n + 1, dtype=np.int64)
    for i in range(n):
        grams = grams * GRAM_BASE + letters[i : i + len(grams)]
    counts = np.bincount((grams * GRAM_MIX >> 16) % dim, minlength=dim).astype(np.float64)
    return counts / np.sqrt((counts * counts).sum())


def char_embedding(text: Column, dim: int = 64, n: int = 3) -> Column:
    """Unit vector of hashed character n-grams (``gram_embedding``), computed row by row in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: gram_embedding(t, dim, n))

    return embed(text)
