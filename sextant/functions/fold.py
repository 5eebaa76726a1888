"""Folds that Spark has no expression for, vectorised over Arrow batches."""

from __future__ import annotations

import functools
import html
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SCRIPTLESS = re.compile(r"[^\x00-\x7f]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@functools.cache
def _marks() -> str:
    """All combining marks, for a character class."""
    return "".join(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.combining(c))


@functools.cache
def _marked(bases: str) -> re.Pattern:
    """A base character of a class, and the marks on it."""
    return re.compile(f"({bases})[{_marks()}]+")


def _decomposed(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFKD", s)


def plain_text(s: str) -> str:
    """Lower case without accents: what is ASCII of it, or, of a name that has no
    ASCII letter or digit, all letters of its script."""
    bare = _decomposed(s).lower()
    if not bare.isascii():
        bare = _marked(".").sub(r"\1", bare)
        latin = _SCRIPTLESS.sub("", bare)
        return latin if re.search(r"[^ .,'\-]", latin) else bare
    return bare


def fold_key(kind: str, name: str) -> str:
    """Key under which corpora merge: accents on Latin letters go (the blocks below
    U+0250), marks of other scripts stay; then case folds and blanks collapse."""
    shape = _decomposed(name)
    if not shape.isascii():
        shape = unicodedata.normalize("NFC", _marked("[\x00-\u024f]").sub(r"\1", shape))
    return kind + ":" + re.sub(r"\s+", " ", shape.casefold()).strip()


def title_words(s: str) -> str:
    """Each run of letters with a capital first: O'NEILL becomes O'Neill."""
    return _LETTERS.sub(lambda m: m[0][0].upper() + m[0][1:].lower(), s)


@F.pandas_udf(StringType())
def plain(s: pd.Series) -> pd.Series:
    return s.map(plain_text, na_action="ignore")


@F.pandas_udf(StringType())
def gkey(kind: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else fold_key(k, n) for k, n in zip(kind, name, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def title(s: pd.Series) -> pd.Series:
    return s.map(title_words, na_action="ignore")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")
