"""Arrow UDFs: the few things the built-in functions cannot say.

Each is handed NULL for rows that do not need it (plain ASCII text): those
cross to Python as nulls, without their text.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.basic import col, let

_MARKS = r"\u0300-\u036f"
_TONES = r"\u00b4\u02b9-\u02ff"


def has_non_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.char_length(c)


def _only_where_needed(fn, c: Column) -> Column:
    return F.coalesce(fn(let(c, lambda x: F.when(has_non_ascii(x), x))), c)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        text = re.sub(rf"\s+(?=[{_MARKS}])", "", unicodedata.normalize("NFKD", text))
        return "".join(ch for ch in text if not unicodedata.combining(ch)).lower()

    return s.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(
        lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(),
        na_action="ignore",
    )


@F.pandas_udf(T.StringType())
def _reattach(s: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        text = unicodedata.normalize("NFD", text)
        text = re.sub(rf"\s+(?=[{_MARKS}{_TONES}])", "", text)
        text = re.sub(rf"(?<=\s)[{_MARKS}{_TONES}]+", "", text)
        return unicodedata.normalize("NFC", text)

    return s.map(one, na_action="ignore")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one row of bits per character of ``b``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def nfkc(c: Column | str) -> Column:
    return _only_where_needed(_nfkc, col(c))


def fold(c: Column | str) -> Column:
    """Accent-free lower case."""
    return F.lower(_only_where_needed(_fold, col(c)))


def ascii_only(c: Column | str) -> Column:
    """Accents removed, anything still outside ASCII dropped."""
    return _only_where_needed(_ascii, col(c))


def reattach_marks(c: Column | str) -> Column:
    return _only_where_needed(_reattach, col(c))


def ratcliff_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff–Obershelp ratio; NULL where the longest common subsequence, which bounds it, keeps it below ``least``."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None or (least > 0 and 2.0 * common_length(x, y) < least * (len(x) + len(y)) - 1e-9):
                return None
            return SequenceMatcher(None, x, y).ratio()

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio(a, b)
