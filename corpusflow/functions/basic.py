"""Small column helpers shared by every operator."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Unicode white space as the members of a regex class. Spelled out, since
#: ``\\s`` alone is ASCII and the ``(?U)`` flag is slow.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column | str) -> Column:
    """Strip Unicode white space at both ends (SQL ``trim`` strips blanks only)."""
    return F.btrim(col(c), F.lit(_SPACE_CHARS))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one blank; NULL becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"[{SPACE}]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is otherwise computed anew for every
    element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def nullif_blank(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def alternation(values: Iterable[str]) -> str:
    """A regex alternation of literal strings."""
    return "|".join(re.escape(v) for v in values)


def string_array(values: Iterable[str]) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items) if items else F.array().cast("array<string>")


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 2**31 - 1)))),
        "",
    )


def percent_decode(c: Column | str) -> Column:
    """Decode %XX escapes; ``+`` and malformed escapes stay as they are."""
    safe = F.regexp_replace(col(c), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def percent_encode(c: Column | str, keep_slash: bool = True) -> Column:
    """Encode as a path component: blanks become ``%20``, ``/`` and ``~`` stay."""
    out = F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))
    out = F.replace(F.replace(out, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def first_match(items: Column, predicate) -> Column:
    """First array element that satisfies ``predicate``, else NULL."""
    return F.try_element_at(F.filter(items, predicate), F.lit(1))
