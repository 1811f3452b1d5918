"""Personal and corporate names, and arrays of them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.arrow import reattach_marks
from corpusflow.functions.basic import alternation, col, collapse, let, strip, title_case

def _latin_accents() -> dict[str, str]:
    """Lower-case Latin letters that decompose to one plain letter plus marks."""
    table = {}
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = "".join(ch for ch in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(ch))
        if letter == letter.lower() and len(base) == 1 and base.isascii():
            table[letter] = base
    return table


#: Folding by table, since a UDF cannot be called from within a lambda.
_ACCENTS = _latin_accents()


def fold_name(c: Column) -> Column:
    """Accent-free lower case of a Latin name, usable inside lambdas."""
    lowered = F.regexp_replace(F.lower(c), r"\p{M}+", "")
    return F.translate(lowered, "".join(_ACCENTS), "".join(_ACCENTS.values()))


def _is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def clean_name(raw: Column | str) -> Column:
    """'Given Family' from catalogue forms of a name."""
    name = collapse(raw)
    name = F.regexp_replace(name, r"\([^)]*\)", "")
    name = F.regexp_replace(name, rules.LIFE_DATES, "")
    name = F.regexp_replace(name, rules.TRAILING_ROLE, "")
    name = F.regexp_replace(name, r"^[ ,;.]+|[ ,;.]+$", "")
    name = strip(F.regexp_replace(name, rules.LEADING_ROLE, ""))
    # exactly one comma with something on both sides
    name = F.regexp_replace(name, r"^([^,]*[^,\s])\s*,\s*([^,\s][^,]*)$", "$2 $1")
    name = collapse(name)
    name = let(name, lambda n: F.when(_is_upper(n) & (F.char_length(n) > 4), title_case(n)).otherwise(n))
    return F.regexp_replace(name, r"(?i)\bunesco\b", "UNESCO")


def _letters(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold_name(name), r"[^a-z ]+", " "), r"\s+", " "))


def is_plausible_person(name: Column) -> Column:
    letters = _letters(name)
    return (
        ~letters.isin(*rules.JUNK_AUTHORS)
        & (F.char_length(letters) >= 4)
        & ~fold_name(name).rlike(alternation(rules.JUNK_FRAGMENTS))
        & ~name.rlike(r"[\d_]")
        & letters.contains(" ")
    )


def is_plausible_creator(name: Column) -> Column:
    """Looser gate for curated catalogue fields: organisations may pass."""
    letters = _letters(name)
    single = ~strip(name).contains(" ")
    return (
        ~letters.isin(*rules.JUNK_AUTHORS)
        & (F.char_length(letters) >= 3)
        & ~name.rlike(r"(?i)[_@\d]|www\.|https?:|\.(?:com|org|info|net)\b")
        & (~single | (_is_upper(name) & (F.char_length(name) >= 3)))
    )


def tidy_extracted_name(raw: Column | str) -> Column:
    """Repair a name lifted from document text."""
    words = F.split(clean_name(reattach_marks(raw)), " ")
    return F.array_join(
        F.transform(words, lambda w: F.when(_is_upper(w) & (F.char_length(w) > 2), title_case(w)).otherwise(w)),
        " ",
    )


def split_name_list(raw: Column | str) -> Column:
    """One string per person. A comma separates people only when every piece
    has several words; otherwise it is 'Family, Given'."""
    parts = F.split(col(raw), r"\s*(?:;|\band\b|&)\s*")

    def pieces_of(part: Column) -> Column:
        people = lambda p: (F.size(p) > 1) & F.forall(p, lambda x: x.rlike(r"\S\s+\S"))
        pieces = F.transform(F.split(part, ","), strip)
        return let(pieces, lambda p: F.when(people(p), p).otherwise(F.array(part)))

    return F.filter(F.flatten(F.transform(parts, pieces_of)), lambda p: strip(p) != "")


def unique_names(names: Column) -> Column:
    """Distinct by folded spelling, first spelling kept, order kept."""
    keyed = F.transform(names, lambda n: F.struct(n.alias("name"), fold_name(n).alias("key")))
    firsts = let(
        keyed,
        lambda all_: F.filter(
            all_, lambda k, i: (k["name"] != "") & (F.array_position(all_["key"], k["key"]) == i + 1)
        ),
    )
    return F.transform(firsts, lambda k: k["name"])


def format_authors(names: Column, shown: int = rules.MAX_AUTHORS_SHOWN) -> Column:
    joined = F.array_join(F.slice(names, 1, shown), "; ")
    return F.when(F.size(names) > shown, F.concat(joined, F.lit("; et al."))).otherwise(joined)


def first_author(authors: Column | str) -> Column:
    """First name of an 'A; B; C' cell, '' when it is not a person."""
    first = strip(F.element_at(F.split(strip(F.coalesce(col(authors), F.lit(""))), r"\s*;\s*"), 1))
    return F.when(F.lower(first).isin(*rules.NOT_A_PERSON), "").otherwise(first)


def _name_words(name: Column) -> Column:
    return F.regexp_extract_all(fold_name(name), F.lit(r"([a-z'\-]+)"), F.lit(1))


def _quoted(word: Column) -> Column:
    return F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))


def surname_in_text(name: Column, folded_text: Column) -> Column:
    """The family name (last word of three or more letters) occurs as a word."""
    family = F.try_element_at(F.filter(_name_words(name), lambda w: F.length(w) >= 3), F.lit(-1))
    pattern = F.concat(F.lit("(?<![a-z])"), _quoted(family), F.lit("(?![a-z])"))
    return F.coalesce(F.regexp(folded_text, pattern), F.lit(False))


def name_in_text(name: Column, folded_text: Column) -> Column:
    """The family name is printed next to the given name or its initial."""
    words = _name_words(name)
    family, given = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(1))
    first = F.concat(F.lit("(?:"), _quoted(given), F.lit("|"), _quoted(F.left(given, F.lit(1))), F.lit(r"\.?)"))
    before, after = F.lit("(?<![a-z])"), F.lit("(?![a-z])")
    near = F.concat(before, first, after, F.lit(".{0,30}?"), before, _quoted(family), after)
    inverted = F.concat(before, _quoted(family), after, F.lit(r"\s*,\s*"), first, after)
    known = (F.size(words) >= 2) & (F.length(family) >= 2)
    found = F.regexp(folded_text, F.concat(near, F.lit("|"), inverted))
    return F.coalesce(F.when(known, found), F.lit(False))
