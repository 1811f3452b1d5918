"""Text columns: sanitising, budgets, chunking, matching, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.arrow import ascii_only, nfkc
from corpusflow.functions.basic import SPACE, alternation, col, let, percent_decode, string_array, strip

_RESERVED = rf"(?iu)</?\s*(?:{alternation(rules.RESERVED_TAGS)})\s*>"


def sanitize(text: Column | str) -> Column:
    """Make untrusted text safe to place inside a template.

    Compatibility-normalise, drop control and zero-width characters (new line
    and tab stay), defang reserved tags and chat scaffolding, shorten runs of
    white space.
    """
    out = F.regexp_replace(nfkc(text), r"[\p{C}&&[^\n\t]]", "")
    out = F.regexp_replace(out, _RESERVED, rules.QUOTED_TAG)
    out = F.regexp_replace(out, rules.SCAFFOLD, rules.QUOTED_TAG)
    out = F.regexp_replace(out, r"[ \t]{3,}", "  ")
    out = F.regexp_replace(out, r"\n{4,}", "\n\n\n")
    return strip(out)


def estimate_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(col(text)) / 4)).cast("int")


def prompt_verdict(
    raw: Column | str,
    budget: int = rules.PROMPT_TOKEN_BUDGET,
    max_chars: int = rules.PROMPT_MAX_CHARS,
    clean: Column | None = None,
) -> Column:
    """``ok``, or why a prompt is refused."""
    raw = col(raw)
    clean = sanitize(raw) if clean is None else clean
    return (
        F.when((F.char_length(raw) < 1) | (F.char_length(raw) > max_chars), "bad_length")
        .when(clean == "", "empty")
        .when(estimate_tokens(clean) > budget, "over_budget")
        .otherwise("ok")
    )


def scope_allowed(scope: Column | str, allowed: Sequence[str]) -> Column:
    return F.coalesce(col(scope).isin(*allowed), F.lit(False))


def chunk_chars(
    text: Column | str,
    size: int = rules.CHUNK_CHARS,
    overlap: int = rules.CHUNK_OVERLAP_CHARS,
) -> Column:
    """Overlapping chunks cut at word or blank boundaries, as an array.

    A chunk ends at the first boundary between a word and white space at or
    after ``size`` characters, and the next one starts ``overlap`` characters
    before that end (even inside a word). A text that ends exactly on such a
    boundary still yields the overlap as a last chunk.

    Without their overlaps the chunks are back-to-back pieces, so one regular
    expression finds them all in a single linear scan.
    """
    if 2 * overlap > size:
        raise ValueError("overlap must not exceed half the chunk size")
    rest_of_run = rf"(?:[{SPACE}]+|[^{SPACE}]+)"
    first, later = rf"\A.{{{size - 1}}}{rest_of_run}", rf"(?!\A).{{{size - overlap - 1}}}{rest_of_run}"
    found = F.regexp_extract_all(col(text), F.lit(rf"(?s)({first}|{later}|.+)"), F.lit(1))

    def close(pieces: Column) -> Column:
        full = F.when(F.size(pieces) > 1, size - overlap).otherwise(size)
        closed = F.char_length(F.try_element_at(pieces, F.lit(-1))) >= full
        return F.when(closed, F.array_append(pieces, F.lit(""))).otherwise(pieces)

    def overlay(pieces: Column) -> Column:
        # the overlap is the tail of the piece before
        tails = F.transform(pieces, lambda p: F.right(p, F.lit(overlap)))
        leads = F.slice(F.concat(F.array(F.lit("")), tails), F.lit(1), F.size(pieces))
        return F.zip_with(pieces, leads, lambda p, lead: strip(F.concat(lead, p)))

    return F.filter(let(let(found, close), overlay), lambda c: c != "")


def chunk_tokens(
    text: Column | str,
    size: int = rules.CHUNK_TOKENS,
    overlap_percent: int = rules.CHUNK_OVERLAP_PERCENT,
) -> Column:
    """Fixed windows of ``size`` white-space tokens:
    ``array<struct<n_tokens, chunk>>``, tokens joined by blanks.

    A window that would only repeat the tail of the one before is not made.
    """
    overlap = size * overlap_percent // 100
    tokens = F.split(strip(text), rf"[{SPACE}]+")

    def windows(all_tokens: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_tokens) - overlap), F.lit(size - overlap))
        cuts = F.transform(starts, lambda s: F.slice(all_tokens, s, F.lit(size)))
        return F.transform(cuts, lambda t: F.struct(F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("chunk")))

    return F.filter(let(tokens, windows), lambda w: w["chunk"] != "")


def session_title(prompt: Column | str) -> Column:
    return F.left(col(prompt), F.lit(rules.SESSION_TITLE_CHARS))


def preview(text: Column | str) -> Column:
    return F.left(col(text), F.lit(rules.PREVIEW_CHARS))


def snippet(text: Column | str, chars: int = rules.SNIPPET_CHARS) -> Column:
    return F.left(col(text), F.lit(chars))


def latin_words(text: Column | str) -> Column:
    """Lower-case ``[a-z0-9]`` words joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^a-z0-9]+", " "))


def concept_tokens(concept: Column | str, stopwords: Sequence[str] = rules.RELEVANCE_STOPWORDS) -> Column:
    words = F.regexp_extract_all(F.lower(col(concept)), F.lit(r"([a-z0-9]{3,})"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(*stopwords))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def relevance_ratio(concept: Column | str, title: Column, url: Column, snippet_: Column | None = None) -> Column:
    """Share of the concept's tokens found in title, address and snippet."""
    words = F.regexp_replace(percent_decode(F.coalesce(url, F.lit(""))), r"[^a-zA-Z0-9]+", " ")
    hay = F.lower(
        F.concat_ws(
            " ", F.coalesce(title, F.lit("")), words,
            F.coalesce(snippet_, F.lit("")) if snippet_ is not None else F.lit(""),
        )
    )
    both = F.struct(concept_tokens(concept).alias("tokens"), hay.alias("hay"))

    def share(b: Column) -> Column:
        hits = F.size(F.filter(b["tokens"], lambda t: b["hay"].contains(t)))
        return F.when(F.size(b["tokens"]) == 0, F.lit(1.0)).otherwise(hits / F.size(b["tokens"]))

    return let(both, share)


def is_relevant(concept, title, url, snippet_=None, min_ratio: float = rules.RELEVANCE_MIN_RATIO) -> Column:
    return relevance_ratio(concept, title, url, snippet_) >= min_ratio


def phrase_in_text(phrase: Column | str, text: Column | str, whole_words: bool = False) -> Column:
    """The normalised phrase occurs in the normalised text.

    By default it may start or end inside a word ("nok" is found in "nokia");
    ``whole_words`` asks for word boundaries.
    """
    needle, hay = latin_words(phrase), latin_words(text)
    if whole_words:
        found = F.concat(F.lit(" "), hay, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))
    else:
        found = hay.contains(needle)
    return (needle != "") & found


def is_machine_written(authors: Column, markers: Sequence[str] = rules.MACHINE_AUTHOR_MARKERS) -> Column:
    return F.lower(F.concat_ws(" ", authors)).rlike(alternation(markers))


def folded_ascii(text: Column | str) -> Column:
    return F.lower(ascii_only(text))


def title_coverage(title: Column, text: Column, stopwords: Sequence[str] = rules.TITLE_STOPWORDS) -> Column:
    """Share of the title's distinctive words found in a text; NULL when it has
    fewer than two and nothing can be said.

    Both sides are columns already passed through :func:`folded_ascii`.
    """
    words = F.array_distinct(
        F.filter(F.regexp_extract_all(title, F.lit(r"([a-z]{4,})"), F.lit(1)), lambda w: ~w.isin(*stopwords))
    )
    hits = F.size(F.filter(words, lambda w: text.contains(w)))
    return F.when(F.size(words) >= 2, hits / F.size(words))


def title_matches(title: Column, text: Column, min_ratio: float = 0.5) -> Column:
    return F.coalesce(title_coverage(title, text) >= min_ratio, F.lit(True))


def marker_flags(text: Column | str, markers: Sequence[str] = rules.DEMEANING_MARKERS) -> Column:
    """The listed markers that occur in the text."""
    return let(F.lower(col(text)), lambda low: F.filter(string_array(markers), lambda m: low.contains(m)))


def withhold_flagged(text: Column | str, markers: Sequence[str] = rules.DEMEANING_MARKERS) -> Column:
    return F.when(F.size(marker_flags(text, markers)) > 0, rules.WITHHELD_NOTE).otherwise(col(text))


def quoted_spans(text: Column | str, limit: int = 3) -> Column:
    found = F.regexp_extract_all(col(text), F.lit("[\"“](.+?)[\"”]"), F.lit(1))
    return F.slice(found, 1, limit)


def salvage_json(reply: Column | str) -> Column:
    """The JSON object inside a reply (fences and prose around it), else NULL."""
    body = F.regexp_extract(F.coalesce(col(reply), F.lit("")), r"(?s)(\{.*\})", 1)
    parsed = F.try_parse_json(F.when(body != "", body))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed))


def strip_fences(reply: Column | str) -> Column:
    """Remove a code fence around a reply."""
    text = strip(col(reply))
    inner = F.regexp_replace(F.regexp_replace(text, r"(?s)^```[^\n]*\n?", ""), r"(?s)```$", "")
    return strip(F.when(text.startswith("```"), inner).otherwise(text))
