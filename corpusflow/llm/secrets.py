"""Secrets in texts, found by one automaton for all rules.

The rules' regular expressions are reversed and compiled together into one minimal automaton. A
single pass over a text's bytes, from its end, marks for each rule every place where a match begins. From
such places, and from no others, the rule's own automaton walks forward to the longest match; the leftmost
matches that don't overlap count. A rule may name a stricter expression that a match has to meet as well,
or it is dropped after it has taken its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.automaton import backwards, compile_rules, parse
from corpusflow.llm.common import id_and_text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    strict: str = ""
    ignore_case: bool = False
    #: An expression that begins every match and is one by itself, if it makes a smaller automaton to look for.
    head: str = ""


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
#: The three kinds every scan has. Runs of hexadecimal digits and of key characters are maximal, so
#: demanding their length at once finds the same matches as dropping the short ones.
BASE = (
    Rule("assign", _ASSIGN + "+", _ASSIGN + "{6,}", ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: A private key from its header to its END line, with nothing in between that a key file doesn't hold (quotes, backslashes and
#: > # * are of keys in program texts and comments). Without an END line it goes to the last line of base64: header fields,
#: runs of at least 16 characters, then one shorter run; without those it is the header alone.
_KEY_HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_KEY_WHOLE = r"""(-?-?-?-?[A-Za-z0-9+/=\x09\x0A\x0D\x20:,_\\"'>#*])*-----END [A-Z ]*PRIVATE KEY-----"""
_BREAK = r"""[\x09\x0A\x0D\x20\\"'>#*]"""
_KEY_OPEN = rf"""({_BREAK}+(r?\\?n)?[A-Z][A-Za-z-]+:\x20?[A-Za-z0-9,-]+)*({_BREAK}*(\\?[rn])*[A-Za-z0-9+/=]{{16,}})+({_BREAK}+[A-Za-z0-9+/=]+)?"""
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("private_key", f"{_KEY_HEAD}({_KEY_WHOLE}|{_KEY_OPEN})?", head=_KEY_HEAD),
)


class Scanner:
    """The compiled rules; ``spans`` scans one text."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        parsed = [parse(r.pattern, r.ignore_case) for r in rules]
        self.kinds = [r.kind for r in rules]
        heads = [parse(r.head, r.ignore_case) if r.head else p for r, p in zip(rules, parsed, strict=True)]
        self.begins = compile_rules([backwards(p) for p in heads], anywhere=True)
        self.longest = [compile_rules([p], anywhere=False) for p in parsed]
        self.strict = [compile_rules([parse(r.strict, r.ignore_case)], anywhere=False) if r.strict else None for r in rules]

    def ready(self) -> Scanner:
        """Make the automata into the nested lists that a pass in Python is fastest with."""
        self.rows = self.begins.rows()
        self.forward = [a.rows() for a in self.longest]
        self.meets = [a.rows() if a else None for a in self.strict]
        return self

    @staticmethod
    def _end(rows: list[list], data: bytes, start: int) -> int:
        """Where the longest match from ``start`` ends; -1 if there is none. State 0's dead end is a state that leads to itself."""
        row, end = rows[0], -1
        for at in range(start, len(data)):
            row = row[data[at]]
            if row[256]:
                end = at + 1
            elif row[0] is row and row[255] is row and all(r is row for r in row[:256]):
                break
        return end

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then in the order of the rules."""
        data = text.encode()
        found: list[list[int]] = [[] for _ in self.kinds]
        row, last = self.rows[0], len(data) - 1
        for i, byte in enumerate(reversed(data)):
            row = row[byte]
            if row[256]:
                for rule in range(len(found)):
                    if row[256] >> rule & 1:
                        found[rule].append(last - i)
        kept = []
        for rule, starts in enumerate(found):
            free = 0
            for start in reversed(starts):
                if start >= free:
                    free = self._end(self.forward[rule], data, start)
                    if self.meets[rule] is None or self._end(self.meets[rule], data, start) == free:
                        kept.append((start, rule, free))
        kept.sort()
        if len(data) == len(text):
            return [(self.kinds[rule], start, end) for start, rule, end in kept]
        out, at, points = [], 0, 0
        for start, rule, end in kept:
            points += len(data[at:start].decode())
            at = start
            out.append((self.kinds[rule], points, points + len(data[start:end].decode())))
        return out


SPANS = "array<struct<kind: string, start: long, end: long>>"


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Kind, start and end (exclusive) in code points of a text's secrets, by start, then kind. A null or empty text has none."""
    scanner = Scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(SPANS)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = scanner.ready()
        for batch in texts:
            yield pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in ready.spans(t or "")] for t in batch.to_pylist()], kind)

    return scan(text)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans``. Repeated rows give repeated rows, a null doc_id stays null."""
    return id_and_text(docs).select("doc_id", secret_spans(F.col("text"), rules).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[kind]``; overlapping spans go together under the name of the
    first. A text without secrets, or null, stays as it is."""
    # (text so far, where it ends in the original), folded over the spans
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    between = lambda a, s: F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(a["out"], between(a, s), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
    )
    end = lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int")))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(F.aggregate(spans, start, step, end))
