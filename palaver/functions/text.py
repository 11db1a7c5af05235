"""Text measures as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose full stops end no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "cf.", "Mr.", "Mrs.", "Ms.", "Dr.", "St.", "approx.")
_HELD = ""

_QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}


def squeezed(x: Column) -> Column:
    """Trimmed with single spaces."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def plain_quotes(x: Column) -> Column:
    """Typographic quotes, dashes and dots as plain ones, single spaces."""
    for a, b in _QUOTES.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return squeezed(x)


def word_count(x: Column) -> Column:
    """Words with inner apostrophes and hyphens as one (F09, the counter of the greedy matcher)."""
    return F.coalesce(F.regexp_count(x, F.lit(r"(?U)\b\w+(?:['’\-]\w+)*\b")), F.lit(0))


def space_words(x: Column) -> Column:
    """Words between white space, at least 1 (F10, the counter of the alternation matcher)."""
    return F.greatest(F.size(F.split(F.trim(F.coalesce(x, F.lit(""))), r"\s+")), F.lit(1))


def rate_per_100(count: Column, words: Column) -> Column:
    """Occurrences per hundred words; null without words."""
    return F.try_divide(count * 100.0, words)


def word_hits(x: Column, word: str) -> Column:
    """Whole-word occurrences of ``word`` without regard to case (F16)."""
    return F.coalesce(F.regexp_count(x, F.lit(rf"(?i)\b{re.escape(word)}\b")), F.lit(0))


def phrase_pattern(phrase: str) -> str:
    """A pattern of the phrase as whole words with any white space between them."""
    return r"(?iU)(?<!\w)" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"(?!\w)"


def alternation(phrases: list[str]) -> str:
    """One pattern that matches the longest phrase at each place from left to right."""
    return r"(?i)\b(" + "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in sorted(phrases, key=lambda p: (-len(p), p))) + r")\b"


def mentions(x: Column, name: Column) -> Column:
    """Whether a name occurs as whole words, without regard to case (F14); false for nulls."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.coalesce(flat.contains(F.concat(F.lit(" "), F.lower(F.trim(name)), F.lit(" "))), F.lit(False))


def role_mentions(x: Column, roles: list[str]) -> Column:
    """The distinct roles that a text mentions, capitalised and sorted."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(rf"(?i)\b({'|'.join(map(re.escape, roles))})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.initcap(w))))


def has_span(text: Column, span: Column) -> Column:
    """Whether a span is in a text word for word, or at least with white space squeezed."""
    return F.coalesce(F.position(span, text) > 0, F.lit(False)) | F.coalesce(F.position(squeezed(span), squeezed(text)) > 0, F.lit(False))


def sentences(x: Column) -> Column:
    """Sentences by terminal punctuation (F11): an empty array for null or blank texts.

    Abbreviations do not end a sentence; pieces without a word rejoin the sentence before them, as
    do closing quotes and brackets. All in column functions: a mask, one split, one fold.
    """
    masked = F.trim(F.coalesce(x, F.lit("")))
    for a in ABBREVIATIONS:
        masked = F.regexp_replace(masked, rf"(?i)\b({re.escape(a[:-1]).replace(chr(92) + '.', ')[.](')})[.]", "".join(f"${i + 1}{_HELD}" for i in range(a.count("."))))
    pieces = F.transform(F.regexp_extract_all(masked, F.lit(r"[^.!?]+(?:[.!?]+|$)"), F.lit(0)), lambda p: F.trim(F.regexp_replace(F.replace(p, F.lit(_HELD), F.lit(".")), r"^\s+|\s+$", "")))
    closer = r"^[\"'”’\)\]]+"

    def step(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        last, before = F.element_at(acc, -1), F.slice(acc, 1, F.greatest(n - 1, F.lit(0)))
        lead = F.regexp_extract(p, closer, 0)
        rest = F.trim(F.regexp_replace(p, closer, ""))
        return (
            F.when(~p.rlike(r"(?U)\w"), F.when(n > 0, F.concat(before, F.array(F.concat(last, p)))).otherwise(acc))
            .when((n > 0) & (lead != ""), F.concat(before, F.array(F.concat(last, lead), rest)))
            .otherwise(F.concat(acc, F.array(p)))
        )

    return F.aggregate(pieces, F.array().cast("array<string>"), step)


def sentence_records(x: Column) -> Column:
    """Numbered sentences: array of (sentence_id, text), counted from 1."""
    return F.transform(sentences(x), lambda s, i: F.struct((i + 1).cast("int").alias("sentence_id"), s.alias("text")))


def renamed_ids(x: Column, names: dict[str, str]) -> Column:
    """Whole-word ids replaced by names, longest id first, without regard to case."""
    for k in sorted(names, key=lambda k: (-len(k), k)):
        x = F.regexp_replace(x, rf"(?i)\b{re.escape(k)}\b", names[k].replace("\\", "\\\\").replace("$", "\\$"))
    return x


def first_kind(x: Column, kinds: list[tuple[str, str]], other: str) -> Column:
    """The kind of the first pattern that a text matches."""
    out = None
    for pattern, kind in kinds:
        out = F.when(x.rlike(pattern), kind) if out is None else out.when(x.rlike(pattern), kind)
    return out.otherwise(other)


def span_at(text: Column, span: Column) -> Column:
    """0-based (start, end) of a span's first place in a text, null if it is not there."""
    at = F.position(span, text)
    return F.when((at > 0) & (F.length(span) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(span)).alias("end")))


def placed_spans(text: Column, spans: Column) -> Column:
    """Spans in the order of their place, each that does not overlap one before it."""
    found = F.array_sort(F.filter(F.transform(spans, lambda s: F.struct(F.position(s, text).alias("at"), s.alias("span"))), lambda s: (s["at"] > 0) & (F.length(s["span"]) > 0)))
    kind = "array<struct<at:int,span:string>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) == 0) | (s["at"] >= last["at"] + F.length(last["span"])), F.concat(acc, F.array(s))).otherwise(acc)

    return F.aggregate(found, F.array().cast(kind), step)
