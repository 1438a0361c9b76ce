"""Matching, lower case and word tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[0-9A-Za-z_\x{80}-\x{9F}\x{A1}-\x{B6}\x{B8}-\x{1FFF}\x{2040}-\x{10FFFF}]+"
#: Word characters with single full stops inside.
ONE = rf"{WORD}(?:\.{WORD})*"
#: A tilde right after a token joins the next one to it, once.
TOKEN = rf"{ONE}(?:~{ONE})?"


def to_lowercase(s: Column) -> Column:
    return F.lower(s)


def tokenize(s: Column) -> Column:
    """Words in order, case kept. Empty text has none."""
    return F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))


def matches_regex(s: Column, pattern: str) -> Column:
    """True where the pattern is found anywhere."""
    return s.rlike(pattern)


def like_pattern(glob: str) -> str:
    """The LIKE pattern of a glob whose ``*`` is any run and ``?`` any one character."""
    return "".join({"*": "%", "?": "_", "%": "\\%", "_": "\\_", "\\": "\\\\"}.get(c, c) for c in glob)


def matches_wildcard(s: Column, glob: str, case_insensitive: bool = False) -> Column:
    """True where the whole string fits the glob; an empty glob fits nothing."""
    if not glob:
        return F.lit(False)
    return s.ilike(like_pattern(glob)) if case_insensitive else s.like(like_pattern(glob))


def starts_with(s: Column, prefix: str, case_insensitive: bool = False) -> Column:
    return F.lower(s).startswith(prefix.lower()) if case_insensitive else s.startswith(prefix)


def has_phrase(s: Column, phrase: str, case_insensitive: bool = False) -> Column:
    """True where the phrase stands anywhere; an empty one stands nowhere."""
    if not phrase:
        return F.lit(False)
    return F.lower(s).contains(phrase.lower()) if case_insensitive else s.contains(phrase)


def field_has_phrase(fields: Column, name: str | None, phrase: str, case_insensitive: bool = False) -> Column:
    """True where a field of that name, or any field, has the phrase; ``fields`` is an array of (name, value)."""
    fits = lambda f: has_phrase(f["value"], phrase, case_insensitive)
    return F.coalesce(F.exists(fields, lambda f: fits(f) if name is None else (f["name"] == name) & fits(f)), F.lit(False))


def field_starts_with(fields: Column, name: str, prefix: str, case_insensitive: bool = False) -> Column:
    """True where a field of that name starts with the prefix; nothing does for an empty name or prefix."""
    if not name or not prefix:
        return F.lit(False)
    return F.coalesce(F.exists(fields, lambda f: (f["name"] == name) & starts_with(f["value"], prefix, case_insensitive)), F.lit(False))


def fields_text(fields: Column) -> Column:
    """All values, joined by a space."""
    return F.array_join(F.transform(fields, lambda f: f["value"]), " ")
