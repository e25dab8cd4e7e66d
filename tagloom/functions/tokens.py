"""Classical attributes of single tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits in the sense of ``str.isdigit``: decimal digits and the superscript and circled ones.
DIGIT = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"


def shape(w: Column) -> Column:
    """Capitals as X, then small letters as x, then digits as d; the letter ranges are those of Latin-1."""
    # The letter ranges of the published features.
    w = F.regexp_replace(w, "[A-ZÀ-Ý]", "X")
    w = F.regexp_replace(w, "[a-zà-ÿ]", "x")
    return F.regexp_replace(w, "[0-9]", "d")


def is_upper(w: Column) -> Column:
    return w.rlike(r"\p{IsUppercase}") & ~w.rlike(r"[\p{IsLowercase}\p{Lt}]")


def is_title(w: Column) -> Column:
    """Capitals only after uncased characters, small letters only after cased ones, and one capital at least."""
    cased = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"
    return w.rlike(r"[\p{IsUppercase}\p{Lt}]") & ~w.rlike(rf"(?<={cased})[\p{{IsUppercase}}\p{{Lt}}]|(?<!{cased})\p{{IsLowercase}}")


def is_digit(w: Column) -> Column:
    return w.rlike(rf"^[{DIGIT}]+$")


def has_digit(w: Column) -> Column:
    return w.rlike(rf"[{DIGIT}]")


def has_punct(w: Column) -> Column:
    return w.rlike(r"[^\p{L}\p{N}]")


def affixes(w: Column) -> dict[str, Column]:
    return {"suffix3": F.right(w, F.lit(3)), "suffix2": F.right(w, F.lit(2)), "prefix2": F.left(w, F.lit(2)), "prefix3": F.left(w, F.lit(3))}
