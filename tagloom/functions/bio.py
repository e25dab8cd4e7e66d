"""BIO tag sequences as array columns: decoding, parsing, alignment and rendering without a shuffle or a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import WS

#: One rendered unit, ``token(B-type)`` or ``token(O)``; the type is made of word characters in the Unicode sense.
UNIT = r"(?U)^(.+)\(([BI]-\w+|O)\)$"


def etype(tag: Column) -> Column:
    """The type behind the two-character prefix."""
    return F.substring(tag, 3, 1 << 30)


def _tagged(tag: Column) -> Column:
    return tag.startswith("B-") | tag.startswith("I-")


def _continues(tags: Column, i: Column) -> Column:
    """Whether position ``i`` is an ``I-`` of the type that stands right before it."""
    now, before = F.get(tags, i), F.get(tags, i - 1)
    return F.coalesce(now.startswith("I-") & _tagged(before) & (etype(now) == etype(before)), F.lit(False))


RUN = "array<struct<etype:string,s:int,e:int,opened:string>>"


def runs(tags: Column) -> Column:
    """Runs (etype, s, e, opened) of a tag array, e exclusive, in order; ``opened`` is B or I.

    A run starts at every tag that is not an ``I-`` continuing the type before it. Only tags other than ``O`` are
    looked at twice. Null and empty arrays have no runs. ``tags`` should be a plain column.
    """
    typed = F.filter(F.transform(tags, lambda t, i: F.when(t != "O", F.when(_tagged(t), i))), lambda i: i.isNotNull())
    starts = F.filter(typed, lambda i: ~_continues(tags, i))
    ends = F.filter(typed, lambda i: ~_continues(tags, i + 1))
    made = F.zip_with(starts, ends, lambda a, b: F.struct(
        etype(F.get(tags, a)).alias("etype"), a.alias("s"), (b + 1).alias("e"), F.substring(F.get(tags, a), 1, 1).alias("opened")))
    return F.coalesce(made, F.array().cast(RUN))


def of_runs(found: Column, strict: bool = True) -> Column:
    """Spans (etype, s, e) of runs: strict takes those opened by ``B-``, lenient all."""
    kept = F.filter(found, lambda r: r["opened"] == "B") if strict else found
    return F.transform(kept, lambda r: F.struct(r["etype"].alias("etype"), r["s"].alias("s"), r["e"].alias("e")))


def spans(tags: Column, strict: bool = True) -> Column:
    """Spans (etype, s, e) of a tag array.

    Strict: an ``I-`` without an open span of its type opens nothing. Lenient: it opens a span.
    """
    return of_runs(runs(tags), strict)


def parse_inline(text: Column) -> Column:
    """Labels of rendered text, one by well-formed unit; malformed units are dropped; null gives an empty array."""
    units = F.split(F.coalesce(text, F.lit("")), rf"(?U){WS}+")
    return F.filter(F.transform(units, lambda u: F.regexp_extract(u, UNIT, 2)), lambda x: x != "")


def parse_inline_tokens(text: Column) -> Column:
    """Tokens of rendered text, parallel to :func:`parse_inline`."""
    units = F.split(F.coalesce(text, F.lit("")), rf"(?U){WS}+")
    return F.transform(F.filter(units, lambda u: F.regexp_extract(u, UNIT, 2) != ""), lambda u: F.regexp_extract(u, UNIT, 1))


def align(labels: Column, length: Column) -> Column:
    """Labels cut to ``length`` or filled up with ``O``, by position."""
    return F.slice(F.concat(labels, F.array_repeat(F.lit("O"), length)), F.lit(1), length)


def slice_to(labels: Column, entity_type: Column) -> Column:
    """Labels of one type; all others become ``O``."""
    b, i = F.concat(F.lit("B-"), entity_type), F.concat(F.lit("I-"), entity_type)
    return F.transform(labels, lambda x: F.when((x == b) | (x == i), x).otherwise("O"))


def render(tokens: Column, labels: Column) -> Column:
    """``token(label)`` units joined by spaces; the shorter array decides the length."""
    both = F.filter(F.arrays_zip(tokens.alias("k"), labels.alias("g")), lambda z: z["k"].isNotNull() & z["g"].isNotNull())
    return F.array_join(F.transform(both, lambda z: F.concat(z["k"], F.lit("("), z["g"], F.lit(")"))), " ")


def entity_types(tags: Column) -> Column:
    """Distinct types behind the first hyphen of all tags but ``O``."""
    typed = F.filter(tags, lambda t: (t != "O") & t.contains("-"))
    return F.array_distinct(F.transform(typed, lambda t: F.regexp_extract(t, "(?s)-(.*)$", 1)))


def is_negative(tags: Column, entity_type: Column) -> Column:
    """Whether no tag of the type occurs."""
    return ~F.exists(tags, lambda t: (t == F.concat(F.lit("B-"), entity_type)) | (t == F.concat(F.lit("I-"), entity_type)))


def encode(labels: Column, vocabulary: Column) -> Column:
    """Positions of labels in a vocabulary array, from 0; -100 for labels outside it."""
    return F.transform(labels, lambda x: F.coalesce(F.nullif(F.array_position(vocabulary, x), F.lit(0)) - 1, F.lit(-100)))


def argmax(scores: Column) -> Column:
    """Position of the largest score, from 0; the first of equals."""
    return F.array_position(scores, F.array_max(scores)) - 1
