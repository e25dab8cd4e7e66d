"""Oversized texts cut at natural boundaries by recursive bisection.

A text over its limit is cut at the strongest boundary near its middle; halves that still exceed the limit less the
overlap are cut again. Every piece but the first then takes the stated number of characters before it as overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries by falling strength; a cut is made at the end of a match. Tagged tokens look like ``word(B-type)``.
BOUNDARIES = (
    (6, re.compile(r"\n[^\S\n]*\n\s*")),  # paragraph
    (5, re.compile(r"\n[^\S\n]*|\r\n?")),  # line
    (4, re.compile(r"(?<!\bart)(?<!\bfl)(?<!\bpág)[.!?…]+[\"'”’)]*(?:\((?:O|[BI]-\w+)\))?\s+(?=[^\W\d_a-zà-ÿ]|[\"“(•])")),  # sentence
    (3, re.compile(r"[;:](?:\((?:O|[BI]-\w+)\))?\s+|\s(?=[-–•*]\s)")),  # list entry
    (2, re.compile(r"\((?:O|[BI]-\w+)\)\s+(?!\S*\(I-\w+\))")),  # tagged token that no entity runs across
    (1, re.compile(r"\s+")),  # word
)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``text`` may be cut, ascending, and the strength of each."""
    found = [np.fromiter((m.end() for m in pattern.finditer(text)), np.int64) for _, pattern in BOUNDARIES]
    places = np.concatenate(found)
    strengths = np.repeat([strength for strength, _ in BOUNDARIES], [len(f) for f in found])
    order = np.lexsort((-strengths, places))
    places, strengths = places[order], strengths[order]
    first = np.r_[True, places[1:] != places[:-1]] if len(places) else np.zeros(0, bool)  # the strongest of each place
    return places[first], strengths[first]


def cores(text: str, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of at most ``most`` characters that together are the text."""
    places, strengths = boundaries(text)
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            out.append((a, b))
            continue
        mid, quarter = (a + b) // 2, (b - a) // 4
        lo, hi = np.searchsorted(places, a + max(quarter, 1), "left"), np.searchsorted(places, b - max(quarter, 1), "right")
        if lo == hi:  # nothing near the middle: any boundary inside
            lo, hi = np.searchsorted(places, a, "right"), np.searchsorted(places, b, "left")
        if lo < hi:
            near = np.abs(places[lo:hi] - mid)
            cut = int(places[lo + np.lexsort((near, -strengths[lo:hi]))[0]])
        else:
            cut = mid
            while cut < b - 1 and unicodedata.combining(text[cut]):
                cut += 1
        todo += [(cut, b), (a, cut)]
    return out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of the pieces of a text, overlaps attached; one range if it is within the limit."""
    if len(text) <= limit:
        return [(0, len(text))]
    return [(max(0, a - overlap), b) for a, b in cores(text, limit - overlap)]


def split_oversized(df: DataFrame, id_cols: list[str], text_col: str, limit: int | str, overlap: int | str) -> DataFrame:
    """(id..., piece_no, start, stop, piece): the pieces of every text longer than ``limit`` characters.

    ``piece`` is characters [start, stop) of the text; consecutive pieces share exactly ``overlap`` characters (fewer
    only where the text before is shorter). Characters are code points. Both may name a column instead, so that texts of
    several kinds are cut in one pass; a row with a null limit or overlap gives no pieces. Texts within the limit, null
    and empty ones give no rows; rows repeated under one id are all cut; other columns are ignored. 0 <= overlap < limit.
    """
    if isinstance(limit, int) and isinstance(overlap, int) and not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    most, over = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (limit, overlap))
    long = df.select(*[F.col(c).alias(f"id{i}") for i, c in enumerate(id_cols)], F.col(text_col).alias("text"),
                     most.cast("int").alias("limit"), over.cast("int").alias("overlap")).where(
        (F.char_length("text") > F.col("limit")) & F.col("overlap").isNotNull())
    names = [f"id{i}" for i in range(len(id_cols))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if ((frame["overlap"] < 0) | (frame["overlap"] >= frame["limit"])).any():
                raise ValueError("the overlap must be less than the limit")
            cut = [pieces(t, m, o) for t, m, o in zip(frame["text"], frame["limit"].tolist(), frame["overlap"].tolist())]
            n = [len(c) for c in cut]
            out = frame[names].loc[frame.index.repeat(n)].reset_index(drop=True)
            out["piece_no"] = [i for c in cut for i in range(len(c))]
            out["start"] = [a for c in cut for a, _ in c]
            out["stop"] = [b for c in cut for _, b in c]
            out["piece"] = [t[a:b] for t, c in zip(frame["text"], cut) for a, b in c]
            yield out

    ids = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, id_cols))
    made = long.mapInPandas(run, f"{ids}, piece_no int, start int, stop int, piece string")
    for name, c in zip(names, id_cols):
        made = made.withColumnRenamed(name, c)
    return made
