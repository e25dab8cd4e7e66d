"""Text normalisation inside the JVM: no Python worker is involved in any of these columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as ``str.split()`` sees it, the four information separators included.
WS = r"[\s\x{1c}-\x{1f}]"


@lru_cache(maxsize=1)
def _base_letters() -> tuple[str, str]:
    """Every character that decomposes canonically to one ASCII letter or digit plus marks, and that letter."""
    src, dst = [], []
    for code in range(0x80, min(sys.maxunicode + 1, 0x10000)):
        ch = chr(code)
        nfd = unicodedata.normalize("NFD", ch)
        if len(nfd) > 1:
            base = "".join(c for c in nfd if unicodedata.category(c) != "Mn").lower()
            if len(base) == 1 and base.isascii() and base.isalnum():
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


def fold(col: Column) -> Column:
    """Lower case, accented letters reduced to their base letter, combining marks dropped; null stays null."""
    src, dst = _base_letters()
    return F.regexp_replace(F.translate(F.lower(col), src, dst), r"\p{Mn}+", "")


def strip(col: Column) -> Column:
    """Whitespace off both ends, in the Unicode sense (``trim`` removes spaces only)."""
    return F.regexp_replace(col, rf"(?U)^{WS}+|{WS}+$", "")


def words(col: Column) -> Column:
    """Array of the longest runs of a-z and 0-9 of the folded text; null gives null, no word an empty array."""
    return F.filter(F.split(fold(col), "[^a-z0-9]+"), lambda w: w != "")


def act_key(col: Column) -> Column:
    """Act name without case, accents, outer spaces and a leading ``ato_``."""
    return F.regexp_replace(fold(strip(col)), "^ato_", "")


def label_key(col: Column) -> Column:
    """Entity type: trimmed and lower-cased."""
    return F.lower(strip(col))


def split_key(col: Column) -> Column:
    """Split name, with ``valid`` and ``validation`` read as dev."""
    low = F.lower(strip(col))
    return F.when(low.isin("valid", "validation"), F.lit("dev")).otherwise(low)


def pub_key(col: Column) -> Column:
    """All digits of a publication id without leading zeros, as text of any length; null when it has none."""
    digits = F.regexp_replace(F.regexp_replace(col, "[^0-9]", ""), "^0+(?=.)", "")
    return F.when(digits != "", digits)


def pub_no(col: Column) -> Column:
    """All digits of a publication id as one integer; null when it has none or they exceed a bigint.

    For output only: publications are compared and joined by :func:`pub_key`, which knows no longest id.
    """
    return pub_key(col).try_cast("bigint")


def source_key(col: Column) -> Column:
    """Source name: trimmed, lower-cased, spaces and underscores written as hyphens."""
    return F.translate(F.lower(strip(col)), " _", "--")


def chars(col: Column) -> Column:
    """Length in Unicode code points; null counts as 0."""
    return F.coalesce(F.char_length(col), F.lit(0))


def hash_hex(*parts: Column | str) -> Column:
    """The first 13 hex digits (52 bits) of the parts' MD5; they compare as strings like the number they stand for."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.substring(F.md5(text), 1, 13)


def hash52(*parts: Column | str) -> Column:
    """52 uniform bits of the parts' MD5: the same integer in any engine that has MD5, whatever the partitioning."""
    return F.conv(hash_hex(*parts), 16, 10).cast("bigint")
