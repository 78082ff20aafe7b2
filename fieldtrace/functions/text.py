"""Text cleaning: accents, numbers in free text, sexagesimal coordinates, code normalisation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import any_null, col, glue, if_else, is_in, number_text, to_number

# Letters that become two.
_LIGATURES = (("Œ", "OE"), ("œ", "oe"), ("Æ", "AE"), ("æ", "ae"), ("ß", "ss"))
# Letters without a decomposition.
_PLAIN = {"Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d"}


def _accent_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = dict(_PLAIN)
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _BASE = _accent_pairs()


def strip_accents(c: str | Column) -> Column:
    c = col(c)
    for one, two in _LIGATURES:
        c = F.replace(c, F.lit(one), F.lit(two))
    return F.translate(c, _ACCENTED, _BASE)


def plain_upper(c: str | Column) -> Column:
    return F.upper(strip_accents(c))


def contains(c: str | Column, pattern: str) -> Column:
    return col(c).rlike(pattern)


def starts_with(c: str | Column, pattern: str) -> Column:
    """Pattern anchored at the start as a whole, alternatives included."""
    return col(c).rlike(f"^(?:{pattern})")


def replace_first(c: str | Column, char_class: str, to: str) -> Column:
    """Replace the first character of the class ``char_class``."""
    return F.regexp_replace(col(c), f"^([^{char_class}]*)[{char_class}]", f"$1{to}")


def coordinate_part(c: str | Column) -> Column:
    """Unsigned number of one sexagesimal cell; a comma, colon or semicolon is a decimal point."""
    return F.abs(to_number(replace_first(c, ",:;", ".")))


def hemisphere(deg: str | Column) -> Column:
    """-1 when the degrees text carries a minus sign, so that ``-0`` keeps its side."""
    return if_else(F.contains(col(deg), F.lit("-")), F.lit(-1.0), F.lit(1.0))


def dms_to_decimal(deg, minute, second, missing_second_is_zero: bool = False) -> Column:
    """Degrees, minutes and seconds as text to signed decimal degrees."""
    s = coordinate_part(second)
    if missing_second_is_zero:
        s = F.coalesce(s, F.lit(0.0))
    return hemisphere(deg) * (coordinate_part(deg) + coordinate_part(minute) / 60 + s / 3600)


def raw_coordinate(deg, minute, second) -> Column:
    """Audit text ``side:deg:min:sec`` of the parsed cells."""
    parts = [hemisphere(deg), coordinate_part(deg), coordinate_part(minute), coordinate_part(second)]
    return glue(*[number_text(p) for p in parts], sep=":")


def valid_dms(deg, minute, second) -> Column:
    """Degrees within 90, minutes and seconds below 60, nothing missing (both axes use 90)."""
    d, m, s = (coordinate_part(c) for c in (deg, minute, second))
    bad = any_null(d, m, s) | (d > 90) | (m < 0) | (m >= 60) | (s < 0) | (s >= 60)
    return ~F.coalesce(bad, F.lit(True))


def in_box(lon, lat, lon_range=(-90.0, 90.0), lat_range=(-90.0, 90.0)) -> Column:
    return col(lon).between(*lon_range) & col(lat).between(*lat_range)


# The codes of the field tables, first match first.
def sex_code(c: str | Column) -> Column:
    return F.when(is_in(c, ["F", "Femelle"]), "fem").when(col(c) == "M", "mal").otherwise("ind")


def age_code(c: str | Column) -> Column:
    return (
        F.when(contains(c, r"\?"), "ind")
        .when(contains(c, r"\+1"), "+1A")
        .when(contains(c, r"\+"), "+2A")
        .when(starts_with(c, "1|VOL"), "1A")
        .when(starts_with(c, "2"), "2A")
        .when(col(c) == "PUL", "pul")
        .otherwise("ind")
    )


def observation_code(c: str | Column) -> Column:
    return if_else(col(c) == "BAGUAGE", col(c), F.lit("CONTROLE"))
