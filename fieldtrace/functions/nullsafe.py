"""Missing-value rules of the source data as column expressions.

A missing value is unknown in a condition, equal to another missing value in a key, last in a
sort, and spoils a mean or a sum unless it is removed first.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a plain decimal number in a text cell.
NUMBER_PATTERN = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice in which an unknown condition gives null and not ``no``."""
    return F.when(cond, yes).when(~cond, no)


def is_in(c: str | Column, values) -> Column:
    """Membership that is never null; a null matches only a listed ``None``."""
    values = list(values)
    plain = [v for v in values if v is not None]
    hit = F.coalesce(col(c).isin(plain), F.lit(False)) if plain else F.lit(False)
    return hit | col(c).isNull() if len(plain) < len(values) else hit


def any_null(*cols) -> Column:
    return reduce(or_, [col(c).isNull() for c in cols])


def all_present(*cols) -> Column:
    return reduce(and_, [col(c).isNotNull() for c in cols])


def number_text(c: str | Column) -> Column:
    """Number as text without a trailing ``.0``."""
    c = col(c)
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def glue(*cols, sep: str = "") -> Column:
    """Concatenate texts with a separator; null as soon as one part is null."""
    parts = []
    for i, c in enumerate(cols):
        if i and sep:
            parts.append(F.lit(sep))
        parts.append(col(c))
    return F.concat(*parts)


def to_number(c: str | Column) -> Column:
    """Tolerant text-to-double parse: anything else than a plain number is null."""
    c = col(c).cast("string")
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def strict_mean(c: str | Column) -> Column:
    """Mean that is null when one value of the group is null."""
    c = col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def strict_sum(c: str | Column) -> Column:
    """Sum that is null when one value of the group is null."""
    c = col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def default(c: str | Column, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def null_text(c: str | Column) -> Column:
    """Text in which a missing value shows as ``NA``."""
    return F.coalesce(col(c).cast("string"), F.lit("NA"))


def sort_keys(*cols) -> list[Column]:
    """Ascending sort keys with missing values last."""
    return [col(c).asc_nulls_last() for c in cols]


def order_struct(*cols) -> Column:
    """One comparable value for ``min_by`` with the same order as ``sort_keys``."""
    fields = []
    for i, c in enumerate(cols):
        fields += [col(c).isNull().alias(f"n{i}"), col(c).alias(f"v{i}")]
    return F.struct(*fields)
