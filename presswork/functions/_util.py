from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def lit_str(s: str) -> Column:
    """A string literal (used for regex patterns, never parsed as SQL)."""
    return F.lit(s)


def let(fn, **values: Column) -> Column:
    """Evaluate each value once and hand them to ``fn`` as lambda variables.

    Catalyst does not share sub-expressions between the branches of a
    ``CASE``; binding them through a one-element ``transform`` evaluates each
    exactly once per row.
    """
    packed = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(packed, lambda p: fn(**{k: p[k] for k in values})), 1)
