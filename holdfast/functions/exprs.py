"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fround(c: str | Column, digits: int) -> Column:
    """Round half up as ``floor(x * 10^d + 0.5) / 10^d``.

    Every step is one IEEE operation, so any engine evaluating the same
    formula returns the same double; ``round()`` does not have that property
    (Spark rounds the decimal string, other engines the binary value).
    """
    scale = 10 ** digits
    return (F.floor(col(c).cast("double") * scale + 0.5) / scale).cast("double")


def as_int(c: str | Column) -> Column:
    return col(c).cast("int")


def flag(cond: Column) -> Column:
    """1 when the predicate holds, else 0 (NULL predicates count as 0)."""
    return F.when(cond, 1).otherwise(0)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when the denominator is 0 or NULL (ANSI-safe)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def right_inclusive_bucket(c: str | Column, edges: Sequence[float],
                           labels: Sequence[str]) -> Column:
    """``x <= e1 -> l1, x <= e2 -> l2, ... else last`` (edges are right-inclusive)."""
    assert len(labels) == len(edges) + 1
    x = col(c)
    expr = F.when(x <= edges[0], labels[0])
    for e, lab in zip(edges[1:], labels[1:-1]):
        expr = expr.when(x <= e, lab)
    return expr.otherwise(labels[-1])


def lookup(c: str | Column, mapping: Iterable[tuple[str, object]]) -> Column:
    """Literal map lookup; unknown keys give NULL (a CASE with no ELSE)."""
    x = col(c)
    expr = None
    for k, v in mapping:
        expr = F.when(x == k, F.lit(v)) if expr is None else expr.when(x == k, F.lit(v))
    return expr


def sql_round(expr: str, digits: int) -> str:
    """The SQL text of :func:`fround`, for oracle queries."""
    scale = 10 ** digits
    return f"(FLOOR(CAST(({expr}) AS DOUBLE) * {scale} + 0.5) / {scale})"
