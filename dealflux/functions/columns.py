"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as double, null when b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def percent(a: ColumnLike, b: ColumnLike) -> Column:
    return ratio(a, b) * F.lit(100.0)


def change(now: ColumnLike, before: ColumnLike) -> Column:
    """Relative change in percent, null without a non-zero base."""
    return percent(col(now) - col(before), before)


def total(c: ColumnLike) -> Column:
    """Sum that is zero, not null, over all-null input."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def exact_mean(c: ColumnLike) -> Column:
    """Mean from a decimal sum: the same to the last bit in whatever order rows arrive; values are taken to 6 decimals."""
    return F.sum(col(c).cast("decimal(28,6)")).cast("double") / F.nullif(F.count(c), F.lit(0))


def seconds_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Elapsed seconds with microsecond precision."""
    micros = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return micros / F.lit(1e6)


def years_between(start: ColumnLike, end: ColumnLike) -> Column:
    return F.datediff(col(end), col(start)) / F.lit(365.25)


def bins(
    value: ColumnLike,
    edges: Sequence[float],
    labels: Sequence[str],
    *,
    include_lowest: bool = False,
) -> Column:
    """Right-closed bins; values outside the edges (and the lowest edge) are null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    v = col(value)
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        above = v >= F.lit(low) if include_lowest and low == edges[0] else v > F.lit(low)
        if low == float("-inf"):
            above = v.isNotNull()
        inside = above if high == float("inf") else above & (v <= F.lit(high))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def lookup(value: ColumnLike, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Dictionary lookup; keys that are not mapped give ``default`` (null)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col(value))
    return found if default is None else F.coalesce(found, F.lit(default))


def ordinal(value: ColumnLike, ordered: Sequence[str]) -> Column:
    """1-based place of a value in a fixed order, null when it is not listed."""
    place = F.array_position(F.array(*[F.lit(x) for x in ordered]), col(value))
    return F.when(place > 0, place.cast("int"))


def quarter_label(date: ColumnLike) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def month_label(date: ColumnLike) -> Column:
    return F.date_format(date, "yyyy-MM")


def not_in(c: ColumnLike, values: Sequence, *, keep_null: bool = False) -> Column:
    keep = ~col(c).isin(*values)
    return keep | col(c).isNull() if keep_null else keep


def compact_number(v: ColumnLike) -> Column:
    """12345 -> 12k, 2500000 -> 2.5M."""
    v = col(v).cast("double")
    return (
        F.when(v >= 1e9, F.format_string("%.1fB", v / 1e9))
        .when(v >= 1e6, F.format_string("%.1fM", v / 1e6))
        .when(v >= 1e3, F.format_string("%.0fk", v / 1e3))
        .otherwise(F.format_string("%.0f", v))
    )


def money_text(v: ColumnLike) -> Column:
    """Amount in dollars as $1.2B or $3.4M."""
    v = col(v).cast("double")
    return F.when(v >= 1e9, F.format_string("$%.1fB", v / 1e9)).otherwise(
        F.format_string("$%.1fM", v / 1e6)
    )
