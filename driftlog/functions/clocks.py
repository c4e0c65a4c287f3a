"""Vector clocks as MAP<STRING, BIGINT>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(a: Column, b: Column, test) -> Column:
    return F.exists(F.map_values(F.map_zip_with(a, b, lambda _, x, y: test(x, y))), lambda v: v)


def compare(a: Column, b: Column) -> Column:
    """Identical, Before, After or Concurrent; a missing entry is 0."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    more, less = _any(a, b, lambda x, y: zero(x) > zero(y)), _any(a, b, lambda x, y: zero(x) < zero(y))
    return F.when(more & less, "Concurrent").when(more, "After").when(less, "Before").otherwise("Identical")


def compare3(a: Column, b: Column) -> Column:
    """1 after, -1 before, else 0."""
    c = compare(a, b)
    return F.when(c == "After", 1).when(c == "Before", -1).otherwise(0)


def compare_node(a: Column, b: Column) -> Column:
    """As compare3, but an entry of `a` that `b` lacks counts as greater even at 0."""
    more = _any(a, b, lambda x, y: x.isNotNull() & (x > F.coalesce(y, F.lit(-1))))
    less = _any(a, b, lambda x, y: F.coalesce(x, F.lit(0)) < F.coalesce(y, F.lit(0)))
    return F.when(more & ~less, 1).when(less & ~more, -1).otherwise(0)


def merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def increment(a: Column, node: Column) -> Column:
    return F.map_zip_with(a, F.create_map(node, F.lit(1).cast("bigint")), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def highest(a: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(a)), F.lit(0)).cast("bigint")


def shown(a: Column) -> Column:
    """Canonical text, by node."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(a)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def equals(a: Column, b: Column) -> Column:
    return shown(a) == shown(b)
