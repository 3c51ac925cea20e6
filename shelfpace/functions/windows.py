"""Window specifications for item series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Window, WindowSpec


def series_window(
    keys: str | Sequence[str],
    order: str | Sequence[str] | None = None,
    rows: tuple[int, int] | None = None,
    values: tuple[int, int] | None = None,
) -> WindowSpec:
    """Window over one series; ``rows`` gives a ROWS frame, ``values`` a RANGE frame, both inclusive."""
    if rows is not None and values is not None:
        raise ValueError("a window has one frame: give rows or values")
    spec = Window.partitionBy(keys)
    if order is not None:
        spec = spec.orderBy(order)
    if rows is not None:
        spec = spec.rowsBetween(*rows)
    if values is not None:
        spec = spec.rangeBetween(*values)
    return spec


def up_to_now(keys: str | Sequence[str], order: str) -> WindowSpec:
    """Everything up to the current value of ``order``; rows that share that value share the result."""
    return series_window(keys, order, values=(Window.unboundedPreceding, Window.currentRow))
