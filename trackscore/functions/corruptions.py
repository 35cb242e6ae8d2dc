"""Controlled temporal corruptions of window arrays (L items, bounded)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reversed_window(items: str) -> Column:
    return F.reverse(items)


def skipped(items: str, every: int = 2) -> Column:
    """Keep each ``every``-th item."""
    return F.filter(items, lambda x, i: i % every == 0)


def repeated(items: str, times: int = 2) -> Column:
    """Repeat each item, keeping the window length."""
    wide = F.flatten(F.transform(items, lambda x: F.array_repeat(x, times)))
    return F.slice(wide, F.lit(1), F.size(items))


def inserted(items: str, donor: str, at: int) -> Column:
    """Cut to another window's items from position ``at`` on (an abrupt transition)."""
    return F.concat(F.slice(items, 1, at), F.slice(donor, F.lit(at + 1), F.size(items) - at))


def speed_changed(items: str, factor: float) -> Column:
    """Play faster (> 1, the last item then repeats) or slower (< 1)."""
    last = F.size(items) - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.get(F.col(items), F.least(F.floor(i * F.lit(factor)).cast("int"), last)),
    )


def shuffled(items: str, seed: int, *window: str) -> Column:
    """Seeded permutation of the items; differs between windows."""
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in window])
    keyed = F.transform(items, lambda x, i: F.struct(
        F.sha2(F.concat_ws(":", name, i.cast("string")), 256).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])
