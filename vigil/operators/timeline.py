"""Window specs shared by every per-run operator.

A *timeline* is a table with a series key (``run``), an ordering (time plus a
unique tie-breaker, so row frames are deterministic) and a numeric time column
``t`` in seconds used by time conditions.  All window features of one call are
built on the same ``partitionBy/orderBy`` so Catalyst plans one exchange and
one sort for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Timeline:
    run: str | tuple[str, ...]
    order: tuple[str, ...]
    t: str | None = None
    label: str | None = None
    sensors: tuple[str, ...] = field(default_factory=tuple)

    @property
    def run_cols(self) -> list[str]:
        return [self.run] if isinstance(self.run, str) else list(self.run)

    def with_(self, **kw) -> "Timeline":
        return replace(self, **kw)

    # window specs -----------------------------------------------------
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.run_cols).orderBy(*self.order)

    def rows(self, lo: int, hi: int) -> WindowSpec:
        return self.w().rowsBetween(lo, hi)

    def prefix(self, inclusive: bool = True) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, 0 if inclusive else -1)

    def reversed_prefix(self, inclusive: bool = True) -> WindowSpec:
        """Rows from the end of the run back to the current row, walked in
        reverse order.  ``last(x, ignorenulls)`` over it equals
        ``first(x, ignorenulls)`` over ``rows(0, unboundedFollowing)`` but is
        evaluated incrementally: Spark recomputes an unbounded-following frame
        for every row (quadratic in the run length)."""
        desc = [F.col(o).desc() for o in self.order]
        return (Window.partitionBy(*self.run_cols).orderBy(*desc)
                .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))

    def next_non_null(self, x, inclusive: bool = True) -> Column:
        """Nearest non-null ``x`` at (or after) the current row."""
        return F.last(x, ignorenulls=True).over(self.reversed_prefix(inclusive))

    def prev_non_null(self, x, inclusive: bool = True) -> Column:
        """Nearest non-null ``x`` at (or before) the current row."""
        return F.last(x, ignorenulls=True).over(self.prefix(inclusive))

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.run_cols)


def last_n(tl: Timeline, n: int) -> WindowSpec:
    """Frame of the current row and the ``n - 1`` rows before it."""
    return tl.rows(-(n - 1), 0)


def full_frame_guard(x: Column, tl: Timeline, n: int, value: Column) -> Column:
    """``value`` only where the n-row frame holds n non-null ``x`` (pandas
    ``rolling(n)`` default ``min_periods=n``), else null."""
    return F.when(F.count(x).over(last_n(tl, n)) == n, value)
