"""Range to columns: which tier a read uses, how wide its columns are, and which buckets it touches. Pure Python, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from ..model import MAX_COLUMNS, RANGES, TIERS


@dataclass(frozen=True)
class ColumnPlan:
    tier: str
    step: int
    lower: int
    upper: int
    per_column: int
    columns: int

    @property
    def seconds(self) -> int:
        return self.step * self.per_column

    def retained_from(self, newest: int) -> int:
        """First bucket that a tier whose newest bucket is this one still holds."""
        return max(self.lower, newest - TIERS[self.tier][1] + 1)

    def retained_columns(self, newest: int) -> int:
        """Columns of which the ring still holds something."""
        return -(-max(0, self.upper - self.retained_from(newest)) // self.per_column)

    def column_at(self, seconds: int) -> int | None:
        """The column that a time falls in."""
        column = (seconds // self.step - self.lower) // self.per_column
        return column if 0 <= column < self.columns else None

    def column_start(self, column: int) -> int:
        return (self.lower + column * self.per_column) * self.step


def plan(seconds: int, now: int, max_columns: int = MAX_COLUMNS, tiers: tuple[str, ...] = ("t0", "t1", "t2")) -> ColumnPlan:
    """The plan of a read of `seconds` up to `now`. Wider columns when the range has more than max_columns; a tier that is not open gives way
    to the coarsest open one whose step divides the column."""
    tier, width = RANGES[seconds]
    if tier not in tiers:
        fitting = [t for t in tiers if width % TIERS[t][0] == 0] or [tiers[0]]
        tier = max(fitting, key=lambda t: TIERS[t][0])
    step = TIERS[tier][0]
    wanted, budget = -(-seconds // width), min(max(max_columns, 1), MAX_COLUMNS)
    if wanted > budget:
        width *= -(-wanted // budget)
        width = -(-width // step) * step
    per = max(1, width // step)
    columns = max(1, -(-seconds // (per * step)))
    upper = now // step + 1
    return ColumnPlan(tier, step, max(0, upper - columns * per), upper, per, columns)
