"""Parameters of the rally analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# The defaults that results are compared under.
@dataclass(frozen=True)
class RallyParameters:
    split_gap_seconds: float = 0.35
    top_edge_fraction: float = 0.22
    min_rally_hits: int = 2
    min_rally_seconds: float = 0.8
    smooth_seconds: float = 0.22
    turn_window_seconds: float = 0.24
    merge_seconds: float = 0.32
    min_turn_diagonal_fraction: float = 0.02
    #: "half_up" (away from zero) or "half_even", for seconds that become frames
    rounding: str = "half_up"

    def frames(self, seconds: float, fps: Column) -> Column:
        """Seconds as a whole number of frames, rounded."""
        turn = F.round if self.rounding == "half_up" else F.bround
        return turn(F.lit(seconds) * fps).cast("int")

    def restart_gap(self, fps: Column) -> Column:
        return F.greatest(F.lit(2), self.frames(0.10, fps))

    def split_gap(self, fps: Column) -> Column:
        return F.greatest(F.lit(1), self.frames(self.split_gap_seconds, fps))

    def long_gap(self, fps: Column) -> Column:
        return self.frames(3.0, fps)

    def smooth_window(self, fps: Column) -> Column:
        """Rows of the smoothing window: at least 3, and odd."""
        rows = F.greatest(F.lit(3), self.frames(self.smooth_seconds, fps))
        return rows + F.when(rows % 2 == 0, 1).otherwise(0)

    def turn_window(self, fps: Column) -> Column:
        return F.greatest(F.lit(2), self.frames(self.turn_window_seconds, fps))

    def merge_gap(self, fps: Column) -> Column:
        return F.greatest(F.lit(1), self.frames(self.merge_seconds, fps))


DEFAULTS = RallyParameters()
