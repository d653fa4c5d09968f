"""Games of a match: scores that begin anew when a game ends, folded in blocks that compose.

What a block of outcomes does to a score is a table: for every score at which it
can begin, the score at its end and the games won in between. The tables of a
match compose in order, so that each block learns where it begins, and all
blocks are then gone through side by side. A table has one entry for each score
of an open game, some hundreds, however long the match is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = {"A_POINT": 0, "B_POINT": 1}


@dataclass(frozen=True)
class Rules:
    """A game ends at ``to`` points with ``ahead`` more than the other side, or at ``cap``."""

    to: int = 21
    ahead: int = 2
    cap: int = 30

    def over(self, a: int, b: int) -> bool:
        return (max(a, b) >= self.to and abs(a - b) >= self.ahead) or max(a, b) >= self.cap

    @cached_property
    def open(self) -> list[tuple[int, int]]:
        """Scores of games that go on, 0:0 first."""
        return [(a, b) for a in range(self.cap) for b in range(self.cap) if not self.over(a, b)]

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """By side and place in ``open``: the place after a point, and whether it ends the game."""
        place = {score: k for k, score in enumerate(self.open)}
        after, ends = np.zeros((2, len(place)), np.int32), np.zeros((2, len(place)), np.int32)
        for (a, b), k in place.items():
            for side, score in enumerate(((a + 1, b), (a, b + 1))):
                ends[side, k] = self.over(*score)
                after[side, k] = 0 if ends[side, k] else place[score]
        return after, ends

    def table(self, sides: list[int]) -> np.ndarray:
        """What points in a row do: rows are the place at the end and the games that each side won, by place at the begin."""
        after, ends = self.steps
        out = np.zeros((3, len(self.open)), np.int32)
        out[0] = np.arange(len(self.open))
        for side in sides:
            out[1 + side] += ends[side][out[0]]
            out[0] = after[side][out[0]]
        return out


def game_scores(points: DataFrame, key: str = "video_id", rules: Rules | None = None, block: int = 4096) -> DataFrame:
    """Game, score in it, games won and next server after each outcome of a match (columns key, rally, outcome).

    A_POINT and B_POINT count, all other outcomes and null change nothing. The row
    that ends a game has its last score; the next one begins at 0:0. ``server`` is
    the side that won the last point of the game, null at its begin, where the
    players say who serves. Rows go by rally, equal ones by outcome; those without
    a rally are left out. Null key: a match of its own. Other columns are ignored.
    Empty table: no rows. Rallies of ``block`` numbers in a row are one row of a
    task, a match has one table for each block.
    """
    rules = rules or Rules()
    schema = "match long, block long"
    rows = points.where("rally is not null").select(F.col(key).cast("long").alias("match"), F.col("rally").cast("long").alias("rally"), F.col("outcome").cast("string").alias("outcome"))
    blocks = rows.groupBy("match", F.expr(f"rally div {int(block)}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("rally", "outcome"))).alias("points"))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sides = [[SIDES[p["outcome"]] for p in row if p["outcome"] in SIDES] for row in batch["points"]]
            yield batch[["match", "block"]].assign(table=[rules.table(s).tobytes() for s in sides], last=[s[-1] if s else -1 for s in sides])

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for match, row in zip(batch["match"], batch["blocks"], strict=True):
                at, won, last = 0, np.zeros(2, np.int64), -1
                for b in row:
                    out.append((match, b["block"], at, *won.tolist(), last))
                    table = np.frombuffer(b["table"], np.int32).reshape(3, -1)
                    won, at, last = won + table[1:, at], int(table[0, at]), last if b["last"] < 0 else b["last"]
            yield pd.DataFrame(out, columns=["match", "block", "at", "won_a", "won_b", "last"]).astype({"match": "Int64"})

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after, ends = rules.steps
        for batch in batches:
            out = []
            for match, row, at, won_a, won_b, last in batch[["match", "points", "at", "won_a", "won_b", "last"]].itertuples(index=False, name=None):
                won, last = [won_a, won_b], last if at else -1
                for p in row:
                    side, game, score, end = SIDES.get(p["outcome"], -1), sum(won) + 1, list(rules.open[at]), 0
                    if side >= 0:
                        score[side] += 1
                        end, at = int(ends[side, at]), int(after[side, at])
                        won[side] += end
                        last = -1 if end else side
                    out.append((match, p["rally"], p["outcome"], game, *score, *won, bool(end), "AB"[last] if last >= 0 else None))
            yield pd.DataFrame(out, columns=["match", "rally", "outcome", "game", "a", "b", "games_a", "games_b", "ends", "server"]).astype({"match": "Int64"})

    told = blocks.mapInPandas(tables, f"{schema}, table binary, last int").groupBy("match").agg(F.array_sort(F.collect_list(F.struct("block", "table", "last"))).alias("blocks"))
    first = told.mapInPandas(begins, f"{schema}, at int, won_a long, won_b long, last int").select(F.col("match").alias("_match"), F.col("block").alias("_block"), "at", "won_a", "won_b", "last")
    both = blocks.join(first, F.col("match").eqNullSafe(F.col("_match")) & (F.col("block") == F.col("_block"))).drop("_match", "_block")
    done = both.mapInPandas(scores, "match long, rally long, outcome string, game long, a int, b int, games_a long, games_b long, ends boolean, server string")
    return done.withColumnRenamed("match", key)
