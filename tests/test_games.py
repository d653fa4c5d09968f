"""Games against a plain loop over each match."""

import random

import pytest

from trackloom.operators.games import Rules, game_scores

SCHEMA = "video_id long, rally long, outcome string, a string, game int, block int"


def plain(outcomes):
    """Game, score, games won, end and server after each outcome, one after the other."""
    score, won, server, out = {"A": 0, "B": 0}, {"A": 0, "B": 0}, None, []
    for o in outcomes:
        game, end = won["A"] + won["B"] + 1, False
        if o in ("A_POINT", "B_POINT"):
            server = o[0]
            score[server] += 1
            most, least = max(score.values()), min(score.values())
            end = most == 30 or (most > 20 and most - least > 1)
        shown = (game, score["A"], score["B"])
        if end:
            won[server] += 1
            score, server = {"A": 0, "B": 0}, None
        out.append((*shown, won["A"], won["B"], end, server))
    return out


def matches():
    rng = random.Random(3)
    yield 1, ["A_POINT"] * 50
    yield 2, ["A_POINT", "B_POINT"] * 70  # 29 all: the cap ends it
    yield 3, ["NON_RALLY", None, "PENDING", "other"] * 5
    yield 4, ["B_POINT"]
    yield None, ["B_POINT", "A_POINT", "NON_RALLY"] * 30
    for m in range(5, 20):
        yield m, rng.choices(["A_POINT", "B_POINT", "NON_RALLY", "PENDING", None], [5, 4, 1, 1, 1], k=rng.randint(1, 400))


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_games_equal_a_plain_loop(spark, block):
    made = dict(matches())
    rows = [(m, k + 1, o, "x", 9, 9) for m, outcomes in made.items() for k, o in enumerate(outcomes)]
    random.Random(block).shuffle(rows)
    rows.append((1, None, "A_POINT", "x", 9, 9))
    got = {}
    for r in game_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect():
        got.setdefault(r.video_id, []).append((r.rally, r.outcome, (r.game, r.a, r.b, r.games_a, r.games_b, r.ends, r.server)))
    assert set(got) == set(made)
    for m, outcomes in made.items():
        assert [(k + 1, o, row) for k, (o, row) in enumerate(zip(outcomes, plain(outcomes), strict=True))] == sorted(got[m], key=lambda t: t[0]), m
    assert any(t[2][1:3] == (30, 29) for t in got[2])
    assert game_scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tables_compose():
    """The table of two runs of points is that of one after the other, from every open score."""
    rules, rng = Rules(), random.Random(5)
    assert len(rules.open) == len(set(rules.open)) and rules.open[0] == (0, 0)
    one, two = [[rng.randrange(2) for _ in range(n)] for n in (33, 90)]
    first, second, both = rules.table(one), rules.table(two), rules.table(one + two)
    assert (both[0] == second[0][first[0]]).all()
    assert (both[1:] == first[1:] + second[1:, first[0]]).all()
