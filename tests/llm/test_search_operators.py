"""Lexical search, hard negatives and near copies of vectors, against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import forest, hard_negatives, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, want in asked.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in want if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_lexical_equals_plain(spark, make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 200)
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)] + ["É", "日本", "Ab", "aB"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30))), "en", "a") for i in range(100, 300)]
    rows += [(i, "w1 w2 w3!w3", "en", "a") for i in (-5, -4, 900, 901, 902, 903, 904, 905, 906, 907, 908, 909)] + odd_rows + [(None, "w1 w2 w3!w3", None, None)]
    items = [(1, "w1 W2,w3 w3"), (2, "the cat"), (3, "ab é 日本"), (4, None), (5, "..."), (6, "nowhere"), (None, "w1"), (7, "w4"), (7, "w5 w4"), (8, "É"), (9, " ".join(words))]
    asked = spark.createDataFrame([(*r, 1, 0.5) for r in items], "item_id long, text string, rank int, score double")
    for block in (1 << 20, 20):
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
        got = lexical.lexical_search(make_docs(rows), asked).collect()
        assert sorted(tuple(r) for r in got) == plain_search([r[:2] for r in rows], items)
    assert max(Counter(r.item_id for r in got).values()) == 10


def test_lexical_of_nothing(spark, make_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = make_docs([(1, "a"), (2, "")])
    assert lexical.lexical_search(docs.limit(0), items).collect() == []
    assert lexical.lexical_search(docs.where("doc_id = 2"), items).collect() == []
    assert lexical.lexical_search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.lexical_search(docs, items).collect()] == plain_search([(1, "a"), (2, "")], [(1, "a b")])


def test_shards_cut_no_tie():
    acc, ids = np.array([5, 7, 7, 0, 7, 5, 9]), np.array([1, 9, 3, 4, 2, 0, 8])
    assert lexical.ranked(acc, ids, 3).tolist() == [6, 4, 2]
    assert lexical.ranked(acc, ids, 10).tolist() == [6, 4, 2, 1, 5, 0]
    assert lexical.ranked(acc * 0, ids, 3).tolist() == []


def test_an_impact_of_long_texts_stays_whole():
    words = lexical.Words(np.frombuffer(b"a a b", np.uint8), np.array([0, 5]), kinds=lexical._IS_TERM)
    _, _, sizes, places, impacts = lexical.shard(np.array([1]), words, 10**17, 10**12)  # 90 * 3 * 10**17 passes 64 bits
    assert sizes.tolist() == [1, 1] and places.tolist() == [0, 0]
    assert sorted(impacts.tolist()) == sorted(10**9 * tf // (1000 * tf + 8 * (10 + 27_000_000)) for tf in (1, 2))


def plain_negatives(rows, every=10, positives=5, negatives=10):
    clip = lambda s: min(max(s, -(2**63) + 1), 2**63 - 1)
    held = [(i, lab, [math.floor(256 * v) for v in e]) for i, e, lab in rows if i is not None and e is not None and lab is not None and all(v is not None and math.isfinite(256 * v) for v in e)]
    raw = [(lab, e, i) for i, e, lab in rows if any(h[0] == i for h in held) and e is not None and lab is not None]
    out = []
    for a in sorted({h[0] for h in held if h[0] % every == 0}):
        label, vector, _ = min(r for r in raw if r[2] == a)
        q = [math.floor(256 * v) for v in vector]
        scores = sorted((-clip(sum(x * y for x, y in zip(q, e, strict=False))), i, lab) for i, lab, e in held if i != a)
        for s, i, _ in [x for x in scores if x[2] == label][:positives]:
            fits = [x for x in scores if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.3, 3e6, 1e16])
def test_negatives_equal_plain(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 12 * 8 * 40)  # blocks of 40
    monkeypatch.setattr(hard_negatives, "LEAF", 6)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(0, scale, (260, 12)).round(2)
    x[40:70] = x[3]  # ties
    x[70:90] = x[10] + rng.normal(0, scale / 20, (20, 12)).round(2)
    rows = [(i, [float(v) for v in r], int(lab)) for i, (r, lab) in enumerate(zip(x, rng.integers(0, 4, 260), strict=True))]
    rows += [rows[5], (20, rows[1][1], 2), (30, rows[30][1], 99), (None, rows[0][1], 1), (500, None, 1), (510, rows[2][1], None), (520, [float("nan")] * 12, 1)]
    rows += [(530, [float("inf")], 1), (540, [1.0, 2.0], 1), (550, [], 1), (560, [0.0] * 12, 3), (571, [1e307] * 12, 2)]
    df = spark.createDataFrame([(*r, 7, 0.5) for r in rows], "vec_id long, embedding array<double>, label int, rank int, score double")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 1)], "vec_id long, embedding array<float>, label int")
    for rows in (df.limit(0), df, df.where("vec_id > 0")):
        assert hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0).collect() == []


def test_ball_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(6)
    middles = rng.normal(0, 100, (20, 16))
    x = np.floor(middles[rng.integers(0, 20, 2000)] + rng.normal(0, 8, (2000, 16)))
    labels = rng.integers(0, 3, 2000)
    trees = hard_negatives.BallTrees(x, labels, 20)
    q = np.floor(rng.normal(0, 100, (9, 16)))
    low, high = trees.bounds(q)
    for k, (a, b) in enumerate(trees.span):
        score = q @ x[trees.order[a:b]].T
        assert (low[:, k] <= score.min(1)).all() and (high[:, k] >= score.max(1)).all()
        assert (labels[trees.order[a:b]] == trees.label[k]).all()
    assert sorted(i for (a, b), leaf in zip(trees.span, trees.leaf, strict=True) if leaf for i in trees.order[a:b]) == list(range(2000))
    told, ids = [], np.arange(2000)
    anchors = {"id": ids[:64], "label": labels[:64], "x": x[:64], "windows": [[(100_000, 200_000)]] * 64}
    hard_negatives.mine_block(anchors, {"id": ids, "label": labels, "x": x}, False, 10, told)
    assert 0 < told[0] < 0.3 * 64 * 2000  # windows, labels and thresholds leave few rows of clustered data


def plain_links(rows, threshold=0.93):
    """Links and smallest reachable id of every row, by all pairs."""
    fine = [i is not None and lab is not None and e is not None and all(v is not None and math.isfinite(v) for v in e) and any(e) for i, e, lab in rows]
    dim = max(len(e or []) for _, e, _ in rows)
    x = np.zeros((len(rows), dim))
    for k, (_, e, _) in enumerate(rows):
        if fine[k]:
            x[k, : len(e)] = np.array(e) / max(map(abs, e))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    link = (x @ x.T >= threshold) & (label[:, None] == label[None]) & np.outer(fine, fine)
    np.fill_diagonal(link, True)
    low = np.array([10**9 if r[0] is None else r[0] for r in rows])
    while ((lower := np.where(link, low[None], 10**9).min(1)) != low).any():
        low = lower
    return sorted((i, int(n) - 1, None if i is None else int(c), i is None or i == c) for (i, _, _), n, c in zip(rows, link.sum(1), low, strict=True) if i is not None)


@pytest.mark.parametrize("sizes", [{}, {"LEAF": 16, "NODE": 100, "BLOCK": 30}])
def test_near_copies_equal_all_pairs(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (700, 24))
    x[100:220] = x[3] + rng.normal(0, 0.05, (120, 24))  # all linked
    x[220:300] = x[4]  # copies
    x[300:340] = x[5] * np.arange(1, 41)[:, None]  # of another length
    for k in range(340, 420):  # a chain: neighbours are linked, most others are not
        x[k] = x[k - 1] + rng.normal(0, 0.25, 24)
    label = rng.integers(0, 2, 700)
    label[100:420] = 1
    label[3:6] = 1
    rows = [(int(i), [float(v) for v in e], int(lab)) for i, e, lab in zip(rng.permutation(700), x, label, strict=True)]
    rows += [(800, None, 1), (801, rows[3][1], None), (802, [0.0] * 24, 1), (803, [0.0] * 24, 1), (804, [float("nan")] * 24, 1), (805, [1.0, 2.0], 1), (806, [1e300, 2e300], 1), (807, [], 1)]
    rows += [(808, [-0.0, 1.0], 1), (809, [0.0, 1.0], 1), rows[3], (rows[4][0], rows[5][1], 1)]
    df = spark.createDataFrame([(*r, 1, 2, "k", 0.5) for r in [*rows, (None, rows[3][1], 1)]], "vec_id long, embedding array<double>, label int, cid int, tree int, path string, n double")
    got = forest.near_copies(df).collect()
    want = plain_links(rows)
    assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, True)]
    mine = sorted(tuple(r) for r in got if r.vec_id is not None)
    assert len(mine) == len(want) == len(rows)
    found, total = sum(r[1] for r in mine), sum(r[1] for r in want)
    assert 0.99 * total <= found <= total
    assert all(a[1] <= b[1] and a[2] >= b[2] for a, b in zip(mine, want, strict=True))  # nothing that is no link
    assert found < total or mine == want


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0], 1), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert forest.near_copies(df.limit(0)).collect() == []
    assert sorted(tuple(r) for r in forest.near_copies(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_forest_finds_pairs_at_the_threshold():
    """Recall of single pairs just above the threshold, the hardest to find, by one tree and by all."""
    rng = np.random.default_rng(9)
    a = rng.normal(0, 1, (3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(0, 1, (3000, 32))
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.935 * a + np.sqrt(1 - 0.935**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, found, first = np.concatenate([a, b]), np.zeros(3000, bool), 0
    for tree in range(forest.TREES):
        for rows in forest.leaves(x, tree, 1):
            here = np.bincount(rows[rows < 3000], minlength=3000) & np.bincount(rows[rows >= 3000] - 3000, minlength=3000)
            found |= here > 0
        first = first or found.mean()
    assert 0.3 < first < 0.95 and found.mean() > 0.99
