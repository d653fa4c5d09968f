"""Joins, mixing, archives, search, and the pipeline, against brute force or SQL."""

import importlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import curriculum, queries, topk, trie_join, warc
from trackloom.llm.common import Scratch, connected_components, pack, unpack

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.register("got", queries.QUERIES[name](spark, DATA).toArrow())
    con.sql(f"create table want as {queries.ORACLE_SQL[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in con.sql("describe want").fetchall())
    for a, b in (("got", "want"), ("want", "got")):
        assert con.sql(f"select {columns} from {a} except all select {columns} from {b}").fetchall() == []


def plain_join(docs, size=3, percent=90):
    sets = []
    for _, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    low = {}
    for k, (d, _) in enumerate(docs):
        low[find(k)] = min(d, low.get(find(k), d))
    return {d: (len(sets[k]), low[find(k)], links[k]) for k, (d, _) in enumerate(docs)}


def near_copies(seed=3):
    """Groups of texts that differ in a few words, around the threshold."""
    rng = random.Random(seed)
    docs, passage = [], [f"p{k}" for k in range(40)]
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 60)}" for _ in range(rng.choice([9, 10, 11, 12, 80, 120]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[at] = f"x{rng.randint(0, 5)}"
                else:
                    w.append(f"t{rng.randint(0, 3)}")
            docs.append(" ".join(w + (passage if rng.random() < 0.2 else [])))
    docs += ["a", "A", "a b", "a b", "b a", "", None, "  "]
    return list(enumerate(docs))


@pytest.mark.parametrize(("block", "heavy"), [(10**9, 200), (150, 10), (20, 2)])
def test_trie_join_equals_all_pairs(spark, make_docs, monkeypatch, block, heavy):
    """A block of 20 n-grams has large groups dealt by prefix n-gram, as test_large_groups_are_dealt_both_ways says."""
    monkeypatch.setattr(trie_join, "BLOCK_ITEMS", block)
    monkeypatch.setattr(trie_join, "HEAVY_CLASSES", heavy)
    docs = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in trie_join.ngram_join(make_docs(docs)).collect()}
    assert got == plain_join(docs)


def test_large_groups_are_dealt_both_ways(spark, make_docs, monkeypatch):
    for block, way in ((20, True), (150, False)):
        monkeypatch.setattr(trie_join, "BLOCK_ITEMS", block)
        scratch = Scratch(spark, "test-deal")
        trie_join.ngram_join(make_docs(near_copies()), scratch).collect()
        weights = spark.read.parquet(f"{scratch.root}/weights").where("blocks > 1").collect()
        assert way in {r.by_token for r in weights}


def test_trie_join_odd_rows(spark, make_docs, odd_rows):
    rows = trie_join.ngram_join(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 5 and by[5].n_links == 1 and by[7].n_links == 1 and by[2].n_shingles == 0 and by[2].component_id == 2
    assert trie_join.ngram_join(make_docs([])).collect() == []


def test_trie_join_links_four_of_five(spark, make_docs):
    """Sets so small that they link at 80% only, and every link of small sets against all pairs."""
    rng = random.Random(8)
    docs = [" ".join(f"c{k}" for k in range(n)) for n in (8, 9)]
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(rng.randint(6, 14))]
        docs += [" ".join(base + [f"t{k}" for k in range(rng.randint(0, 2))]) for _ in range(4)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, docs)]
    links = Counter()
    for a, b in itertools.permutations(range(len(docs)), 2):
        links[a] += 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    got = {r.doc_id: r for r in trie_join.ngram_join(make_docs(list(enumerate(docs))), percent=80, size=5).collect()}
    assert (got[0].n_shingles, got[1].n_shingles, got[1].component_id) == (4, 5, 0)
    assert {d: (r.n_shingles, r.n_links) for d, r in got.items()} == {d: (len(sets[d]), links[d]) for d in range(len(docs))}


def test_near_copies_of_edited_texts_go(spark, make_docs):
    pipeline = importlib.import_module("corpus_pipeline")
    text = [f"w{k}" for k in range(100)]
    docs = [
        (1, " ".join(text)), (2, " ".join(text + [f"p{k}" for k in range(20)])),  # a paragraph added
        (3, " ".join(f"c{k}" for k in range(9))), (4, " ".join(f"c{k}" for k in range(8))),
        (5, " ".join(f"v{k}" for k in range(100))), (6, " ".join(f"v{k}" if k % 50 != 25 else "edited" for k in range(100))),  # 2% of words edited
        (7, " ".join(f"v{k}" if k % 5 else "other" for k in range(100))),
    ]
    assert {r.doc_id for r in pipeline.near_copies(spark, make_docs(docs), DATA).collect()} == {1, 3, 5, 7}


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)]
    got = {r.vertex: r.component for r in connected_components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    group = {v: {v} for e in edges for v in e}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for v in group[b]:
                group[v] = group[a]
    assert got == {v: min(s) for v, s in group.items() if len(s) > 1}


def test_packing():
    a, b = np.array([1, 2**60], np.uint64), np.array([], np.uint32)
    x, y = unpack(pack(a, b), np.uint64, np.uint32)
    assert (x == a).all() and len(y) == 0


def test_curriculum_targets_and_limits(spark, make_docs, odd_rows):
    rng = random.Random(5)
    docs = [(k, " ".join(["w"] * rng.randint(0, 50)), None, rng.choice(["a", "b", "c", "d", None, "é"])) for k in range(400)] + [(1000 + k, *r[1:]) for k, r in enumerate(odd_rows)]
    rows = curriculum.curriculum_mix(make_docs(docs)).collect()
    assert len(rows) == len(docs)
    total, by = sum(r.size for r in rows), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-6
        assert bool(r.positions) == bool(r.taken) and all(0 <= p <= 1.5 * total for p in r.positions)
        s = by.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.taken
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken - target) <= 1 for taken, target, _ in by.values())
    # a position is a place in the stream: about as many words come before it
    longest, before = max(r.size for r in rows), 0
    stream = sorted((p, min(r.size, r.taken - k * r.size)) for r in rows for k, p in enumerate(r.positions))
    for position, words in stream:
        assert abs(position - before) <= longest * len(by)
        before += words
    again = curriculum.curriculum_mix(make_docs(docs[::-1])).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert curriculum.curriculum_mix(make_docs([])).collect() == []
    assert all(r.taken == 0 for r in curriculum.curriculum_mix(make_docs([(1, None), (2, "")])).collect())


def test_another_schedule_gives_another_mix(spark, make_docs):
    docs = [(k, "w " * (5 + k % 7), None, "abc"[k % 3]) for k in range(90)]
    as_is = {r.doc_id: r.positions for r in curriculum.curriculum_mix(make_docs(docs)).collect()}
    flat = {r.doc_id: r.positions for r in curriculum.curriculum_mix(make_docs(docs), schedules=((1.0, 1.0, 1.0),)).collect()}
    late = {r.doc_id: r.positions for r in curriculum.curriculum_mix(make_docs(docs), schedules=((2.0, 1.0, 0.0), (0.0, 1.0, 2.0), (1.0, 1.0, 1.0))).collect()}
    assert sum(as_is[d] != flat[d] for d in as_is) > 60
    mean = lambda got, source: np.mean([p for d, ps in got.items() for p in ps if d % 3 == source])
    assert mean(late, 0) < mean(flat, 0) - 50 and mean(late, 1) > mean(flat, 1) + 50


def test_training_time_inverts_the_integral(spark):
    knots, weights = curriculum.KNOTS, curriculum.SCHEDULES
    rows = spark.range(0, 300).select((F.col("id") % 3).alias("r"), (F.col("id") / 300).alias("u")).select("r", "u", curriculum.training_time(F.col("u"), F.col("r")).alias("t")).collect()
    grid = np.linspace(0, 1, 20001)
    for r in rows:
        w = np.interp(grid, knots, weights[r.r])
        area = np.append(0, np.cumsum((w[1:] + w[:-1]) / 2)) / np.sum((w[1:] + w[:-1]) / 2)
        assert np.interp(r.t, grid, area) == pytest.approx(r.u, abs=1e-6)


def test_warc_round_trip(spark):
    import hashlib

    rng = random.Random(7)
    big = "".join(rng.choice("abc\r\né<") for _ in range(50_000))
    pages = [(1, "u", big), (2, None, big), (3, "http://x/ y\n", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "x" * 1000), (7, "u", "x" * 1000), (7, "u", "x" * 1000), (8, "u", "0\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, digest string, origin int")
    read = warc.round_trip(df, segment=4096).collect()
    got = Counter(tuple(r)[:5] for r in read)
    names = Counter(r.record_id for r in read)
    assert max(names.values()) == 1
    of = {r.record_id: r for r in read}
    for r in read:  # every revisit names a response with its payload
        if r.record_type == "revisit":
            assert (of[r.response_id].record_type, of[r.response_id].page_id, of[r.response_id].payload_digest) == ("response", r.refers_to, r.payload_digest)
    want = Counter()
    for p, _, h in pages:
        raw = (h or "").encode()
        top = max((q for q, _, g in pages if g == h and q is not None), default=None)
        again = len(raw) >= 1000 and top is not None and p != top
        want[p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).collect() == []


def test_broken_archives_are_told():
    recs = warc.page_records(1, "urn:page:1:0", "u", b"y" * 9000, "00" * 20, None, False, 4096)
    parsed = [warc.parse(r) for r in recs]
    assert [h["warc-type"] for h, _ in parsed] == ["response", "continuation", "continuation"]
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
    with pytest.raises(ValueError):
        list(warc.members(zlib.compress(b"x", wbits=31)[:-4]))


def test_segments_that_do_not_fit_are_told(spark):
    import hashlib

    payload = b"y" * 9000
    recs = warc.page_records(1, "urn:page:1:0", "u", payload, hashlib.sha1(payload).hexdigest(), None, False, 4096)
    lone = warc.page_records(2, "urn:page:2:0", "u", payload, hashlib.sha1(payload).hexdigest(), 9, True, 4096)

    def read(parts):
        content = b"".join(zlib.compress(p, wbits=31) for p in parts)
        return warc.read_pages(spark.createDataFrame([(bytearray(content),)], "content binary")).collect()

    assert [(r.page_id, r.payload_bytes) for r in read(recs[::-1])] == [(1, 9000)]
    cut = recs[2].replace(b"WARC-Segment-Total-Length: 9", b"WARC-Segment-Total-Length: 8")
    for parts in (recs[:2], [recs[0], recs[2]], [*recs, recs[1]], [*recs[:2], cut], lone):
        with pytest.raises(Exception, match="segments of|no response"):
            read(parts)


def test_top_k_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 24 * 8 * 7)  # blocks of 7
    monkeypatch.setattr(topk, "TILE_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, (600, 24)).astype(np.float32)
    x[100:130] = x[7]  # ties
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(1000, None), (1050, [float("nan")] * 24), (None, rows[0][1]), (1100, [1.0, float("inf")])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    z = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 600, 50):
        s = z @ z[q]
        best = sorted((k for k in range(600) if k != q), key=lambda k: (-s[k], k))[:5]
        assert got[q] == {i + 1: (k, s[k]) for i, k in enumerate(best)}
    assert set(got) == set(range(0, 600, 50))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = topk.top_k(df.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]


def test_large_components_ties_and_lengths(spark):
    """Products beyond doubles, and beyond 64 bits, against whole numbers of any size."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in rng.choice([1, -1], 5) * rng.choice([3e6, 1e9, 2.5, 1e17], 5)]) for k in range(60)]
    rows += [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (150, []), (200, [1e308]), (3, rows[3][1]), (50, [0.5] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    scaled = [(k, [int(np.floor(256 * v)) for v in e]) for k, e in rows if k != 200]
    query = {k: min(e for j, e in rows if j == k) for k, _ in rows if k % 50 == 0 and k != 200}
    assert set(got) == set(query)
    for k, e in query.items():
        q = [int(np.floor(256 * v)) for v in e]
        clip = lambda s: min(max(s, topk.LOWEST), topk.HIGHEST)
        best = sorted((-clip(sum(a * b for a, b in zip(q, x, strict=False))), j) for j, x in scaled if j != k)[:5]
        assert sorted(got[k]) == [(i + 1, j, -s) for i, (s, j) in enumerate(best)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    a, b = np.floor(rng.normal(0, 60, (40, 30))), np.floor(rng.normal(0, 60, (50, 30)))
    for share in (0.0, 0.3, 0.75):
        for segments in (1, 4, 7, 30):
            assert (topk.level(a, share, segments) @ topk.level(b, share, segments).T >= a @ b.T - 1e-6).all()
    x = rng.normal(0, 1, (6000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    told = []
    topk.best_of(np.arange(0, 6000, 50), x[::50], np.arange(6000), x, 5, told=told)
    left = np.sum(told[1:], 0)  # the first tile has no threshold yet
    assert left[0] > left[3] > left[4] and left[4] < 0.25 * left[0]


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scratch, kept = Scratch(spark, "test-pipeline"), [docs]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = scratch.write(stage(spark, kept[-1], DATA), f"{k}-{name}")
        if k < 4:
            assert out.columns == docs.columns
        kept.append(out)
    counts = [x.count() for x in kept]
    assert counts[0] >= counts[1] > counts[2] == counts[3] > 0 and counts[4] == counts[5]
    # one document of each group, and every group has one
    groups = plain_join([(r.doc_id, r.text) for r in kept[1].collect()], size=5, percent=80)
    assert {r.doc_id for r in kept[2].collect()} == {g for _, g, _ in groups.values()}
    # no pattern secret is left
    assert not [r for r in kept[3].collect() if re.search(r"(?i)token = \"[0-9a-f]{40}", r.text)]
    assert kept[4].select("doc_id").distinct().count() <= counts[3]
    got = pipeline.run(spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept[5].collect()))


def test_pipeline_stages_on_odd_rows(spark, make_docs, odd_rows):
    """Every stage on nulls, repeated ids with other texts, no rows, and clashing columns; decisions go by row."""
    pipeline = importlib.import_module("corpus_pipeline")
    key = "0123456789abcdef01234567"
    rows = [*odd_rows, (9, f"token = {key} and plain words of this text", "en", "a"), (9, "quite another text with no such thing in it at all", "en", "b")]
    rows += [(None, f"token = {key[::-1]} here and there", "en", "a"), (None, "nothing to hide in this one either", None, None), (10, rows[0][1], "en", "b")]
    docs = make_docs(rows)
    named = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    every = Counter((r[0], r[1]) for r in rows)
    accepted = pipeline.quality(spark, docs, DATA)
    assert accepted.columns == docs.columns and not named(accepted) - every
    kept = named(pipeline.near_copies(spark, docs, DATA))
    assert kept == Counter({k: 1 for k in every if k not in ((6, rows[5][1]), (10, rows[0][1]))})
    clean = pipeline.secrets(spark, docs, DATA)
    assert clean.columns == docs.columns
    texts = named(clean)
    assert texts[9, "[secret] and plain words of this text"] == texts[None, "[secret] here and there"] == texts[9, rows[-4][1]] == texts[2, None] == 1 and texts.total() == len(rows)
    stream = pipeline.mixture(spark, docs, DATA)
    assert stream.columns == docs.columns and {r for r, n in named(stream).items()} <= {r for r in every if r[1] and r[1].strip()}
    told = pipeline.encoding(spark, docs, DATA).collect()
    assert len(told) == len(rows) and {r.n_tokens for r in told if r.doc_id in (2, 3, 4)} == {0}
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).collect() == [], name
