"""The operators on texts against plain versions of what they say they do."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trackloom.llm import bpe, chat, classifier, katz, ngrams, perplexity, secrets
from trackloom.llm.common import Scratch, Words, held_out, unpack_small

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def random_docs(n, seed=1, words=40):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    return [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, words)))) for k in range(n)]


def plain_katz(docs, train, order):
    """Dictionary version of the model."""
    end = "\0end"
    seqs = {d: [*WORD.findall(lower(t)), end] for d, t in docs}
    uni, grams = Counter(), {n: defaultdict(Counter) for n in range(2, order + 1)}
    for d, s in seqs.items():
        if train(d):
            uni.update(s)
            for n in grams:
                padded = [end] * (n - 1) + s
                for i, w in enumerate(s):
                    grams[n][tuple(padded[i : i + n - 1])][w] += 1
    d1 = katz.good_turing([0] + [sum(c == r for c in uni.values()) for r in range(1, 7)])
    total = sum(uni.values())
    cut = lambda d, c: (d[c] if c <= 5 else 1.0) * c
    left = total - sum(cut(d1, c) for c in uni.values())
    whole = total if left > 0 else total + 1
    once, twice = (sum(c == r for c in uni.values()) for r in (1, 2))
    unseen = max(1, once * (once - 1) / (2 * (twice + 1)))
    unknown = (left if left > 0 else 1.0) / whole / unseen
    d = {n: katz.good_turing([0] + [sum(c == r for h in grams[n].values() for c in h.values()) for r in range(1, 7)]) for n in grams}

    def p(h, w):
        if not h:
            return cut(d1, uni[w]) / whole if w in uni else unknown
        seen, dn = grams[len(h) + 1].get(h), d[len(h) + 1]
        if not seen:
            return p(h[1:], w)
        size = sum(seen.values()) + (0 if any(c <= 5 for c in seen.values()) else 1)
        if w in seen:
            return cut(dn, seen[w]) / size
        return (1 - sum(cut(dn, c) for c in seen.values()) / size) / (1 - sum(p(h[1:], x) for x in seen)) * p(h[1:], w)

    score = {}
    for i, s in seqs.items():
        padded = [end] * (order - 1) + s
        score[i] = sum(math.log10(p(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(s))
    base = {i: (sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in s), sum(w in uni for w in s)) for i, s in seqs.items()}
    return score, base, total, p, list(uni), seqs, grams, unseen


@pytest.mark.parametrize("order", [2, 3])
def test_katz_equals_a_dictionary_version_and_is_normalised(spark, make_docs, monkeypatch, order):
    monkeypatch.setattr(katz.Katz, "shard_tokens", 300)
    monkeypatch.setattr(ngrams, "PART_GRAMS", 60)
    docs = random_docs(120)
    train = lambda d: zlib.crc32(str(d).encode()) % 5 != 1
    score, base, total, p, vocab, seqs, grams, unseen = plain_katz(docs, train, order)
    got = {r.doc_id: r for r in katz.katz_scores(make_docs(docs), held_out() != 1, order=order).collect()}
    assert len(got) == len(docs)
    for d, _ in docs:
        # shards send their shares of a score in single precision
        assert got[d].score == pytest.approx(score[d], rel=1e-6) and got[d].n_tokens == len(seqs[d]) and got[d].held_out == (not train(d))
        assert got[d].base_score == pytest.approx(base[d][0], rel=1e-9) and got[d].n_known == base[d][1] and got[d].train_tokens == total
    for h in [*list(grams[order])[:20], ("never", "seen")[: order - 1]]:
        assert sum(p(h, w) for w in vocab) + unseen * p(h, "unknown word") == pytest.approx(1)


def test_katz_keeps_its_counts_as_a_table(spark, make_docs, monkeypatch):
    """Every triple is in one shard; those of frequent homes are in several."""
    monkeypatch.setattr(katz.Katz, "shard_tokens", 200)
    scratch = Scratch(spark, "test-katz")
    docs = random_docs(60)
    katz.katz_scores(make_docs(docs), F.lit(True), scratch).collect()
    stored = spark.read.parquet(f"{scratch.root}/sums").where("kind = 'model'").collect()
    *_, grams, _ = plain_katz(docs, lambda d: True, 3)
    assert sum(int(unpack_small(bytes(r.blob))[5].sum()) for r in stored) == sum(sum(c.values()) for c in grams[3].values())
    assert sum(len(unpack_small(bytes(r.blob))[5]) for r in stored) == sum(map(len, grams[3].values()))
    homes = Counter(key for r in stored for key in np.cumsum(unpack_small(bytes(r.blob))[0], dtype=np.uint64).tolist())
    assert len({r.shard for r in stored}) > 3 and sum(n > 1 for n in homes.values()) >= 2


def test_katz_odd_rows(spark, make_docs, odd_rows):
    rows = katz.katz_scores(make_docs(odd_rows), held_out() != 1).collect()
    assert len(rows) == len(odd_rows) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert next(r for r in rows if r.doc_id == 2).n_tokens == 1
    assert katz.katz_scores(make_docs([]), held_out() != 1).collect() == []
    nothing = katz.katz_scores(make_docs(odd_rows), F.lit(False)).collect()
    assert all(r.score == 0 and r.n_known == 0 for r in nothing)


def plain_rules(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    bad = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), bad


def test_rules_equal_a_plain_version(spark, make_docs, odd_rows):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "a b c ", "\n", "x\n", "##", "é ", "\t"]) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    rows = [(k, t, rng.choice(["en", "de", None]), None) for k, t in enumerate(texts)] + [(100 + k, *r[1:]) for k, r in enumerate(odd_rows)]
    got = {r.doc_id: r for r in perplexity.quality_rules(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(t), d
        assert not (r.base_failed and r.kept)
    assert perplexity.quality_rules(make_docs([])).collect() == []


def plain_kneser_ney(texts):
    """Dictionary version: a model of texts, as a function of a pair."""
    pairs = Counter()
    for t in texts:
        s = ["\0end", *WORD.findall(lower(t)), "\0end"]
        pairs.update(zip(s, s[1:], strict=False))
    before, after = defaultdict(set), defaultdict(Counter)
    for (h, w), c in pairs.items():
        before[w].add(h)
        after[h][w] = c
    cont = {w: len(x) for w, x in before.items()}
    few = lambda counts: np.array([sum(c == r for c in counts) for r in range(1, 5)], float)
    d1, d2 = perplexity.discounts(few(cont.values())), perplexity.discounts(few(pairs.values()))
    total = sum(cont.values())

    def lower_p(w):
        left = sum(d1[min(c, 3)] for c in cont.values()) / total
        return (cont.get(w, 0) - d1[min(cont.get(w, 0), 3)]) / total + left / (len(cont) + 1)

    def p(h, w):
        if not total:
            return 1.0
        seen = after.get(h)
        if not seen:
            return lower_p(w)
        size, c = sum(seen.values()), seen.get(w, 0)
        return (c - d2[min(c, 3)] + sum(d2[min(x, 3)] for x in seen.values()) * lower_p(w)) / size

    return p, cont


def test_kneser_ney_and_its_bands_equal_a_plain_version(spark, make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(perplexity.KneserNey, "shard_tokens", 500)
    monkeypatch.setattr(ngrams, "PART_GRAMS", 90)
    rng = random.Random(12)
    rows = [(d, t if rng.random() < 0.9 else " ".join(f"z{rng.randint(0, 10**6)}" for _ in range(70)), rng.choice(["en", "de"]), None) for d, t in random_docs(150, seed=5, words=120)]
    rows += [(1000 + k, *r[1:]) for k, r in enumerate(odd_rows)] + [(2000, "only one of its language " * 3, "eo", None)]
    half = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        half[d] = int(perplexity.KneserNey().halves(w, *w.encode())[0])
    assert 0.3 < np.mean(list(half.values())) < 0.7
    want = {}
    for lang in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == lang]
        models = [plain_kneser_ney([t for d, t, *_ in mine if half[d] == f])[0] for f in (0, 1)]
        for d, t, *_ in mine:
            s = ["\0end", *WORD.findall(lower(t)), "\0end"]
            want[d] = sum(-math.log(models[1 - half[d]](a, b)) for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1)
    got = {r.doc_id: r for r in perplexity.quality_rules(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for d, t, lang, _ in rows:
        assert got[d].log_perplexity == pytest.approx(want[d], rel=1e-5, abs=1e-9)  # shards send sums in single precision
    for lang in {r[2] for r in rows}:
        good = sorted(want[d] for d, t, g, _ in rows if g == lang and not plain_rules(t)[-1])
        if not good:
            continue
        middle = lambda x: sorted(x)[(len(x) - 1) // 2]
        centre = middle(good)
        spread = 1.4826 * middle([abs(x - centre) for x in good])
        for d, t, g, _ in rows:
            if g == lang:
                inside = centre - perplexity.LOWER_WIDTH * spread - 1e-5 <= want[d] <= centre + perplexity.UPPER_WIDTH * spread + 1e-5
                assert got[d].kept == (not plain_rules(t)[-1] and inside), d


def test_kneser_ney_is_normalised():
    p, cont = plain_kneser_ney(t for _, t in random_docs(60))
    for h in ["w1", "w2", "\0end", "never"]:
        assert sum(p(h, w) for w in [*cont, "unknown"]) == pytest.approx(1)


def test_bands_on_labels(spark):
    rows = perplexity.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    share = {r.quality: r.kept for r in rows.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.95 and share[0] < 0.7


def test_copies_are_in_one_half():
    text = " ".join(f"w{k}" for k in range(300)).encode()
    of = lambda raw: int(perplexity.KneserNey().halves(w := Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), *w.encode())[0])
    assert of(text) == of(text.upper())
    assert np.mean([of(text) == of(text.replace(f"w{k} ".encode(), b"x ", 1)) for k in range(0, 290, 10)]) > 0.9


def test_bpe_equals_the_tokenizers_library(spark, make_docs, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, source = Tokenizer.from_file(path), open(path, "rb").read()
    rng = random.Random(4)
    pieces = ["a", "Hello", " ", "\n", "'s", "'RE", "<|endoftext|>", "<|startoftext|>", "é", "é", "Σας", "İ", "½", "12", "\x1c", "\x85", "日本", "😀", "!!", "　"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for k in range(300)] + [(1000 + k, r[1]) for k, r in enumerate(odd_rows)]
    got = {r.doc_id: r for r in bpe.bpe_encode(make_docs(rows), path).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert bpe.load(source).n_ids(t or "") == len(ids)
        assert bytes(got[d].ids) == struct.pack(f"<{len(ids)}I", *ids) and got[d].decoded == theirs.decode(ids, skip_special_tokens=False)
    told = bpe.digests(bpe.bpe_encode(make_docs([(1, None)]), path)).first()
    assert told.n_tokens == 0 and told.ids_sha256 == told.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.bpe_encode(make_docs([]), path).collect() == []


def test_bpe_refuses_other_kinds_of_files():
    import public_tokenizers

    with pytest.raises(ValueError, match="another"):
        bpe.Bpe(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|turn|>", "<|end|>", "\\", "<", "\\l", "\n", "hello ", "é😀", "### Assistant: </turn>"]
    rows, want = [], {}
    for conv in [*range(40), None]:
        turns = [("system", "be brief")] if rng.random() < 0.5 else []
        turns += [(rng.choice(["user", "assistant", "tool", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 200)))])) for _ in range(rng.randint(1, 9))]
        rows += [(conv, k, r, t, "x") for k, (r, t) in enumerate(turns)]
        want[conv] = turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    for block in (4096, 3):
        windows = chat.format_windows(df, budget=120, history=40, block=block)
        got = {r.conv_id: r for r in chat.in_order(windows).mapInArrow(chat.read_windows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long").collect()}
        for conv, turns in want.items():
            loss = "".join(t or "" for r, t in turns if r == "assistant")
            said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
            assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        for w in windows.collect():
            parts = list(chat._TURN.finditer(w.formatted))
            own = len(parts) - w.repeated
            assert own >= 1 and "".join(m[0] for m in parts) == w.formatted
            assert chat.quarter(w.formatted) <= 120 or (own == 1 and w.repeated <= 1)
            if want[w.conv_id][0][0] == "system":
                assert (chat.unescape(parts[0][1]), chat.unescape(parts[0][2])) == ("system", "be brief")
    assert chat.format_windows(df.limit(0)).collect() == []


def plain_vectors(docs):
    """Each text's vector, from word vectors of all texts, by dictionaries."""
    bits = 36
    key = lambda w: xxhash.xxh64_intdigest(w.encode()) >> (64 - bits)
    own = {}
    for _, t in docs:
        for w in WORD.findall(t or ""):
            if w not in own:
                place, sign = classifier.index_vectors(np.array([key(w)], np.uint64))
                own[w] = np.zeros(classifier.DIM)
                np.add.at(own[w], place[0], sign[0])
    sums, count = defaultdict(lambda: np.zeros(classifier.DIM)), Counter()
    for _, t in docs:
        words = WORD.findall(t or "")
        count.update(words)
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    sums[w] += own[words[j]]
    vector = {}
    for w, o in own.items():
        v = sums[w] / count[w] + o
        vector[w] = np.rint(v / max(np.linalg.norm(v), 1e-9) * 127) / 127
    out = {}
    for d, t in docs:
        words = WORD.findall(t or "")
        out[d] = sum((vector[w] for w in words), np.zeros(classifier.DIM)) / max(1, len(words))
    return out


def test_classifier_equals_a_plain_version(spark, make_docs, monkeypatch, odd_rows):
    monkeypatch.setattr(classifier, "SHARD_BYTES", 2000)
    monkeypatch.setattr(classifier, "PIECE", 50)
    rng = random.Random(21)
    docs = random_docs(120, seed=9, words=60)
    docs = [(d, t if d % 3 else " ".join(f"q{rng.randint(0, 300)}" for _ in range(30))) for d, t in docs] + [(500 + k, r[1]) for k, r in enumerate(odd_rows)]
    labels = spark.createDataFrame([(d, int(d % 3 > 0)) for d, _ in docs if d < 500] + [(9999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in classifier.classify(make_docs(docs), labels, held_out() != 0).collect()}
    want = plain_vectors(docs)
    taught = [r.doc_id for r in labels.where(held_out() != 0).where("doc_id < 500").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    net = classifier.Network(np.stack([want[d] for d in taught]), np.array([float(d % 3 > 0) for d in taught]))
    assert set(got) == {d for d, _ in docs}
    for d in got:
        assert got[d] == pytest.approx(float(net.score(want[d][None])[0]), abs=0.02), d
    assert np.mean([(got[d] >= 0.5) == (d % 3 > 0) for d, t in docs if d < 500 and t]) > 0.9


def test_windows_by_prefix_sums():
    rng = random.Random(3)
    for _ in range(300):
        costs = [rng.randint(1, 40) for _ in range(rng.randint(0, 25))]
        room, history = rng.choice([20, 50, 90]), rng.choice([0, 10, 30])
        at, want = 0, []
        while at < len(costs):
            back = at
            while back > 0 and sum(costs[back - 1 : at]) <= min(history, room - costs[at]):
                back -= 1
            end = at + 1
            while end < len(costs) and sum(costs[back : end + 1]) <= room:
                end += 1
            want.append((back, at, end))
            at = end
        assert list(chat.plan(np.array(costs, np.int64), room, history)) == want


def test_a_long_system_turn_and_a_long_conversation_keep_the_budget(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(chat, "HELD_CHARS", 3000)
    rows = [(1, 0, "system", "rule " * 4000)] + [(1, k, "user" if k % 2 else "assistant", f"turn {k} says so") for k in range(1, 61)]
    rows += [(2, k, "assistant", "words and more words " * (1 + k % 9)) for k in range(500)] + [(3, 0, "system", "be kind")] + [(3, 0, "system", "be kind")] + [(3, None, "user", "early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    count = bpe.Bpe(open(path, "rb").read()).n_ids
    rows += [(4, 0, "system", "keep to this rule " * 25)] + [(4, k, "user" if k % 2 else "assistant", "short words") for k in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for vocabulary, tokens in ((path, count), (None, chat.quarter)):
        windows = chat.format_windows(df, vocabulary=vocabulary, block=100).collect()
        for w in windows:
            assert tokens(w.formatted) <= chat.BUDGET or len(list(chat._TURN.finditer(w.formatted))) == 1
        first = sorted((w for w in windows if w.conv_id == 1), key=lambda w: w.window)
        assert [w.formatted.startswith("<|turn|>system<|body|>rule") for w in first] == [True] + [False] * (len(first) - 1)  # alone over the budget
        assert all(w.formatted.startswith("<|turn|>system<|body|>" + "keep to this rule " * 25 + "<|end|>") for w in windows if w.conv_id == 4)
        got = {r.conv_id: r.n_turns for r in chat.in_order(chat.format_windows(df, vocabulary=vocabulary, block=100)).mapInArrow(chat.read_windows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long").collect()}
        assert got == {1: 61, 2: 500, 3: 3, 4: 40}


@pytest.mark.parametrize("block", [2, 7, 20])
def test_history_goes_over_the_edges_of_blocks(spark, block):
    rows = [(1, 10_000 * k, "system" if not k else "user", f"t{k:02d} " + "x" * (k % 13)) for k in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = 0
    for w in chat.in_order(chat.format_windows(df, budget=100, history=30, block=block)).collect():
        said = [int(m[2][1:3]) for m in chat._TURN.finditer(w.formatted)]
        own, repeated = said[w.repeated :], said[: w.repeated]
        assert own[0] == seen and own == list(range(seen, seen + len(own)))
        seen += len(own)
        if own[0]:
            cost = lambda k: chat.quarter(chat.framed("user", rows[k][3]))
            before = [k for k in range(1, own[0]) if sum(map(cost, range(k, own[0]))) <= 30]
            assert repeated == [0, *before] and (before or own[0] == 1)
    assert seen == 60


def test_classifier_on_labels_held_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = classifier.classify(docs, labels, held_out() != 0).where(held_out() == 0).join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert sum(r.predicted for r in rows if r.quality) / sum(r.quality for r in rows) > 0.97
    junk = [r.score for r in rows if not r.quality]
    assert np.mean([a.score > b for a in rows if a.quality for b in junk]) > 0.9


def test_classifier_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = classifier.classify(docs, labels, F.lit(True)).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in classifier.classify(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert classifier.classify(make_docs([]), labels, F.lit(True)).collect() == []


def plain_secrets(t):
    t = t or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_secrets_equal_the_patterns(spark, make_docs, odd_rows):
    rng = random.Random(8)
    bits = ["password=", "TOKEN : '", "api_key=", "ſecret=", "Kpasswd:", "abc123", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef01234567", " ", "é", "\n", "=", "deadbeef"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(300)] + [(1000 + k, r[1]) for k, r in enumerate(odd_rows)]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        base = [(s["kind"], s["begin"], s["end"]) for s in got[d] if s["kind"] != "network"]
        assert base == plain_secrets(t), d
        for s in got[d]:
            assert 0 <= s["begin"] < s["end"] <= len(t or "")
    assert secrets.scan_secrets(make_docs([])).collect() == []


def test_network_tells_keys_from_numbers():
    rng = random.Random(9)
    key = lambda: "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(40))
    number = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    texts = [("and token = ", key(), " the", 1) if k % 2 else ("call me at ", number(), " now", 0) for k in range(400)]
    codes = secrets._codes([secrets.classes(a + v + b, len(a), len(a + v)) for a, v, b, _ in texts])
    labels = np.array([y for *_, y in texts])
    net = secrets.CharNet(codes[:300], labels[:300])
    assert ((net.score(codes[300:]) >= net.threshold) == labels[300:]).mean() > 0.97


def test_threshold_is_of_all_findings_not_fitted_on(spark, make_docs):
    """A small sample, and a table whose secrets look like numbers as often as not."""
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(40))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"and token = {key() if k % 10 else number(16)} the" if k % 2 else f"call me at {number(16)} now" for k in range(600)]
    scratch = Scratch(spark, "test-threshold")
    rows = make_docs(list(enumerate(texts))).select("doc_id", "text")
    found = scratch.write(rows.mapInArrow(secrets.find, secrets.FOUND_SQL), "found")
    net = secrets.train(found, scratch, sample=24)
    blobs = [c.classes for r in found.collect() for c in r.candidates if any(c.labels)] + [b for r in found.collect() if r.holder for b in secrets.taught(r.holder, [tuple(x) for x in r.base])]
    unseen = [secrets._windows(bytes(b)) for b in blobs]
    unseen = [w for w in unseen if not any(x in net.fitted for x in w)]
    assert len(unseen) > 1500
    scores = np.sort([net.score(secrets._codes(w)).max() for w in unseen])
    assert net.threshold == pytest.approx(min(0.5, scores[int(0.02 * len(scores))]), rel=1e-9)
    for values in ([0.0, 1e-300, 0.5, 0.5, 1.0], list(rng.random() for _ in range(500)), [0.25]):
        bits = spark.createDataFrame([(int(np.float64(v).view(np.int64)),) for v in values], "bits long")
        for recall in (0.98, 0.75, 0.5):
            assert secrets.lowest_kept(bits, recall) == sorted(values)[int((1 - recall) * len(values))]
    assert secrets.lowest_kept(bits.limit(0), 0.98) is None


def test_long_and_letter_only_candidates_are_read_whole(spark, make_docs):
    """At a threshold of 0.5, a key at the end of a long path is reported; the same path without it is not."""
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(40))
    number = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    path = "/".join(["docs", "page", "list", "of", "items", "in", "the", "part", "number", "7"] * 3)
    rows = [(k, f"and token = {key()} the" if k % 2 else f"call me at {number()} now" if k % 4 else f"see {path} now") for k in range(600)]
    rows += [(1000, f"see {path}/{key()} now"), (1001, f"see {path} now")]
    scratch = Scratch(spark, "test-windows")
    found = scratch.write(make_docs(rows).select("doc_id", "text").mapInArrow(secrets.find, secrets.FOUND_SQL), "found")
    net = secrets.train(found, scratch)
    net.threshold = 0.5
    judged = found.mapInArrow(secrets.judge(net), f"doc_id long, spans {secrets._SPANS_SQL}").where("doc_id >= 1000").collect()
    assert {r.doc_id: [(s["kind"], s["begin"], s["end"]) for s in r.spans] for r in judged} == {1000: [("network", 4, 4 + len(path) + 41)], 1001: []}
    text = "a " + "xy" * 60 + "." + "Z" * 7 + " b"
    seen = [w[secrets.SIDE : secrets.SIDE + secrets.VALUE] for w in secrets._windows(secrets.classes(text, 2, len(text) - 2))]
    assert b"Z" * 7 in seen[-1] and len(seen) == len(secrets.window_starts(2, len(text) - 2)) and all(len(w) == secrets.VALUE for w in seen)
    rows = [(1, "x " + "q" * 16 + " y"), (2, "x " + "q" * 15 + " y"), (3, "x ab1cde y"), (4, "x ab1cd y")]
    found = make_docs(rows).select("doc_id", "text").mapInArrow(secrets.find, secrets.FOUND_SQL).collect()
    assert {r.doc_id: [(c.begin, c.end) for c in r.candidates] for r in found} == {1: [(2, 18)], 2: [], 3: [(2, 8)], 4: []}


def test_network_finds_secrets_that_no_pattern_does(spark, make_docs):
    """Keys of other forms and without a name, planted into texts, against everything else that looks like one."""
    rng = random.Random(31)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = lambda n, of=alphabet: "".join(rng.choice(of) for _ in range(n))
    keys = [lambda: "gh_" + made(36), lambda: made(40), lambda: made(32, "0123456789ABCDEF"), lambda: "-".join(made(5, alphabet[:26] + "0123456789") for _ in range(5)), lambda: made(43) + "="]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text is not null and doc_id % 4 = 0").collect()
    rows, planted = [], {}
    for r in docs:
        text = r.text
        if r.doc_id % 160 == 0 and " " in text and not plain_secrets(text):
            key, at = rng.choice(keys)(), text.index(" ", len(text) // 3) + 1 if " " in text[len(text) // 3 :] else text.index(" ") + 1
            text = f"{text[:at]}{key} {text[at:]}"
            planted[r.doc_id] = (at, at + len(key))
        rows.append((r.doc_id, text))
    assert len(planted) > 50
    hit, wrong, clean = 0, 0, 0
    for r in secrets.scan_secrets(make_docs(rows)).collect():
        found = [s for s in r.spans if s["kind"] == "network"]
        if r.doc_id in planted:
            a, b = planted[r.doc_id]
            hit += any(s["begin"] < b and a < s["end"] for s in found)
        else:
            clean += 1
            wrong += bool(found)
    assert hit >= 0.9 * len(planted), hit / len(planted)
    assert wrong <= 0.02 * clean, wrong / clean


def test_texts_with_very_many_secrets(spark, make_docs):
    """Twice the keys take about twice the time, spans are found by place as by a look at each, and samples are those of all windows."""
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    dump = "\n".join(f"token = {key(32)} at {rng.choice(['home', 'work', 'night'])} no {rng.randrange(10**7)}" for _ in range(20_000))
    spans = secrets.base_spans(dump)
    places = secrets.Places(spans + [("hex", e - 32, e) for _, _, e in spans])
    both = spans + [("hex", e - 32, e) for _, _, e in spans]
    for _ in range(40):
        a = rng.randrange(len(dump))
        b = a + rng.randrange(1, 400)
        assert sorted(places.touching(a, b)) == sorted((s, e) for _, s, e in both if s < b and a < e)
        assert places.free(a, b) == all(e < a or b < s for _, s, e in both)
        starts = secrets.window_starts(a, b)
        assert secrets.window_labels(places, a, b) == bytes(int(any(s < min(t + secrets.VALUE, b) and t < e for _, s, e in both)) for t in starts.tolist())
    took = []
    for n in (500, 4_000):
        begin = time.perf_counter()
        for _ in secrets.taught(dump, spans[:n]):
            pass
        took.append(time.perf_counter() - begin)
    assert took[1] < 20 * took[0], took
    rows = [(k, f"see password: {key(20)} and {rng.randrange(10**9)}") for k in range(50)] + [(99, dump)]
    found = make_docs(rows).select("doc_id", "text").mapInArrow(secrets.find, secrets.FOUND_SQL)
    size = found.where("doc_id = 99").select(F.size("base").alias("n")).first().n
    assert size == 40_000
    few = Scratch(spark, "test-many").write(make_docs(rows[:50]).select("doc_id", "text").mapInArrow(secrets.find, secrets.FOUND_SQL), "found")
    got = few.select("candidates", "base", "holder").mapInArrow(secrets.windows(30), "label int, classes binary").distinct()
    for label in (0, 1):
        every = {w for r in few.collect() for c in r.candidates for w, y in zip(secrets._windows(bytes(c.classes)), c.labels, strict=True) if y == label}
        if label:
            every |= {w for r in few.collect() for b in secrets.taught(r.holder, [tuple(x) for x in r.base]) for w in secrets._windows(b)}
        want = spark.createDataFrame([(w,) for w in every], "classes binary").orderBy(F.xxhash64("classes"), "classes").limit(30).collect()
        mine = got.where(F.col("label") == label).orderBy(F.xxhash64("classes"), "classes").limit(30).collect()
        assert [bytes(r.classes) for r in mine] == [bytes(r.classes) for r in want] and len(want) == 30
    marked = secrets.redacted(dump, [{"begin": s, "end": e} for _, s, e in spans], "*")
    assert marked.startswith("* at ") and marked.count("*") == 20_000 and "token" not in marked


def test_redaction(spark):
    df = spark.createDataFrame([("é token=abcdef x", [("assign", 2, 14), ("hex", 8, 14)]), ("plain", [])], "text string, spans array<struct<kind:string,begin:long,end:long>>")
    assert [r.t for r in df.select(secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()] == ["é [secret] x", "plain"]
    odd = spark.createDataFrame([(None, []), ("a", None), ("ab cd ef gh", [("hex", 0, 5), ("assign", 1, 2), ("hex", 4, 8)])], df.schema)
    assert [r.t for r in odd.select(secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()] == [None, None, "[secret] gh"]
