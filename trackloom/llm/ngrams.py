"""Word n-gram models of a whole corpus, counted and evaluated in shards.

Every slice of texts is turned into its distinct n-grams with the texts that
hold them, sorted by hash and packed, one message for each shard; an n-gram's
shard is that of its home, the middle word of triples and the first of pairs.
A shard so has all that the contexts around that word need: totals, discounted
mass, backoff weights. What belongs to the last word alone, over all shards, is
added up in a second, smaller exchange, which also sums the counts of counts.
N-grams of frequent homes are dealt over several shards by their other end; what
these need of each other comes back by the same exchange.
With these each shard gives every n-gram its probability and adds logarithms up
for each text; a text's sums meet at last. Texts and tokens travel once, and
nothing that grows with the corpus comes to the driver or is broadcast.

Sums are the same at every number of shards, but for the last bits of doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK64, Scratch, Words, bounded_batches, deltas, hashes, mix, pack, pack_small, release, text_slices, unpack, unpack_small

#: N-grams of one part of a shard; share of a step's tokens from which a word is looked at as a home of many.
PART_GRAMS, SHARE = 300_000, 2000
#: The hash of the end of a text, which also stands before its first word.
END = int(hashes([b""])[0])

MESSAGE = "kind string, shard int, batch_id long, grp string, blob binary"
_MESSAGE = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("batch_id", pa.int64()), ("grp", pa.string()), ("blob", pa.binary())])
_UP = pa.schema([("dest", pa.int32()), ("shard", pa.int32()), ("grp", pa.string()), ("keys", pa.binary()), ("stats", pa.binary())])
_DOWN = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("dest", pa.int32()), ("grp", pa.string()), ("blob", pa.binary())])
_OUT = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("batch_id", pa.int64()), ("grp", pa.string()), ("blob", pa.binary())])


def _sql(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _starts(new: np.ndarray) -> np.ndarray:
    return np.flatnonzero(new)


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


class Hot:
    """Frequent homes, by rising key, and over how many shards each is dealt."""

    def __init__(self, keys: np.ndarray = (), parts: np.ndarray = ()):
        order = np.argsort(np.asarray(keys, np.uint64))
        self.keys, self.parts = np.asarray(keys, np.uint64)[order], np.asarray(parts, np.uint64)[order]

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the frequent ones, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1).astype(np.int32)


def gram_messages(keys: np.ndarray, code: np.ndarray, lens: np.ndarray, folds: np.ndarray, order: int, shards: int, hot: Hot | None = None) -> Iterator[tuple[int, bytes]]:
    """Messages (shard, blob) with the n-grams of texts given as codes into word hashes.

    ``keys`` holds the distinct hashes, that of END last; ``lens`` counts each
    text's tokens, its END included; ``folds`` is a small number for each text.
    """
    rank_order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[rank_order] = np.arange(len(keys))
    size = np.uint64(len(keys))
    word = rank[code].astype(np.uint32)
    end, begin = np.uint32(rank[-1]), np.cumsum(lens) - lens
    back = [word]
    for _ in range(1, order):
        past = np.empty_like(word)
        past[1:] = back[-1][:-1]
        past[begin] = end
        back.append(past)
    home, hash_of = back[1] if order > 1 else word, keys[rank_order]
    shard = (mix(hash_of) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.uint32)[home]
    frequent = (hot or Hot()).find(hash_of)
    if (frequent >= 0).any():
        at = np.flatnonzero(frequent[home] >= 0)
        other = hash_of[back[2][at] if order == 3 else word[at]]
        part = mix(other + np.uint64(1)) % hot.parts[frequent[home[at]]]
        shard[at] = mix(hash_of[home[at]] + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)
    pair = home * size + word
    if order == 3:
        if len(keys) >= 1 << 21:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        pair *= size
        pair += back[2]
    by = np.argsort(pair, kind="stable")
    by = by[np.argsort(shard[by], kind="stable")]
    gram = _changes(pair[by])
    del pair
    doc = np.repeat(np.arange(len(lens), dtype=np.uint32), lens)[by]
    entry = _starts(gram | _changes(doc))
    times = np.diff(np.append(entry, len(doc)))
    doc = doc[entry]
    first = _starts(gram)
    del gram
    held = np.diff(np.append(np.searchsorted(entry, first), len(entry)))
    first = by[first]
    del by, entry
    word, home, third, shard = word[first], home[first], back[-1][first], shard[first]
    del back, first
    edges = np.searchsorted(shard, np.arange(shards + 1))
    at = np.append(0, np.cumsum(held))
    for s in range(shards):
        lo, hi = edges[s], edges[s + 1]
        if lo == hi:
            continue
        w, h = word[lo:hi], home[lo:hi]
        arrays = []
        if order == 3:
            two = _starts(_changes(h) | _changes(w))
            arrays += [np.diff(np.append(two, hi - lo)), *_coded(third[lo:hi], hash_of)]
            w, h = w[two], h[two]
        of = _starts(_changes(h)) if order > 1 else np.arange(len(h))
        arrays += [deltas(hash_of[h[of]]), np.diff(np.append(of, len(h)))]
        if order > 1:
            arrays += _coded(w, hash_of)
        cut = slice(at[lo], at[hi])
        yield s, pack_small(held[lo:hi], doc[cut], times[cut], folds, *arrays)


def _coded(ranks: np.ndarray, hash_of: np.ndarray) -> list[np.ndarray]:
    """A dictionary of the hashes, sorted, and each rank's place in it."""
    uniq, place = np.unique(ranks, return_inverse=True)
    return [deltas(hash_of[uniq]), place]


def _small(found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and places, the places in 32 bits."""
    return found[0], found[1].astype(np.int32)


class Messages:
    """A shard's messages, unpacked; they are worked on in parts, ranges of home hashes of about PART_GRAMS n-grams."""

    def __init__(self, messages: list[tuple[int, bytes]], order: int, hot: Hot):
        self.items, self.order, self.hot = [], order, hot
        for who, blob in messages:
            held, doc, times, folds, *rest = unpack_small(blob)
            thirds, third_at, third_of = np.ones(0, np.uint8), None, None
            if order == 3:
                thirds, third_step, third_at, *rest = rest
                third_of = np.cumsum(third_step, dtype=np.uint64)
            home_step, homes, word_step, word_at = rest
            self.items.append((who, held, doc, times, folds, thirds, third_of, third_at, np.cumsum(home_step, dtype=np.uint64), homes, np.cumsum(word_step, dtype=np.uint64), word_at))
        self.words = np.unique(np.concatenate([i[10] for i in self.items]))
        self.texts = {i[0]: len(i[4]) for i in self.items}

    def _edges(self) -> np.ndarray:
        """Home hashes at which parts begin."""
        keys = np.concatenate([i[8] for i in self.items])
        weight = np.concatenate([np.add.reduceat(i[5], np.append(0, np.cumsum(i[9], dtype=np.int64))[:-1], dtype=np.int64) if self.order == 3 else i[9] for i in self.items])
        by = np.argsort(keys)
        before = np.cumsum(weight[by], dtype=np.int64)
        parts = max(1, int(before[-1]) // PART_GRAMS)
        return np.unique(keys[by[np.searchsorted(before, before[-1] * np.arange(1, parts) // parts)]])

    def parts(self) -> Iterator[Shard]:
        edges = self._edges()
        cuts = []
        for _, held, _, _, _, thirds, _, _, home, homes, _, _ in self.items:
            at = np.concatenate([[0], np.searchsorted(home, edges), [len(home)]])
            pair = np.append(0, np.cumsum(homes, dtype=np.int64))[at]
            gram = np.append(0, np.cumsum(thirds, dtype=np.int64))[pair] if self.order == 3 else pair
            cuts.append((at, pair, gram, np.append(0, np.cumsum(held, dtype=np.int64))[gram]))
        for k in range(len(edges) + 1):
            yield Shard(list(self._cut(k, cuts)), self.order, self.hot)

    def _cut(self, k: int, cuts: list) -> Iterator[tuple]:
        for (who, held, doc, times, folds, thirds, third_of, third_at, home, homes, word_of, word_at), cut in zip(self.items, cuts, strict=True):
            h, p, g, e = (slice(c[k], c[k + 1]) for c in cut)
            if g.start == g.stop:
                continue
            first, second = np.repeat(home[h], homes[h].astype(np.int64)), word_of[word_at[p].astype(np.int64)]
            third = None
            if self.order == 3:
                many = thirds[p].astype(np.int64)
                first, second, third = np.repeat(first, many), np.repeat(second, many), third_of[third_at[g].astype(np.int64)]
            yield first, second, third, (who, held[g], doc[e], times[e], folds)


class Shard:
    """The n-grams of one part of a shard: distinct ones, their contexts, and who holds them.

    For pairs (home, word) and triples (third, home, word), in text order third,
    home, word. ``gram`` gives each message entry its distinct n-gram.
    """

    def __init__(self, parts: list[tuple], order: int, hot: Hot):
        self.batches = [p[3] for p in parts]
        sizes = [len(p[0]) for p in parts]
        thirds_all = [p[2] for p in parts] if order == 3 else []
        self.homes, home = _small(np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True))
        self.words, word = _small(np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True))
        del parts
        pair_key, gram = _small(np.unique(home * np.int64(len(self.words)) + word, return_inverse=True))
        del home, word
        self.pair_home, self.pair_word = (pair_key // len(self.words)).astype(np.int32), (pair_key % len(self.words)).astype(np.int32)
        #: Place of each home among the frequent ones, or -1.
        self.hot = hot.find(self.homes)
        self.gram_pair = np.arange(len(pair_key), dtype=np.int32)
        if order == 3:
            thirds, third = _small(np.unique(np.concatenate(thirds_all), return_inverse=True))
            del thirds_all
            key, gram = _small(np.unique(gram * np.int64(len(thirds)) + third, return_inverse=True))
            del third
            self.gram_pair = (key // len(thirds)).astype(np.int32)
            self.thirds = thirds[key % len(thirds)]
            context = (key % len(thirds)) * len(self.homes) + self.pair_home[self.gram_pair]
            self.gram_context = _small(np.unique(context, return_inverse=True))[1]
        self.gram = np.split(gram, np.cumsum(sizes)[:-1])
        self.n_grams = len(self.gram_pair)

    def counts(self, fold: int) -> np.ndarray:
        """How often each distinct n-gram stands in texts of a fold."""
        out = np.zeros(self.n_grams)
        for gram, (_, held, doc, times, folds) in zip(self.gram, self.batches, strict=True):
            here = np.append(0, np.cumsum(times * (folds[doc] == fold)))
            ends = np.cumsum(held, dtype=np.int64)
            out += np.bincount(gram, weights=here[ends] - here[ends - held], minlength=self.n_grams)
        return out

    def sums(self, values: list[np.ndarray], of_fold: Callable[[int], int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """For each message's batch the sum of each value over each text's n-grams.

        ``values`` are (columns, n-grams) arrays, one for each model; a text of
        fold f takes those of model ``of_fold(f)``, or of the only one.
        """
        for gram, (who, held, doc, times, folds) in zip(self.gram, self.batches, strict=True):
            entry = np.repeat(gram, held.astype(np.int64))
            out = np.zeros((values[0].shape[0], len(folds)))
            for m, value in enumerate(values):
                mine = np.array([of_fold is None or of_fold(int(f)) == m for f in range(int(folds.max(initial=0)) + 1)])[folds][doc]
                own, of, many = doc[mine], entry[mine], times[mine]
                for c, column in enumerate(value):
                    out[c] += np.bincount(own, weights=column[of] * many, minlength=len(folds))
            yield who, out


def group_sum(by: np.ndarray, size: int, x: np.ndarray) -> np.ndarray:
    return np.bincount(by, weights=x, minlength=size)


class Model:
    """What a smoothing method needs of a shard, and gives; see katz.Katz and perplexity.KneserNey.

    ``order``: words of an n-gram. ``folds``: for each model the fold that it
    counts. ``pairs(shard, counts)``: counts of pairs. ``word_values(shard,
    counts)``: what each word of the shard adds to its total. ``shard_stats(shard,
    counts)`` and ``word_stats(totals)``: vectors that are summed over all shards.

    Frequent homes: their statistics are vectors of ``hot_width`` numbers, summed
    from ``shard_hot(shard, counts)`` where a pair is in one shard, or, where
    ``pairs_meet``, from ``met_hot(home, pairs, words, n)`` once the counts of each
    of their pairs have met, together with the total of its last word.

    ``values(shard, counts, pairs, words, stats, word_stats, hot)``: (columns,
    n-grams), to be summed for each text; ``pairs`` are whole counts.
    """

    hot_width, pairs_meet = 1, False
    order = 2
    #: Bytes of text whose n-grams are counted together, and tokens of a shard at least.
    step_bytes, shard_tokens = 16 << 20, 8_000_000
    folds: tuple[int, ...] = (0,)
    #: The key of END among those of words; set by text_sums.
    end = 0
    #: Type in which a shard sends each of its sums; they meet in doubles.
    precision: tuple[str, ...] = ()
    #: Names of the sums and of ``columns``.
    sums: tuple[str, ...] = ()
    carried: tuple[str, ...] = ()

    def columns(self, words: Words, codes: np.ndarray, dictionary: list[bytes]) -> dict[str, np.ndarray]:
        """Whole numbers of each text that its row carries along, by name."""
        return {}

    def halves(self, words: Words, codes: np.ndarray, dictionary: list[bytes]) -> np.ndarray | None:
        """Folds by content, in place of the rows' own."""
        return None

    def word_values(self, shard: Shard, counts: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def shard_stats(self, shard: Shard, counts: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def word_stats(self, totals: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def pairs(self, shard: Shard, counts: np.ndarray) -> np.ndarray:
        return group_sum(shard.gram_pair, len(shard.pair_home), counts)

    def shard_hot(self, shard: Shard, counts: np.ndarray, n: int) -> np.ndarray:
        return np.zeros((n, self.hot_width))

    def met_hot(self, home: np.ndarray, pairs: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        return np.zeros((n, self.hot_width))

    def values(self, shard: Shard, counts: np.ndarray, pairs: np.ndarray, words: np.ndarray, stats: np.ndarray, word_stats: np.ndarray, hot: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def of_fold(self, fold: int) -> int:
        return 0

    def stored(self, shard: Shard, counts: np.ndarray, values: np.ndarray) -> bytes | None:
        return None


def _send(model: Model, bits: int, labels: np.ndarray, hot: Hot):
    """Map: messages with the n-grams of every slice, and one with its texts' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, step = TaskContext.get().partitionId(), 0
        shift, shards = np.uint64(64 - bits), len(labels)
        for batch in batches:
            ids, folds_all = batch.column("doc_id"), batch.column("fold").to_numpy()
            groups = batch.column("grp").dictionary_encode()
            group_all, names = groups.indices.to_numpy(), groups.dictionary.to_pylist()
            for first, end, data, offsets in text_slices(batch, limit=model.step_bytes):
                words = Words(data, offsets)
                codes, dictionary = words.encode()
                group = group_all[first:end]
                keys = np.append(hashes([w.lower() for w in dictionary]), np.uint64(END & MASK64)) >> shift  # lower() of bytes is that of A to Z
                stream = np.full(len(words) + end - first, len(keys) - 1, np.int32)
                stream[np.arange(len(words)) + words.doc] = codes
                lens = words.per_doc + 1
                more = model.columns(words, codes, dictionary)
                folds = model.halves(words, codes, dictionary)
                folds = folds_all[first:end] if folds is None else folds
                del words, codes, dictionary
                release()
                for g in np.unique(group):
                    docs = np.flatnonzero(group == g)
                    mine = stream[np.repeat(group == g, lens)] if len(names) > 1 else stream
                    # hashes that this group's texts hold, each once, that of END last
                    used = np.flatnonzero(np.bincount(mine, minlength=len(keys)))
                    uniq, found = np.unique(keys[used], return_inverse=True)
                    at = int(np.searchsorted(uniq, keys[-1]))
                    order = np.append(np.delete(np.arange(len(uniq)), at), at)
                    place = np.empty(len(uniq), np.int64)
                    place[order] = np.arange(len(uniq))
                    code = np.zeros(len(keys), np.int32)
                    code[used] = place[found]
                    who = (part << 32) + step
                    step += 1
                    told = pa.BufferOutputStream()
                    table = pa.table({"doc_id": ids.take(pa.array(docs + first)), "fold": folds[docs], "lens": lens[docs], **{k: v[docs] for k, v in more.items()}})
                    with pa.ipc.new_stream(told, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_table(table)
                    rows = [("docs", labels[who % shards], told.getvalue().to_pybytes())]
                    rows += [("grams", labels[s], blob) for s, blob in gram_messages(uniq[order], code[mine], lens[docs], folds[docs], model.order, shards, hot)]
                    n = len(rows)
                    yield pa.RecordBatch.from_pydict(
                        {"kind": [r[0] for r in rows], "shard": [r[1] for r in rows], "batch_id": [who] * n, "grp": [names[g]] * n, "blob": [r[2] for r in rows]}, schema=_MESSAGE
                    )

    return run


def _by_group(table: pa.Table, *columns: str) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for grp, *row in zip(*(table[c].to_pylist() for c in ("grp", *columns)), strict=True):
        out.setdefault(grp, []).append(tuple(row))
    return out


def _dest(words: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The shard that adds up each word's totals."""
    return labels[(mix(words ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(len(labels))).astype(np.int64)]


class Stats:
    """Sums over all shards, one row for each model: of words, of shards, and of frequent homes."""

    def __init__(self, words: np.ndarray, shards: np.ndarray, hot: np.ndarray):
        self.words, self.shards, self.hot = words, shards, hot

    def pack(self) -> bytes:
        return np.concatenate([[self.words.shape[1], self.shards.shape[1]], self.words.ravel(), self.shards.ravel(), self.hot.ravel()]).tobytes()

    @classmethod
    def unpack(cls, blob: bytes, model: Model, n_hot: int) -> Stats:
        x, m = np.frombuffer(blob), len(model.folds)
        w, s = int(x[0]) * m, int(x[1]) * m
        return cls(x[2 : 2 + w].reshape(m, -1), x[2 + w : 2 + w + s].reshape(m, -1), x[2 + w + s :].reshape(m, n_hot, model.hot_width))

    def plus(self, other: Stats) -> Stats:
        add = lambda a, b: a + b if a.size and b.size else a if a.size else b
        return Stats(add(self.words, other.words), add(self.shards, other.shards), self.hot + other.hot)


def _tally(model: Model, labels: np.ndarray, hot: Hot):
    """Group map over a shard: what its words, and pairs of frequent homes, add to their totals, for each word's shard."""

    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pa.compute.equal(table["kind"], "grams"))
        rows: list[tuple] = []
        groups = _by_group(table, "batch_id", "blob")
        for grp in list(groups):
            here = table["shard"][0].as_py()
            held = Messages(sorted(groups.pop(grp)), model.order, hot)
            m, n = len(model.folds), len(hot)
            values, stats = np.zeros((m, len(held.words)), np.int64), []
            frequent = np.zeros((m, n, model.hot_width))
            met: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((m, 0), np.int64)]]
            for shard in held.parts():
                counts = [shard.counts(f) for f in model.folds]
                stats.append(np.stack([model.shard_stats(shard, c) for c in counts]))
                at = np.searchsorted(held.words, shard.words)
                for k, c in enumerate(counts):
                    values[k, at] += model.word_values(shard, c).astype(np.int64)
                    frequent[k] += model.shard_hot(shard, c, n)
                if model.pairs_meet and n:
                    mine = np.flatnonzero(shard.hot[shard.pair_home] >= 0)
                    met.append([shard.hot[shard.pair_home[mine]], at[shard.pair_word[mine]], np.stack([model.pairs(shard, c)[mine] for c in counts]).astype(np.int64)])
            home, word, pairs = (np.concatenate(x, -1) for x in zip(*met, strict=True))
            dest = _dest(held.words, labels)
            for d in np.unique(dest).tolist():
                mine, theirs = dest == d, dest[word] == d
                place = np.cumsum(mine) - 1
                rows.append((d, here, grp, pack_small(deltas(held.words[mine]), *values[:, mine], home[theirs], place[word[theirs]], *pairs[:, theirs]), None))
            rows.append((here, here, grp, None, Stats(np.zeros((m, 0)), sum(stats), frequent).pack()))
            release()
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_UP)], schema=_UP)

    return run


def _total(model: Model, n_hot: int):
    """Group map over a shard of words: totals for every shard that asked, and statistics."""

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        dest, m = table["dest"][0].as_py(), len(model.folds)
        for grp, asked in _by_group(table, "shard", "keys", "stats").items():
            sent = [(a[0], unpack_small(a[1])) for a in sorted(asked, key=lambda a: a[0]) if a[1] is not None]
            told = Stats(np.zeros((m, 0)), np.zeros((m, 0)), np.zeros((m, n_hot, model.hot_width)))
            for a in sorted(asked, key=lambda a: a[0]):
                told = told if a[2] is None else told.plus(Stats.unpack(a[2], model, n_hot))
            keys = [np.cumsum(x[0], dtype=np.uint64) for _, x in sent]
            uniq, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
            whole = lambda by, size, k: np.bincount(by, weights=np.concatenate([np.zeros(0), *(x[k].astype(float) for _, x in sent)]), minlength=size)
            totals = np.stack([whole(place, len(uniq), 1 + k) for k in range(m)])
            # pairs of frequent homes by home and last word
            ends = np.cumsum([0, *map(len, keys)])
            pair = np.concatenate([np.zeros(0, np.int64), *(x[1 + m].astype(np.int64) * max(1, len(uniq)) + place[ends[i] + x[2 + m].astype(np.int64)] for i, (_, x) in enumerate(sent))])
            pairs, at_pair = np.unique(pair, return_inverse=True)
            counts = np.stack([whole(at_pair, len(pairs), 3 + m + k) for k in range(m)])
            done = 0
            for i, (who, x) in enumerate(sent):
                n = len(x[1 + m])
                rows.append(("totals", who, dest, grp, pack_small(*totals[:, place[ends[i] : ends[i + 1]]].astype(np.int64), *counts[:, at_pair[done : done + n]].astype(np.int64))))
                done += n
            home, word = pairs // max(1, len(uniq)), pairs % max(1, len(uniq))
            met = np.stack([model.met_hot(home, counts[k], totals[k][word], n_hot) for k in range(m)])
            told = told.plus(Stats(np.stack([model.word_stats(t) for t in totals]), np.zeros((m, 0)), met))
            rows.append(("stats", None, dest, grp, told.pack()))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_DOWN)], schema=_DOWN)

    return run


def _add_stats(model: Model, n_hot: int):
    """Group map: the statistics of a group, summed over all shards."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["dest"].to_pylist(), table["blob"].to_pylist(), strict=True))
        told = Stats.unpack(rows[0][1], model, n_hot)
        for _, blob in rows[1:]:
            told = told.plus(Stats.unpack(blob, model, n_hot))
        row = ("stats", 0, 0, table["grp"][0].as_py(), told.pack())
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _DOWN, strict=True)], schema=_DOWN)

    return run


def _finish(model: Model, labels: np.ndarray, hot: Hot):
    """Cogroup map over a shard and what came back for it: each text's sums."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        docs = left.filter(pa.compute.equal(left["kind"], "docs"))
        rows += [("docs", s, b, g, x) for s, b, g, x in zip(*(docs[c].to_pylist() for c in ("shard", "batch_id", "grp", "blob")), strict=True)]
        grams = left.filter(pa.compute.equal(left["kind"], "grams"))
        back = _by_group(right, "kind", "dest", "blob")
        groups = _by_group(grams, "batch_id", "blob")
        m = len(model.folds)
        for grp in list(groups):
            here = grams["shard"][0].as_py()
            held = Messages(sorted(groups.pop(grp)), model.order, hot)
            told = back[grp]
            dest = _dest(held.words, labels)
            totals, met, read = np.zeros((m, len(held.words))), {}, {}
            for kind, d, blob in told:
                if kind == "totals":
                    got = unpack_small(blob)
                    totals[:, dest == d] = np.stack(got[:m])
                    met[d], read[d] = np.stack(got[m:]), 0
            stats = Stats.unpack(next(b for kind, _, b in told if kind == "stats"), model, len(hot))
            sums = {who: np.zeros((len(model.sums), texts)) for who, texts in held.texts.items()}
            for shard in held.parts():
                at, values = np.searchsorted(held.words, shard.words), []
                counts = [shard.counts(f) for f in model.folds]
                pairs = np.stack([model.pairs(shard, c) for c in counts])
                if model.pairs_meet and len(hot):  # in the order in which _tally sent them
                    mine = np.flatnonzero(shard.hot[shard.pair_home] >= 0)
                    of = dest[at[shard.pair_word[mine]]]
                    for d in np.unique(of).tolist():
                        those = mine[of == d]
                        pairs[:, those] = met[d][:, read[d] : read[d] + len(those)]
                        read[d] += len(those)
                for k, c in enumerate(counts):
                    values.append(model.values(shard, c, pairs[k], totals[k, at], stats.shards[k], stats.words[k], stats.hot[k]))
                    if kept := model.stored(shard, c, values[-1]):
                        rows.append(("model", here, k, grp, kept))
                for who, part in shard.sums(values, model.of_fold):
                    sums[who] += part
            rows += [("sums", here, who, grp, pack(*(c.astype(f"f{p}").view(f"u{p}") for c, p in zip(x, model.precision, strict=True)))) for who, x in sums.items()]
            release()
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)], schema=_OUT)

    return run


def _assemble(names: tuple[str, ...], carried: tuple[str, ...], precision: tuple[str, ...]):
    """Map: rows of each batch's texts, from its ids and the sums of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = pa.ipc.open_stream(row["docs"]).read_all()
                total = np.zeros((len(names), table.num_rows))
                for part in sorted(row["parts"], key=lambda p: p["shard"]):
                    total += np.stack([c.view(f"f{p}").astype(float) for c, p in zip(unpack(part["blob"]), precision, strict=True)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": table["doc_id"].combine_chunks(), "fold": table["fold"].combine_chunks().cast(pa.int32()), "grp": pa.array([row["grp"]] * table.num_rows, pa.string()), "n_tokens": table["lens"].combine_chunks().cast(pa.int64()),
                        **{name: pa.array(x) for name, x in zip(names, total, strict=True)}, **{name: table[name].combine_chunks().cast(pa.int64()) for name in carried},
                    }
                )

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: counts of words with one of SHARE tokens of a step or more, and without a key all tokens and bytes."""
    found: dict[int, int] = {}
    tokens = size = 0
    for batch in batches:
        for first, end, data, offsets in text_slices(batch, limit=4 << 20):
            words = Words(data, offsets)
            codes, dictionary = words.encode()
            counts = np.bincount(codes, minlength=len(dictionary))
            for k in np.flatnonzero(counts >= max(2, len(codes) // SHARE)).tolist():
                key = hashes([dictionary[k].lower()]).view(np.int64)[0].item()
                found[key] = found.get(key, 0) + int(counts[k])
            at = np.array([END & MASK64], np.uint64).view(np.int64)[0].item()
            found[at] = found.get(at, 0) + end - first
            tokens, size = tokens + len(codes) + end - first, size + len(data)
    rows = [(None, tokens, size), *((k, n, None) for k, n in found.items())]
    yield pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.int64()), "count": pa.array([r[1] for r in rows], pa.int64()), "bytes": pa.array([r[2] for r in rows], pa.int64())})


def even_labels(spark: SparkSession, shards: int) -> np.ndarray:
    """A number for each shard, chosen so that hash partitioning deals one to each partition."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(shards))
    # one row a shard comes to the driver
    rows = spark.range(shards * (30 + 2 * shards.bit_length())).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()
    found = {r["place"]: r["id"] for r in rows}
    return np.array([found.get(k, -1 - k) for k in range(shards)], np.int64)


def text_sums(rows: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """Sums over the n-grams of every text: doc_id, fold, grp, n_tokens (END included) and the model's sums and columns.

    ``rows`` has doc_id (long), text, fold (int) and grp (string, not null); each
    group has a model of its own. Where the model stores its counts, they are a
    table in the shared folder, as the sums are.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    counted = scratch.write(rows.select("text").mapInArrow(_frequent, "key long, count long, bytes long"), "frequent")
    size = counted.where("key is null").agg(F.sum("bytes").alias("bytes"), F.sum("count").alias("tokens")).first()
    bits = min(60, max(36, ceil(log2((size["bytes"] or 0) + 1)) + 8))
    model.end = np.uint64((END & MASK64) >> (64 - bits))
    tokens = max(1, size["tokens"] or 0)
    shards = max(2, -(-tokens // model.shard_tokens), int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    labels = even_labels(spark, shards)
    # homes with half a shard's share of the tokens or more: at most two for each shard
    often = counted.where("key is not null").groupBy("key").agg(F.sum("count").alias("n")).where(F.col("n") * (2 * shards) >= tokens).collect()
    hot = Hot(np.array([r["key"] for r in often], np.int64).view(np.uint64) >> np.uint64(64 - bits), np.array([-(-2 * shards * r["n"] // tokens) for r in often]))
    sent = rows.select("doc_id", "text", "fold", "grp").mapInArrow(_send(model, bits, labels, hot), MESSAGE).repartition(shards, "shard")
    up = sent.groupBy("shard").applyInArrow(_tally(model, labels, hot), _sql(_UP)).repartition(shards, "dest")
    down = up.groupBy("dest").applyInArrow(_total(model, len(hot)), _sql(_DOWN))
    # one row of statistics from each word shard; their sum goes to every shard
    stats = down.where("kind = 'stats'").groupBy("grp").applyInArrow(_add_stats(model, len(hot)), _sql(_DOWN)).withColumn("shard", F.explode(F.array(*map(F.lit, labels.tolist()))))
    back = down.where("kind = 'totals'").unionByName(stats).repartition(shards, "shard")
    done = scratch.write(sent.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_finish(model, labels, hot), _sql(_OUT)), "sums", ["kind"])
    parts = done.where("kind = 'sums'").groupBy("batch_id").agg(F.collect_list(F.struct("shard", "blob")).alias("parts"))
    docs = done.where("kind = 'docs'").select("batch_id", "grp", F.col("blob").alias("docs"))
    kinds = "".join(f", {n} double" for n in model.sums) + "".join(f", {n} long" for n in model.carried)
    return docs.join(parts, "batch_id").mapInArrow(_assemble(model.sums, model.carried, model.precision), "doc_id long, fold int, grp string, n_tokens long" + kinds)
