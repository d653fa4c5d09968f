"""Quality classifier: random-indexing word vectors, pooled, under a small network.

Every distinct word has a sparse random index vector, drawn from its hash, and a
context vector: the sum of the index vectors of its neighbours over all texts.
Both together, at unit length, are its word vector; vectors of all words are a
table in the shared folder, in shards, that grows with the vocabulary. A text's
vector is the mean of its words' vectors. A two-layer network in numpy learns
labels from a bounded sample, and a temperature, fitted on labelled texts that
the network did not see, calibrates its probabilities.

Pooling and the network's first layer are both linear. So the layer is applied
to the words, and what a text's words send back to it is as wide as the hidden
layer only. Sums of contexts are whole numbers: no order of adding changes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK64, Scratch, Words, bounded_batches, deltas, hashes, held_out, mix, pack, pack_small, release, text_slices, unpack, unpack_small
from .ngrams import END, gram_messages

#: Dimensions of a vector, nonzero entries of an index vector, and how far away a neighbour may be.
DIM, NONZERO, WINDOW = 32, 4, 2
#: Labelled texts that the network learns from at most, and its hidden units.
SAMPLE, HIDDEN = 20_000, 16
THRESHOLD = 0.3
#: Bytes of text of a step; bytes of text and words of a shard at least; words of one piece of a shard's table.
STEP_BYTES, SHARD_BYTES, SHARD_WORDS, PIECE = 8 << 20, 60_000_000, 2_000_000, 250_000
#: A word vector's entries are kept as whole numbers of this part.
UNIT = 1 / 127


def index_vectors(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each word's index vector, from its hash."""
    bits = mix((keys[:, None] + np.arange(1, NONZERO + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).ravel()).reshape(-1, NONZERO)
    return (bits % np.uint64(DIM)).astype(np.int32), np.where((bits >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int32)


def context_sums(keys: np.ndarray, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each of ``keys`` the sum of its neighbours' index vectors, within texts."""
    place, sign = index_vectors(keys)
    total = np.zeros(len(keys) * DIM, np.int32)
    for gap in range(1, WINDOW + 1):
        same = doc[gap:] == doc[:-gap]
        left, right = code[:-gap][same].astype(np.int64), code[gap:][same].astype(np.int64)
        for here, near in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(here * DIM + place[near, k], weights=sign[near, k], minlength=len(total)).astype(np.int32)
    return total.reshape(-1, DIM)


def word_vectors(keys: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Vectors at unit length, in whole parts: mean context and own index vector."""
    place, sign = index_vectors(keys)
    out = sums / np.maximum(counts, 1)[:, None]
    for k in range(NONZERO):
        np.add.at(out, (np.arange(len(keys)), place[:, k]), sign[:, k])
    return np.rint(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9) / UNIT).astype(np.int8)


def _folded(x: np.ndarray) -> np.ndarray:
    """Whole numbers as ones from 0 on, small ones small."""
    x = x.astype(np.int64)
    return np.where(x < 0, -2 * x - 1, 2 * x)


def _unfolded(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return np.where(x & 1, -(x + 1) // 2, x // 2)


_SENT = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("batch_id", pa.int64()), ("keys", pa.binary()), ("blob", pa.binary())])
SENT = "kind string, shard int, batch_id long, keys binary, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SENT)], schema=_SENT)


def _slices(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Batch number, ids, distinct keys, and code and text of each word of every step."""
    part, step = TaskContext.get().partitionId(), 0
    for batch in batches:
        for first, end, data, offsets in text_slices(batch, limit=STEP_BYTES):
            words = Words(data, offsets)
            codes, dictionary = words.encode()
            keys, place = np.unique(hashes(dictionary) >> np.uint64(64 - bits), return_inverse=True)
            code, doc = place[codes].astype(np.int32), words.doc.astype(np.int32)
            del words, codes, dictionary
            release()
            yield (part << 32) + step, batch.column("doc_id").slice(first, end - first), keys, code, doc
            step += 1


def _doc_messages(who: int, ids: pa.Array, keys: np.ndarray, code: np.ndarray, doc: np.ndarray, bits: int, shards: int) -> Iterator[tuple]:
    """Rows with a step's texts and the words that each holds, for each shard."""
    n, end = len(ids), np.uint64((END & MASK64) >> (64 - bits))
    keys = np.append(keys, end)
    stream = np.full(len(code) + n, len(keys) - 1, np.int32)
    stream[np.arange(len(code)) + doc] = code
    lens = np.bincount(doc, minlength=n) + 1
    sink = pa.BufferOutputStream()
    table = pa.table({"doc_id": ids, "n": lens - 1})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    yield ("texts", who % shards, who, None, sink.getvalue().to_pybytes())
    for s, blob in gram_messages(keys, stream, lens, np.zeros(n, np.uint8), 1, shards):
        yield ("words", s, who, None, blob)


def send_contexts(bits: int, shards: int, sample: frozenset):
    """Map: context sums of every step's words for each shard, and the words of texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for who, ids, keys, code, doc in _slices(batches, bits):
            rows = []
            if len(keys):
                counts, sums = np.bincount(code, minlength=len(keys)), context_sums(keys, code, doc)
                shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
                for s in np.unique(shard).tolist():
                    mine = np.flatnonzero(shard == s)
                    rows.append(("contexts", s, who, pack_small(deltas(keys[mine]), counts[mine]), pack_small(_folded(sums[mine]).T.reshape(-1))))
            taught = np.flatnonzero([i in sample for i in ids.to_pylist()])
            if len(taught):
                new = np.full(len(ids), -1, np.int32)
                new[taught] = np.arange(len(taught))
                mine = new[doc] >= 0 if len(doc) else np.zeros(0, bool)
                rows += _doc_messages(who, ids.take(pa.array(taught)), keys, code[mine], new[doc[mine]], bits, shards)
            sums = None
            release()
            if rows:
                yield _rows(rows)

    return run


class Sums:
    """Counts and context sums by key, merged whenever enough has come in."""

    def __init__(self):
        self.parts, self.pending = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        self.parts.append((keys, counts, sums))
        self.pending += len(keys)
        if self.pending > 2 * len(self.parts[0][0]) + PIECE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, DIM), np.int32)
        if len(self.parts) > 1:
            keys, place = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
            counts, sums, at = np.zeros(len(keys), np.int64), np.zeros((len(keys), DIM), np.int32), 0
            for k, c, s in self.parts:  # keys of a part are distinct
                mine = place[at : at + len(k)]
                counts[mine] += c
                sums[mine] += s
                at += len(k)
            self.parts = [(keys, counts, sums)]
        self.pending = len(self.parts[0][0])
        return self.parts[0]


def _pool(blob: bytes, keys: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a message and the sums of their words' vectors; a word without one adds nothing."""
    held, doc, times, _, step, _ = unpack_small(blob)
    asked = np.cumsum(step, dtype=np.uint64)
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    known = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
    of = np.repeat(at, held.astype(np.int64))
    weight = times * np.repeat(known, held.astype(np.int64))
    texts, place = np.unique(doc, return_inverse=True)
    if not len(keys):
        return texts, np.zeros((len(texts), vectors.shape[1]), np.float32)
    return texts, np.stack([np.bincount(place, weights=column[of] * weight, minlength=len(texts)) for column in vectors.T], 1).astype(np.float32)


def _pooled(kind: str, shard: int, who: int, blob: bytes, keys: np.ndarray, vectors: np.ndarray) -> tuple:
    if kind == "texts":
        return ("texts", shard, who, None, blob)
    texts, sums = _pool(blob, keys, vectors)
    return ("sums", shard, who, pack_small(texts), pack(np.ascontiguousarray(sums.T).reshape(-1).view(np.uint32)))


def make_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over whole shards: word vectors from all contexts, and the sums of texts to learn from."""
    held: dict[int, Sums] = {}
    asked: list[tuple] = []
    for batch in batches:
        for kind, shard, who, keys, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == "contexts":
                step, counts = unpack_small(keys)
                sums = _unfolded(unpack_small(blob)[0]).reshape(DIM, -1).T.astype(np.int32)
                held.setdefault(shard, Sums()).add(np.cumsum(step, dtype=np.uint64), counts.astype(np.int64), sums)
            else:
                asked.append((kind, shard, who, blob))
    for shard, sums in held.items():
        keys, counts, total = sums.merge()
        vectors = np.concatenate([word_vectors(keys[lo : lo + PIECE], counts[lo : lo + PIECE], total[lo : lo + PIECE]) for lo in range(0, len(keys), PIECE)])
        for lo in range(0, len(keys), PIECE):
            yield _rows([("vectors", shard, len(keys[lo : lo + PIECE]), pack_small(deltas(keys[lo : lo + PIECE])), pack_small(_folded(vectors[lo : lo + PIECE]).T.reshape(-1)))])
        whole = vectors.astype(np.float32)
        for kind, s, who, blob in asked:
            if s == shard:
                yield _rows([_pooled(kind, s, who, blob, keys, whole)])
    empty = np.zeros(0, np.uint64), np.zeros((0, DIM), np.float32)
    lost = [_pooled(kind, s, who, blob, *empty) for kind, s, who, blob in asked if s not in held]
    if lost:
        yield _rows(lost)


def project(weights: np.ndarray, shards: int):
    """Map over the table of vectors: what each word brings to the hidden units, for each shard of texts' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, blob in zip(batch.column("keys").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                keys = np.cumsum(unpack_small(keys)[0], dtype=np.uint64)
                hidden = (_unfolded(unpack_small(blob)[0]).reshape(DIM, -1).T @ weights).astype(np.float16)
                shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
                for s in np.unique(shard).tolist():
                    mine = shard == s
                    yield _rows([("hidden", s, None, pack_small(deltas(keys[mine])), pack(np.ascontiguousarray(hidden[mine].T).reshape(-1).view(np.uint16)))])

    return run


def send_words(bits: int, shards: int):
    """Map: the words of all texts for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for who, ids, keys, code, doc in _slices(batches, bits):
            rows = _rows(list(_doc_messages(who, ids, keys, code, doc, bits, shards)))
            release()
            yield rows

    return run


def pool_hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over whole shards, their words first: sums of each text's words in the hidden units."""
    shard, parts, table = None, [], None
    for batch in batches:
        for kind, s, who, keys, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                shard, parts, table = s, [], None
            if kind == "hidden":
                parts.append((np.cumsum(unpack_small(keys)[0], dtype=np.uint64), unpack(blob, np.uint16)[0].view(np.float16).reshape(HIDDEN, -1).T))
                continue
            if table is None:
                words = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
                order = np.argsort(words)
                table = words[order], np.concatenate([np.zeros((0, HIDDEN), np.float16), *(p[1] for p in parts)])[order].astype(np.float32)
                parts = []
            yield _rows([_pooled(kind, s, who, blob, *table)])


def _gather(width: int, made):
    """Map: each batch's texts with the sums of all shards, turned into columns by ``made(n, sums)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = pa.ipc.open_stream(row["texts"]).read_all()
                total = np.zeros((table.num_rows, width))
                for part in sorted(row["parts"] or [], key=lambda p: p["shard"]):
                    (texts,) = unpack_small(part["keys"])
                    total[texts.astype(np.int64)] += unpack(part["blob"], np.uint32)[0].view(np.float32).reshape(width, -1).T
                yield pa.RecordBatch.from_pydict({"doc_id": table["doc_id"].combine_chunks(), **made(table["n"].to_numpy(), total)})

    return run


def _by_batch(done: DataFrame) -> DataFrame:
    parts = done.where("kind = 'sums'").groupBy("batch_id").agg(F.collect_list(F.struct("shard", "keys", "blob")).alias("parts"))
    return done.where("kind = 'texts'").select("batch_id", F.col("blob").alias("texts")).join(parts, "batch_id", "left")


class Network:
    """Two layers: tanh, then a logit, on standardised features; Adam on cross-entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60, batch: int = 128):
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        fit = rng.random(len(x)) < 0.8
        self.temperature = 1.0
        z = (x - self.mean) / self.std
        p = [rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        zs, ys = (z[fit], y[fit]) if fit.sum() >= 2 else (z, y)
        share = min(max(ys.mean(), 1e-3), 1 - 1e-3)
        weight = np.where(ys > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        for _ in range(epochs):
            order = rng.permutation(len(zs))
            for lo in range(0, len(order), batch):
                k = order[lo : lo + batch]
                h = np.tanh(zs[k] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - ys[k]) * weight[k] / len(k)
                dh = d[:, None] * p[2] * (1 - h * h)
                t += 1
                for a, (q, g) in enumerate(zip(p, (zs[k].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)), strict=True)):
                    m[a], v[a] = 0.9 * m[a] + 0.1 * g, 0.999 * v[a] + 0.001 * g * g
                    q -= 0.003 * (m[a] / (1 - 0.9**t)) / (np.sqrt(v[a] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        # temperature and shift (class weights moved it) that fit unseen labels best
        rest = ~fit if (~fit).sum() >= 20 else np.ones(len(x), bool)
        logit, target = self.logit(x[rest]), y[rest]
        grid = [(s, b) for s in np.geomspace(0.2, 8, 25) for b in np.linspace(-2, 2, 17)]
        loss = [np.mean(np.logaddexp(0, np.where(target > 0, -1, 1) * (logit / s + b))) for s, b in grid]
        self.temperature, self.shift = grid[int(np.argmin(loss))]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.std @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature + self.shift, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logit(x))


    def first_layer(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and shifts of the hidden units on texts' vectors as they are."""
        weights = self.p[0] / self.std[:, None]
        return weights, self.p[1] - self.mean @ weights

    def score_hidden(self, hidden: np.ndarray) -> np.ndarray:
        """Score from the hidden units before tanh."""
        return self.calibrated(np.tanh(hidden) @ self.p[2] + self.p[3])


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", scratch: Scratch | None = None, sample: int = SAMPLE) -> DataFrame:
    """Probability that each text has label 1 (doc_id, score, predicted).

    Learns from rows of ``labels`` (doc_id and the label) whose doc_id fulfils
    ``learn`` and is one of ``docs``, from the ``sample`` of them with the
    smallest hash of the id. Only texts are inputs. predicted is 1 from a score
    of THRESHOLD on.

    Null or empty text: scored, as a text without words. Null doc_id: scored,
    never learnt from. Null labels: not learnt from. Several labels of an id: 1
    if half or more are. Several texts of an id: all are learnt from, as far as
    the sample goes. Repeated texts: each is scored. No usable label: every
    score is 0.5; labels of one class: every score near it. Empty table: no
    rows. Other columns are ignored. Two words are one where the first 36 or
    more bits of their hashes agree; the bits grow with the corpus.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.where("doc_id is not null and label is not null").where(learn).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    known = known.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    of = dict(known.collect())  # at most ``sample`` ids

    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(60, max(36, ceil(log2(chars + 1)) + 8))
    shards = max(2, -(-chars // SHARD_BYTES))
    contexts = rows.mapInArrow(send_contexts(bits, shards, frozenset(of)), SENT).repartitionById(shards, "shard")
    made = scratch.write(contexts.mapInArrow(make_vectors, SENT), "vectors", ["kind"]).select(*_SENT.names)
    net = None
    if of:
        taught = _by_batch(made).mapInArrow(_gather(DIM, lambda n, x: {"features": pa.array([v.tobytes() for v in x / np.maximum(n, 1)[:, None] * UNIT], pa.binary())}), "doc_id long, features binary")
        taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample).toArrow()
        net = Network(np.stack([np.frombuffer(b) for b in taught["features"].to_pylist()]), np.array([of[i] for i in taught["doc_id"].to_pylist()], float))
    if net is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    weights, shift = net.first_layer()
    words = made.where("kind = 'vectors'")
    shards = max(8, -(-int(words.agg(F.sum("batch_id")).first()[0] or 0) // SHARD_WORDS))  # rows of words tell how many they hold
    sent = words.select("keys", "blob").mapInArrow(project(weights * UNIT, shards), SENT).unionByName(rows.mapInArrow(send_words(bits, shards), SENT))
    # "hidden" sorts before "texts" and "words"
    met = sent.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(pool_hidden, SENT)

    def judged(n: np.ndarray, sums: np.ndarray) -> dict[str, pa.Array]:
        score = net.score_hidden(sums / np.maximum(n, 1)[:, None] + shift)
        return {"score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}

    return _by_batch(scratch.write(met, "pooled", ["kind"]).select(*_SENT.names)).mapInArrow(_gather(HIDDEN, judged), "doc_id long, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labelled ids whose hash is not 0 modulo 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = classify(docs, labels, held_out() != 0)
    return scored.select("doc_id", (held_out() == 0).alias("held_out"), "score", "predicted")
