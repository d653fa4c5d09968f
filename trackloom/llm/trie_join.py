"""Exact Jaccard join of n-gram sets with a prefix tree.

N-grams have one global order: by falling document frequency, then hash. Read
from its rare end, a set's prefix must share an n-gram with that of any set it
links to, which deals sets into groups; n-grams of a single document need no
partner and only use up prefix. Groups are sets chained by shared prefixes; a
group too large for a task is cut into pairs of blocks or, where that is less
work, into the sets of each shared prefix n-gram. Within a group, sets are stored in the order's
frequent-first direction in a compressed trie, so that similar sets share a
path and its overlap is counted once. A set is joined by walking the trie from
the root, level by level, and leaving a subtree as soon as the overlap so far
and the lengths that remain cannot reach the threshold.

Frequencies come from a packed exchange: each batch of texts sends its distinct
n-grams, sorted and shortened, to the shards of the n-gram space and gets the
totals back. Shortening only merges frequencies, the same for every batch, so
the order stays global and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PACK_BYTES, Scratch, Words, bounded_batches, connected_components, deltas, hashes, mix, pack, release, shards_for, shingles, text_slices, unpack

#: Links: 100 * intersection >= PERCENT * union.
PERCENT, SHINGLE = 90, 3
#: N-grams that one shard of the frequency exchange holds at least, and that one
#: task of the join holds of each side at most; larger groups are joined in blocks.
SHARD_ITEMS, BLOCK_ITEMS = 4_000_000, 1_000_000
#: Equal texts of over this part of all are joined to their results by broadcast: there are at most so many.
HEAVY_CLASSES = 200


def doc_sets(word_hash: np.ndarray, begin: np.ndarray, lens: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one n-gram."""
    grams = shingles(word_hash, size)
    out = []
    for b, n in zip(begin.tolist(), lens.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(grams[b : b + n - size + 1]))
        elif n:
            out.append(mix(shingles(word_hash[b : b + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _slice_sets(codes: np.ndarray, words: np.ndarray, lens: np.ndarray, size: int) -> list[np.ndarray]:
    return doc_sets(words[codes], np.cumsum(lens) - lens, lens, size)


def ask(bits: int, shards: int, size: int):
    """Map: encoded batches, and each batch's distinct shortened n-grams for each shard."""
    kinds = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("batch_id", pa.int64()), ("blob", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, step = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            for first, end, data, offsets in text_slices(batch, limit=PACK_BYTES):
                found = Words(data, offsets, lower=True)
                codes, dictionary = found.encode()
                words = hashes(dictionary)
                sets = _slice_sets(codes, words, found.per_doc, size)
                keys, count = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
                edges = np.searchsorted(keys, (np.arange(shards + 1, dtype=object) * (1 << bits) // shards).astype(np.uint64))
                full = [s for s in range(shards) if edges[s] < edges[s + 1]]
                blobs = [pack(deltas(keys[edges[s] : edges[s + 1]]), count[edges[s] : edges[s + 1]].astype(np.uint32)) for s in full]
                who, n = (part << 32) + step, len(full)
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": ["ask"] * n + ["batch"],
                        "shard": [*full, None],
                        "batch_id": [who] * (n + 1),
                        "blob": [*blobs, pack(codes.astype(np.uint32))],
                        "doc_ids": [None] * n + [ids.slice(first, end - first).to_pylist()],
                        "lens": [None] * n + [found.per_doc.tolist()],
                        "words": [None] * n + [words.tobytes()],
                    },
                    schema=kinds,
                )
                step += 1

    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over whole shards: total frequency of each n-gram that a batch sent."""
    asked: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for shard, who, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "batch_id", "blob")), strict=True):
            step, count = unpack(blob, np.uint64, np.uint32)
            asked.setdefault(shard, []).append((who, np.cumsum(step, dtype=np.uint64), count))
    for shard in list(asked):
        sent = asked.pop(shard)
        uniq, place = np.unique(np.concatenate([k for _, k, _ in sent]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([c for _, _, c in sent]), minlength=len(uniq))
        capped = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        blobs, at = [], 0
        for _, keys, _ in sent:
            blobs.append(pack(capped[place[at : at + len(keys)]]))
            at += len(keys)
        del uniq, place, total, capped
        release()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(sent), pa.int32()), "batch_id": pa.array([w for w, _, _ in sent], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def choose(bits: int, size: int, percent: int):
    """Map: each text's set size and digest, and for a set that can link to a
    different one its shared n-grams with their frequencies and its prefix."""
    least = percent // max(1, 100 - percent)  # sets of fewer n-grams link only to equal sets
    kinds = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("grams", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["lens"], np.int64)
                (codes,) = unpack(row["blob"], np.uint32)
                sets = _slice_sets(codes, np.frombuffer(row["words"], np.uint64), lens, size)
                keys = np.unique(np.concatenate(sets) >> np.uint64(64 - bits))
                replies = sorted(row["replies"] or [], key=lambda r: r["shard"])
                df = np.concatenate([unpack(r["blob"], np.uint32)[0] for r in replies]) if replies else np.zeros(0, np.uint32)
                seen: set[bytes] = set()
                out: dict[str, list] = {name: [] for name in kinds.names}
                for doc_id, grams in zip(row["doc_ids"], sets, strict=True):
                    n = len(grams)
                    digest = xxhash.xxh3_128_digest(grams.tobytes()) if n else None
                    blob = prefix = None
                    if n >= least and digest not in seen:
                        often = df[np.searchsorted(keys, grams >> np.uint64(64 - bits))]
                        shared = often > 1
                        if 100 * int(shared.sum()) >= percent * n:
                            grams, often = grams[shared], often[shared]
                            order = np.lexsort((grams, often))
                            length = n - ceil(percent * n / 100) + 1 - (n - len(grams))
                            prefix = grams[order[: max(0, length)]].view(np.int64).tolist()
                            blob = pack(deltas(grams), often)
                            seen.add(digest)
                    for name, value in zip(kinds.names, (doc_id, n, digest, blob, prefix), strict=True):
                        out[name].append(value)
                del sets, keys, df, codes
                release()
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return run


class Trie:
    """Compressed trie of sorted integer arrays, as flat arrays of its nodes."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        names = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=names.__getitem__)
        depth, parent, of, leaf = [0], [-1], [order[0] if order else 0], [-1]
        stack, last = [0], None
        for s in order:
            shared = 0
            if last is not None:
                m = min(len(sets[s]), len(sets[last]))
                differ = np.flatnonzero(sets[s][:m] != sets[last][:m])
                shared = int(differ[0]) if len(differ) else m
            below = -1
            while depth[stack[-1]] > shared:
                below = stack.pop()
            if depth[stack[-1]] < shared:
                depth.append(shared), parent.append(stack[-1]), of.append(s), leaf.append(-1)
                parent[below] = len(depth) - 1
                stack.append(len(depth) - 1)
            depth.append(len(sets[s])), parent.append(stack[-1]), of.append(s), leaf.append(s)
            stack.append(len(depth) - 1)
            last = s
        n = len(depth)
        self.depth, self.parent, self.leaf = np.array(depth), np.array(parent), np.array(leaf)
        above = self.depth[np.maximum(self.parent, 0)]
        above[0] = 0
        self.tokens = np.concatenate([sets[of[v]][above[v] : depth[v]] for v in range(n)]) if sets else np.zeros(0, np.int64)
        self.begin = np.append(0, np.cumsum(self.depth - above))
        children = np.argsort(self.parent, kind="stable")
        self.children = children[1:]  # the root is first, under -1
        self.first = np.searchsorted(self.parent[self.children], np.arange(n + 1))
        # of the sets below each node: the least size, and the greatest length still to come
        self.least = np.where(self.leaf >= 0, sizes[np.maximum(self.leaf, 0)] if len(sizes) else 0, np.iinfo(np.int64).max)
        longest = np.where(self.leaf >= 0, self.depth, 0)
        pending = np.array([0])
        levels = []
        while len(pending):
            levels.append(pending)
            pending = self._below(pending)
        for nodes in reversed(levels[1:]):
            np.minimum.at(self.least, self.parent[nodes], self.least[nodes])
            np.maximum.at(longest, self.parent[nodes], longest[nodes])
        self.rest = longest - self.depth

    def _below(self, nodes: np.ndarray) -> np.ndarray:
        counts = self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(self.first[nodes] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        return self.children[at]

    def partners(self, query: np.ndarray, size: int, mark: np.ndarray, percent: int) -> np.ndarray:
        """Sets that link to the query (its tokens set in ``mark``), by pruned walk."""
        nodes, overlap, out = np.array([0]), np.array([0]), []
        while True:
            counts = self.first[nodes + 1] - self.first[nodes]
            overlap = np.repeat(overlap, counts)
            nodes = self._below(nodes)
            if not len(nodes):
                break
            length = self.begin[nodes + 1] - self.begin[nodes]
            ends = np.cumsum(length)
            at = np.repeat(self.begin[nodes] - (ends - length), length) + np.arange(ends[-1])
            sums = np.append(0, np.cumsum(mark[self.tokens[at]]))
            overlap = overlap + sums[ends] - sums[ends - length]
            last = self.tokens[np.maximum(self.begin[nodes + 1] - 1, 0)]
            left = len(query) - np.searchsorted(query, last, "right")
            best = overlap + np.minimum(left, self.rest[nodes])
            alive = (100 + percent) * best >= percent * (size + self.least[nodes])
            nodes, overlap = nodes[alive], overlap[alive]
            ended = self.leaf[nodes] >= 0
            out.append((self.leaf[nodes[ended]], overlap[ended]))
        return np.concatenate([np.stack(x) for x in out], 1) if out else np.zeros((2, 0), np.int64)


def join_sets(sets: list[np.ndarray], often: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Partners among ``right`` of each set of ``left`` (indexes into ``sets``)."""
    uniq, place = np.unique(np.concatenate(sets), return_inverse=True)
    frequency = np.zeros(len(uniq), np.int64)
    frequency[place] = np.concatenate(often)
    rank = np.empty(len(uniq), np.int64)
    rank[np.lexsort((uniq, -frequency))] = np.arange(len(uniq))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ranked = [np.sort(x) for x in np.split(rank[place], cuts)]
    trie = Trie([ranked[j] for j in right], sizes[right])
    mark = np.zeros(len(uniq), np.int64)
    for i in left:
        mark[ranked[i]] = 1
        found, overlap = trie.partners(ranked[i], int(sizes[i]), mark, percent)
        mark[ranked[i]] = 0
        j = right[found.astype(np.int64)] if len(found) else np.zeros(0, np.int64)
        linked = 100 * overlap >= percent * (sizes[i] + sizes[j] - overlap)
        yield i, j[linked & (j != i)]


def block_links(percent: int):
    """Group map: links of a group's sets, of two blocks of a large group, or of the sets of a prefix n-gram.

    A pair that shares several prefix n-grams counts at the smallest. Emits a spanning forest of the links as stars, and each set's number of
    linked texts.
    """
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        vertex, size, copies, block = (table[c].to_numpy() for c in ("vertex", "n_shingles", "copies", "block"))
        parts = [unpack(x, np.uint64, np.uint32) for x in table["grams"].to_pylist()]
        sets, often = [np.cumsum(g, dtype=np.uint64) for g, _ in parts], [f for _, f in parts]
        low, high, token = table["low"][0].as_py(), table["high"][0].as_py(), table["token"][0].as_py()
        prefix = [np.array(p) for p in table["prefix"].to_pylist()] if token is not None else []
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        root, links = np.arange(len(vertex)), np.zeros(len(vertex), np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if len(left) and len(right):
            for i, js in join_sets(sets, often, size, left, right, percent):
                if token is not None:
                    js = js[[np.intersect1d(prefix[i], prefix[j]).min() == token for j in js]] if len(js) else js
                links[i] += copies[js].sum()
                if low != high:
                    links[js] += copies[i]
                for j in js.tolist():
                    x, y = find(int(i)), find(j)
                    if x != y:
                        root[max(x, y)] = min(x, y)
        tops = [find(x) for x in range(len(vertex))]
        keep = [x for x in range(len(vertex)) if tops[x] != x or links[x]]
        del sets, often, parts
        release()
        return pa.table([pa.array(vertex[keep]), pa.array(vertex[[tops[x] for x in keep]]), pa.array(links[keep])], schema=kinds)

    return run


def ngram_join(docs: DataFrame, scratch: Scratch | None = None, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Components of texts whose n-gram sets link, and how many texts each links to.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and
    n_links (texts linked to directly, equal sets included).

    Null or empty text: no n-grams, linked with nothing, a component of its own.
    Fewer words than an n-gram has: one n-gram, the whole sequence. Null doc_id:
    kept; it never names a component unless the component has no other id.
    Repeated rows: equal sets, which link. Empty table: no rows. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "trie")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(62, max(16, ceil(log2(chars + 1)) + 6))
    shards = shards_for(spark, chars // 5, SHARD_ITEMS)
    sent = scratch.write(rows.mapInArrow(ask(bits, shards, size), "kind string, shard int, batch_id long, blob binary, doc_ids array<long>, lens array<long>, words binary"), "sent", ["kind"])
    asked = sent.where("kind = 'ask'").select("shard", "batch_id", "blob").repartitionById(shards, "shard")
    replies = asked.mapInArrow(answer, "shard int, batch_id long, blob binary").groupBy("batch_id").agg(F.collect_list(F.struct("shard", "blob")).alias("replies"))
    batches = sent.where("kind = 'batch'").select("batch_id", "blob", "doc_ids", "lens", "words").join(replies, "batch_id", "left")
    sets = scratch.write(batches.mapInArrow(choose(bits, size, percent), "doc_id long, n_shingles long, digest binary, grams binary, prefix array<long>"), "sets")
    scratch.drop("sent")

    classes = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    chosen = sets.where("grams is not null").dropDuplicates(["digest"]).join(classes, "digest")
    chosen = scratch.write(chosen.select("digest", F.xxhash64("digest").alias("vertex"), "n_shingles", "copies", "grams", "prefix"), "chosen")
    tokens = chosen.select(F.explode("prefix").alias("token"), "vertex")
    stars = tokens.groupBy("token").agg(F.min("vertex").alias("top"), F.count("*").alias("n")).where("n > 1")
    groups = connected_components(scratch, tokens.join(stars, "token").select(F.col("vertex").alias("a"), F.col("top").alias("b")), "groups")
    groups = groups.withColumnRenamed("component", "part")
    shared = tokens.join(stars.select("token"), "token")
    width = shared.groupBy("vertex").agg(F.count("*").alias("width"))
    members = scratch.write(chosen.join(groups, "vertex").join(width, "vertex"), "members")
    items = F.sum("n_shingles")
    weights = members.groupBy("part").agg(F.ceil(items / BLOCK_ITEMS).cast("int").alias("blocks"), (F.sum(F.col("n_shingles") * F.col("width")) < F.ceil(items / BLOCK_ITEMS) * items).alias("by_token"))
    # a part of one block is as it is; of the others, most sets share few prefix n-grams or most share many
    weights = scratch.write(weights.withColumn("by_token", F.col("by_token") & (F.col("blocks") > 1)), "weights")
    dealt = members.join(weights, "part")
    few = dealt.where("by_token").join(shared, "vertex")
    size_of = few.groupBy("part", "token").agg(F.ceil(items / BLOCK_ITEMS).cast("int").alias("blocks"))
    few = few.drop("blocks").join(size_of, ["part", "token"])
    dealt = dealt.where("not by_token").withColumn("token", F.lit(None).cast("long")).withColumn("prefix", F.lit(None).cast("array<long>")).unionByName(few)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vertex", "part"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", "token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "vertex", "n_shingles", "copies", "grams", "prefix"
    )
    found = scratch.write(dealt.groupBy("part", "token", "low", "high").applyInArrow(block_links(percent), "a long, b long, links long"), "links")
    linked = found.groupBy("a").agg(F.sum("links").alias("links"))
    joined = connected_components(scratch, found.select("a", "b"), "joined")
    named = chosen.select("digest", "vertex").join(joined, "vertex").join(classes.select("digest", "low"), "digest")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    tops = named.join(lowest, "component").select("digest", "component_id")
    extra = chosen.select("digest", "vertex").join(linked, F.col("vertex") == F.col("a")).select("digest", "links")
    own = classes.join(tops, "digest", "left").join(extra, "digest", "left")
    own = own.select("digest", "copies", F.coalesce("component_id", "low").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = scratch.write(own, "classes")
    # texts without words meet no one; the few largest classes are broadcast, the others joined by their digest
    limit = sets.count() // HEAVY_CLASSES
    heavy = own.where(F.col("copies") > limit).select(F.col("digest").alias("_digest"), F.col("component_id").alias("_component"), F.col("n_links").alias("_links"))
    full = sets.where("digest is not null").select("doc_id", "n_shingles", "digest").join(F.broadcast(heavy), F.col("digest") == F.col("_digest"), "left")
    rest = full.where("_digest is null").select("doc_id", "n_shingles", "digest").join(own.where(F.col("copies") <= limit).drop("copies"), "digest")
    names = ("doc_id", "n_shingles", "component_id", "n_links")
    empty = sets.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    large = full.where("_digest is not null").select("doc_id", "n_shingles", F.col("_component").alias("component_id"), F.col("_links").alias("n_links"))
    rows = empty.unionByName(large).unionByName(rest.select(*names))
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "n_links")


def op6_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 90% of 3-word shingles."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP6_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
g as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) end as s from w),
u as (select doc_id, len(s) as n, unnest(s) as gram from g),
rare as (select gram from u group by gram having count(*) > 1),
o as (
  select a.doc_id as x, b.doc_id as y, count(*) as common, any_value(a.n) as n, any_value(b.n) as m
  from u a join rare using (gram) join u b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from o where 100 * common >= 90 * (n + m - common)),
reach(x, y) as (select doc_id, doc_id from g union select r.x, e.y from reach r join e on r.y = e.x)
select g.doc_id, len(s)::bigint as n_shingles, c.component_id, coalesce(l.n_links, 0)::bigint as n_links
from g join (select x, min(y) as component_id from reach group by x) c on c.x = g.doc_id
left join (select x, count(*) as n_links from e group by x) l on l.x = g.doc_id
"""
