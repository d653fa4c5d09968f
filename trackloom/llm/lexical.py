"""Ranked lexical search over document shards with integer impacts.

Every slice of texts is a shard: its terms in order of their hashes, and for each
term the documents that hold it with the impact of the term there (the part of a
score that does not depend on the term's weight), worked out once when the index
is written. A search goes through shards term at a time, adds weighted impacts to
one dense accumulator, and keeps a query's best by a partition that no tie is cut
by. Tasks merge their shards' bests, Spark merges the tasks'.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import PACK_BYTES, Scratch, Words, bounded_batches, deltas, hashes, pack_small, text_slices, unpack_small
from .topk import Best

#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = PACK_BYTES
#: Terms of the items that one search of the index answers; more items are searched in turns.
BLOCK_TERMS = 1 << 20
#: Letters, digits and all beyond ASCII.
_IS_TERM = np.zeros(256, dtype=bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Stands for a null doc_id, so that it comes after the others.
NO_ID = np.iinfo(np.int64).max
INDEX = "docs binary, terms binary, sizes binary, places binary, impacts binary"


def terms_of(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int, Words]]:
    """First row, end row and terms of each slice of whole texts."""
    for first, end, data, offsets in text_slices(batch, limit=limit):
        yield first, end, Words(data, offsets, lower=True, kinds=_IS_TERM)


def collection_size(docs: DataFrame) -> tuple[int, int]:
    """Texts with a term, and terms with repeats in all texts."""
    limit = SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in terms_of(batch, limit):
                yield pa.RecordBatch.from_pydict({"holding": [int((words.per_doc > 0).sum())], "terms": [len(words)]})

    row = docs.select("text").mapInArrow(run, "holding long, terms long").agg(F.sum("holding"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def shard(ids: np.ndarray, words: Words, holding: int, terms: int) -> tuple[np.ndarray, ...]:
    """CSR postings of a slice: ids, sorted terms, postings of each, their documents and impacts."""
    codes, dictionary = words.encode()
    names = hashes(dictionary)
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cells, tf = np.unique(rank[codes] * max(words.n_docs, 1) + words.doc, return_counts=True)
    term, place = np.divmod(cells, max(words.n_docs, 1))
    lengths, which = np.unique(words.per_doc, return_inverse=True)
    # whole numbers of any size: a product of three counts can pass 64 bits
    m = np.array([100 - 90 + 90 * int(n) * holding // max(terms, 1) for n in lengths], np.int64)[which]
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[place])
    return ids, names[order], np.bincount(term, minlength=len(order)), place, impact


def build_index(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The index of all texts as a table of shards, and the number of texts with a term."""
    holding, terms = collection_size(docs)
    limit = SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for first, end, words in terms_of(batch, limit):
                if not len(words):
                    continue
                names, keys, sizes, places, impacts = shard(ids[first:end], words, holding, terms)
                # ids as they are: they may be negative
                blobs = (names.astype("<i8").tobytes(), pack_small(deltas(keys)), pack_small(sizes), pack_small(places), pack_small(impacts))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=["docs", "terms", "sizes", "places", "impacts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.write(rows.mapInArrow(run, INDEX), "index"), holding


def keys_of(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_small(blob)[0].astype(np.uint64), dtype=np.uint64)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted term in a shard's sorted terms, -1 for those it lacks."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def frequencies(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """Documents that hold each wanted term (sorted hashes, as signed integers), for terms that any holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, sizes in zip(batch.column("terms"), batch.column("sizes"), strict=True):
                at = find(keys_of(terms.as_py()), wanted)
                total[at >= 0] += unpack_small(sizes.as_py())[0][at[at >= 0]].astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": wanted[some].view(np.int64), "df": total[some]})

    got = index.select("terms", "sizes").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in got.collect()}  # as many rows as wanted terms at most


def weight(holding: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * holding + 2) / (2 * df + 1)))


def ranked(acc: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by smaller id."""
    some = np.flatnonzero(acc > 0)
    if len(some) > k:
        kth = acc[some[np.argpartition(acc[some], len(some) - k)[len(some) - k]]]
        some = some[acc[some] >= kth]  # with all that tie with the last
    return some[np.lexsort((ids[some], -acc[some]))[:k]]


def search_block(index: DataFrame, items: list[tuple[int, list[int]]], holding: int, k: int) -> DataFrame:
    """Best k documents of each item, by task: item (its number), doc_id, score."""
    wanted = np.unique(np.array([t for _, terms in items for t in terms], np.int64).view(np.uint64))
    df = frequencies(index, wanted)
    known = np.array([t for t in wanted.view(np.int64).tolist() if t in df], np.int64).view(np.uint64)
    weights = np.array([weight(holding, df[t]) for t in known.view(np.int64).tolist()], np.int64)
    each = [np.searchsorted(known, np.array([t for t in terms if t in df], np.int64).view(np.uint64)) for _, terms in items]
    names = np.array([n for n, _ in items], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        for batch in batches:
            for row in range(batch.num_rows):
                blob = {c: batch.column(c)[row].as_py() for c in ("docs", "terms", "sizes", "places", "impacts")}
                ids = np.frombuffer(blob["docs"], "<i8")
                at = find(keys_of(blob["terms"]), known)
                ends = np.cumsum(unpack_small(blob["sizes"])[0].astype(np.int64))
                places, impacts = unpack_small(blob["places"])[0], unpack_small(blob["impacts"])[0].astype(np.int64)
                rows, scores, whose = [], [], []
                for item, terms in enumerate(each):
                    acc = np.zeros(len(ids), np.int64)
                    for t in terms[at[terms] >= 0]:
                        post = slice(ends[at[t] - 1] if at[t] else 0, ends[at[t]])
                        acc[places[post]] += weights[t] * impacts[post]  # a document is once in a term's postings
                    top = ranked(acc, ids, k)
                    rows.append(ids[top])
                    scores.append(acc[top])
                    whose.append(np.full(len(top), item))
                best.add(np.concatenate(whose), np.concatenate(scores), np.concatenate(rows))
        item, rank = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_pydict({"item_id": names[item], "doc_id": best.id[item, rank], "score": best.score[item, rank]})

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """The k documents (doc_id, text) with the highest score for each item (item_id, text).

    Terms are runs of ASCII letters and digits and of all beyond ASCII, A-Z
    lower-cased, known by 64-bit hashes. Returns item_id, rank (from 1, unique),
    doc_id, score, all whole numbers; only scores above 0, equal ones by
    ascending doc_id.

    Null or empty text, or one without terms: no term; such a document counts
    nowhere and such an item finds nothing. Null doc_id: ranked behind others of
    its score, returned null. Null item_id: no item. Rows of one item_id are one
    item with the terms of all. Repeated documents: each row is one, with ranks of
    their own. Empty tables: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "lexical")
    index, holding = build_index(docs, scratch)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words in terms_of(batch, SHARD_BYTES):
                codes, dictionary = words.encode()
                cells = np.unique(words.doc * max(len(dictionary), 1) + codes)
                doc, code = np.divmod(cells, max(len(dictionary), 1))
                at = np.searchsorted(doc, np.arange(end - first + 1))
                terms = pa.LargeListArray.from_arrays(at, hashes(dictionary).view(np.int64)[code]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id").slice(first, end - first), "terms": terms})

    asked = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = asked.mapInArrow(split, "item_id long, terms array<long>").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    asked = scratch.write(asked.where(F.size("terms") > 0), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        block = [(r["item_id"], r["terms"]) for r in mine.collect()]  # about BLOCK_TERMS terms
        if block:
            best = search_block(index, block, holding, k)
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 10 of all documents for each benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lexical_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP13_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents where text is not null),
g as (select count(*) as docs, sum(len(t))::bigint as terms from d where len(t) > 0),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where item_id is not null),
u as (select r, unnest(t) as term from d),
p as (select r, term, count(*) as tf from u where term in (select term from q) group by r, term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * n + 1)))::bigint as weight from (select term, count(*) as n from p group by term), g),
m as (select r, doc_id, 100 - 90 + (90 * len(t) * docs) // terms as m from d, g where len(t) > 0),
s as (
  select item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from q join w using (term) join p using (term) join m using (r) group by item_id, r, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::integer as rank, doc_id, score
from s where score > 0 qualify rank <= 10
"""
