"""Katz backoff language model over words, counted and scored over a whole corpus.

N-grams up to ORDER are counted in shards (see ngrams). Good-Turing discounts
come from counts of counts over the whole corpus, one set an order. A context's
backoff weight is what its discounted successors leave, divided by what they
leave of the shorter context, so that every distribution sums to one. Scores
are worked out by the recursion itself: a seen n-gram takes its discounted
share, an unseen one its context's weight times the score one order below.

Shards keep what they counted as a table in the shared folder, partitioned by
kind: distinct n-grams, their counts, and the weights of their contexts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, deltas, held_out, pack, pack_small
from .ngrams import Model, Shard, group_sum, text_sums

#: Words of the longest n-gram. Counts up to TRUSTED are discounted; larger ones are trusted.
ORDER, TRUSTED = 3, 5


def good_turing(n: list[int], trusted: int = TRUSTED) -> np.ndarray:
    """Discount of each count 0..trusted (Katz), from n[r] items seen r times.

    Where the counts of counts give no discount between 0 and 1, the count is
    discounted by a half instead, so that every seen count keeps some mass and
    every history has some left.
    """
    out = np.ones(trusted + 1)
    tail = (trusted + 1) * n[trusted + 1] / n[1] if n[1] else 1.0
    for r in range(1, trusted + 1):
        fits = n[r] and tail < 1
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if fits else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def count_of_counts(counts: np.ndarray) -> np.ndarray:
    """How many items are seen 1, 2, ... TRUSTED + 1 times."""
    return np.bincount(np.minimum(counts, TRUSTED + 2).astype(np.int64), minlength=TRUSTED + 3)[1 : TRUSTED + 2].astype(float)


def unseen_words(n: np.ndarray) -> float:
    """How many words are likely not seen, from how many are seen once and twice (Chao); one at least."""
    return max(1.0, float(n[0] * (n[0] - 1) / (2 * (n[1] + 1))))


def discounted(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts after the discounts that the counts of counts give."""
    d = good_turing([0, *n.astype(np.int64).tolist()])
    return np.where(counts <= TRUSTED, d[np.minimum(counts, TRUSTED).astype(np.int64)], 1.0) * counts


def backed_off(counts: np.ndarray, kept: np.ndarray, below: np.ndarray, context: np.ndarray, size: int, known: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of n-grams after their contexts, and each context's backoff weight.

    ``below`` is the probability one order below. A context whose successors are
    all trusted sets one more event aside, so that it has something to back off
    with; a context never seen hands everything down. ``known`` has contexts
    whose n-grams are elsewhere too, with their whole sums.
    """
    total, held = group_sum(context, size, counts), group_sum(context, size, kept)
    rare = group_sum(context, size, (counts > 0) & (counts <= TRUSTED)) > 0
    lower = group_sum(context, size, np.where(counts > 0, below, 0.0))
    if known:
        at, total[at], held[at], rare[at], lower[at] = known[0], *known[1:]
    whole = np.maximum(total + ~rare, 1.0)
    weight = np.where(total > 0, (1 - held / whole) / (1 - lower), 1.0)
    return np.where(counts > 0, kept / whole[context], weight[context] * below), weight


class Katz(Model):
    """Katz backoff of order 2 or 3, learnt from texts of fold 0."""

    step_bytes, shard_tokens = 12 << 20, 4_000_000
    precision = ("4", "8", "4", "8")
    sums = ("score", "base_score", "n_known", "train_tokens")

    def __init__(self, order: int = ORDER):
        if order not in (2, 3):
            raise ValueError("the order is 2 or 3")
        self.order = order

    #: Of a frequent home: pairs seen 1 to TRUSTED + 1 times, tokens of those seen more often than
    #: TRUSTED, pairs whose word is seen 1 to TRUSTED times, and tokens of the words of the others.
    hot_width, pairs_meet = 2 * TRUSTED + 3, True

    def word_values(self, shard: Shard, counts: np.ndarray) -> np.ndarray:
        return group_sum(shard.pair_word, len(shard.words), self.pairs(shard, counts))

    def shard_stats(self, shard: Shard, counts: np.ndarray) -> np.ndarray:
        return np.concatenate([count_of_counts(self.pairs(shard, counts)[shard.hot[shard.pair_home] < 0]), count_of_counts(counts)])

    def word_stats(self, totals: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.count_nonzero(totals), totals.sum()], count_of_counts(totals)])

    def met_hot(self, home: np.ndarray, pairs: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        seen = pairs > 0
        home, pairs, words = home[seen], pairs[seen], words[seen]
        of = [pairs == r for r in range(1, TRUSTED + 2)] + [np.where(pairs > TRUSTED, pairs, 0)]
        of += [words == r for r in range(1, TRUSTED + 1)] + [np.where(words > TRUSTED, words, 0)]
        return np.stack([group_sum(home, n, x) for x in of], 1)

    def values(self, shard: Shard, counts: np.ndarray, pairs: np.ndarray, words: np.ndarray, stats: np.ndarray, word_stats: np.ndarray, hot: np.ndarray) -> np.ndarray:
        distinct, total, n = word_stats[0], word_stats[1], word_stats[2:]
        r = np.arange(1, TRUSTED + 1)
        rare_kept = discounted(r, n)
        left = float((n[:TRUSTED] * (r - rare_kept)).sum())
        whole = total
        if left <= 0:  # no rare word to take from: one more event is the unknown word
            left, whole = 1.0, total + 1.0
        # the unseen mass is shared by as many words as are likely not seen
        unknown = left / whole / unseen_words(n)
        below = np.where(words > 0, discounted(words, n) / whole, unknown)[shard.pair_word]
        n_pairs = stats[: TRUSTED + 1] + hot[:, : TRUSTED + 1].sum(0)
        at = np.flatnonzero(shard.hot >= 0)
        known = None
        if len(at):
            of = hot[shard.hot[at]]
            few, many, low, high = of[:, :TRUSTED], of[:, TRUSTED + 1], of[:, TRUSTED + 2 : 2 * TRUSTED + 2], of[:, -1]
            known = at, few @ r + many, few @ discounted(r, n_pairs) + many, few.sum(1) > 0, (low @ rare_kept + high) / whole
        p, self.weights = backed_off(pairs, discounted(pairs, n_pairs), below, shard.pair_home, len(shard.homes), known)
        if self.order == 3:
            p, self.context_weights = backed_off(counts, discounted(counts, stats[TRUSTED + 1 :]), p[shard.gram_pair], shard.gram_context, int(shard.gram_context.max(initial=-1)) + 1)
        seen = words[shard.pair_word][shard.gram_pair]
        base = np.log10((seen + 0.5) / (total + 0.5 * (distinct + 1)))
        # every text has one END, which so can bring a number to each text
        once = (shard.words == self.end)[shard.pair_word][shard.gram_pair]
        return np.stack([np.log10(p), base, (seen > 0).astype(float), np.where(once, total, 0.0)])

    def stored(self, shard: Shard, counts: np.ndarray, values: np.ndarray) -> bytes:
        seen = np.flatnonzero(counts > 0)
        pair, first = np.unique(shard.gram_pair[seen], return_index=True)
        parts = [deltas(shard.homes), deltas(shard.words), shard.pair_home[pair], shard.pair_word[pair], np.diff(np.append(first, len(seen))), counts[seen].astype(np.int64)]
        if self.order == 3:
            uniq, place = np.unique(shard.thirds[seen], return_inverse=True)
            parts += [deltas(uniq), place]
        weights = self.context_weights if self.order == 3 else np.zeros(0)
        return pack_small(*parts) + pack(self.weights.astype(np.float32).view(np.uint32), weights.astype(np.float32).view(np.uint32))


def katz_scores(docs: DataFrame, train: Column, scratch: Scratch | None = None, order: int = ORDER) -> DataFrame:
    """Score every text under a Katz model of the texts that ``train`` marks.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10 probability of the tokens, the end included). Before the first
    word stand ends. Words unknown to training share the Good-Turing mass of
    unseen words evenly, as many as are likely not seen. Two words are one where the first 36 or
    more bits of their hashes agree; the bits grow with the corpus.

    Null text: empty, one END token. Null doc_id: kept, null. Repeated rows:
    each is counted and scored. Empty table: no rows. No training text: every
    token has the same probability, 1. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.when(F.coalesce(train, F.lit(False)), 0).otherwise(1).alias("fold"), F.lit("").alias("grp"),
    )
    told = text_sums(rows, Katz(order), scratch or Scratch(spark, "katz"))
    return told.select(
        "doc_id", (F.col("fold") == 1).alias("held_out"), "n_tokens", F.round("n_known").cast("long").alias("n_known"),
        F.round("train_tokens").cast("long").alias("train_tokens"), "base_score", "score",
    )


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz scores of all documents, learnt from those whose id hash is not 1 modulo 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return katz_scores(docs, held_out() != 1)
