"""Quality rules with n-gram perplexity bands.

A modified Kneser-Ney model over word pairs is counted for every language that
the table holds, in shards of sorted hash arrays (see ngrams). Texts are dealt
into two halves, and each half is judged by the counts of the other, so that a
text does not vouch for itself. A text is rejected where its perplexity a token
leaves its language's band, on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK64, Scratch, Words, hashes, mix, shingles, sum_texts
from .ngrams import Model, Shard, group_sum, text_sums

#: Half-widths of a band in robust standard deviations of log perplexity. The lower
#: one is wider: a near copy of a text of the other half reads easily, and finding
#: copies is not what the band is for.
LOWER_WIDTH, UPPER_WIDTH = 10.0, 3.5
#: Languages up to which bands are broadcast; beyond, they are joined by shuffling.
BROADCAST_BANDS = 10_000

#: Words that one step over whole texts takes.
STEP_WORDS = 300_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_SPACE = b" \t\n\x0b\x0c\r"


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def in_steps(per_doc: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Runs of whole texts of about STEP_WORDS words: their texts, and their words."""
    ends, first = np.cumsum(per_doc), 0
    while first < len(per_doc):
        before = int(ends[first] - per_doc[first])
        last = max(first + 1, int(np.searchsorted(ends, before + STEP_WORDS, "right")))
        yield slice(first, last), slice(before, int(ends[last - 1]))
        first = last


def repeated_words(hashed: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Words of each text, given as hashes, that stand in a three-word window found twice or more in it."""
    n, doc = len(hashed), np.repeat(np.arange(len(per_doc)), per_doc)
    if n < 3:
        return np.zeros(len(per_doc), np.int64)
    inside = doc[: n - 2] == doc[2:]
    key = (shingles(hashed, 3) ^ (doc[: n - 2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[inside]
    order = np.argsort(key)
    key = key[order]
    again = np.zeros(len(key) + 1, bool)
    again[1:-1] = key[1:] == key[:-1]
    many = np.zeros(n - 2, bool)
    many[np.flatnonzero(inside)[order[again[1:] | again[:-1]]]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= many
    return np.bincount(doc[covered], minlength=len(per_doc))


def halves(hashed: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """The half of each text, by the smallest hash of its three-word runs."""
    least, doc = np.full(len(per_doc), MASK64, np.uint64), np.repeat(np.arange(len(per_doc)), per_doc)
    if len(hashed) > 2:
        inside = doc[:-2] == doc[2:]
        runs, doc = mix(shingles(hashed, 3))[inside], doc[:-2][inside]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        if len(first):
            least[doc[first]] = np.minimum.reduceat(runs, first)
    return (mix(least) & np.uint64(1)).astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts by count 0, 1, 2, 3 and over, from how many items are seen
    1 to 4 times; a half each where they are undefined."""
    out = np.array([0.0, 0.5, 0.5, 0.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for r in (1, 2, 3):
            if n[r - 1]:
                d = r - (r + 1) * y * n[r] / n[r - 1]
                out[r] = d if 0 < d < r else 0.5
    return out


def _few(counts: np.ndarray) -> np.ndarray:
    """How many items are seen 1, 2, 3 and 4 times."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].astype(float)


class KneserNey(Model):
    """Interpolated modified Kneser-Ney over pairs: natural log perplexity of each half under the other's counts.

    A word's continuation count is the number of distinct words before it. The
    lowest order mixes it with a uniform share over all words and one more, the
    unknown word.
    """

    order = 2
    folds = (0, 1)
    precision, hot_width = ("4",), 4
    sums = ("nats",)
    carried = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def of_fold(self, fold: int) -> int:
        return 1 - fold

    def columns(self, words: Words, codes: np.ndarray, dictionary: list[bytes]) -> dict[str, np.ndarray]:
        begin, end = words.offsets[:-1], words.offsets[1:]
        lines = [repeated_lines(words.data[a:b].tobytes()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        as_is = hashes(dictionary)
        again = np.concatenate([repeated_words(as_is[codes[w]], words.per_doc[d]) for d, w in in_steps(words.per_doc)])
        return {
            "word_chars": sum_texts(words.word & ~_CONTINUES[words.data], words.offsets), "n_symbols": sum_texts(_SYMBOL[words.data], words.offsets),
            "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": again.astype(np.int64),
        }

    def halves(self, words: Words, codes: np.ndarray, dictionary: list[bytes]) -> np.ndarray:
        low = hashes([w.lower() for w in dictionary])
        return np.concatenate([halves(low[codes[w]], words.per_doc[d]) for d, w in in_steps(words.per_doc)])

    def word_values(self, shard: Shard, counts: np.ndarray) -> np.ndarray:
        return group_sum(shard.pair_word, len(shard.words), counts > 0)

    def shard_stats(self, shard: Shard, counts: np.ndarray) -> np.ndarray:
        return _few(counts)

    def word_stats(self, totals: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.count_nonzero(totals), totals.sum()], _few(totals)])

    def shard_hot(self, shard: Shard, counts: np.ndarray, n: int) -> np.ndarray:
        home = shard.hot[shard.pair_home]
        mine, c = home >= 0, counts[home >= 0]
        return np.stack([group_sum(home[mine], n, x) for x in (c, c == 1, c == 2, c > 2)], 1)

    def values(self, shard: Shard, counts: np.ndarray, pairs: np.ndarray, words: np.ndarray, stats: np.ndarray, word_stats: np.ndarray, hot: np.ndarray) -> np.ndarray:
        distinct, total, few = word_stats[0], word_stats[1], word_stats[2:]
        d = discounts(few)
        if total:
            left = (d[1] * few[0] + d[2] * few[1] + d[3] * (distinct - few[0] - few[1])) / total
            lower = ((words - d[np.minimum(words, 3).astype(np.int64)]) / total + left / (distinct + 1))[shard.pair_word]
        else:
            lower = np.ones(len(counts))
        d2 = discounts(stats)
        taken = d2[np.minimum(counts, 3).astype(np.int64)]
        size, at = len(shard.homes), np.flatnonzero(shard.hot >= 0)
        seen, weight = group_sum(shard.pair_home, size, counts), group_sum(shard.pair_home, size, taken)
        seen[at], weight[at] = hot[shard.hot[at], 0], hot[shard.hot[at], 1:] @ d2[1:]
        seen, weight = seen[shard.pair_home], weight[shard.pair_home]
        p = np.where(seen > 0, (counts - taken + weight * lower) / np.maximum(seen, 1), lower)
        return -np.log(p)[None]


def quality_rules(docs: DataFrame, scratch: Scratch | None = None, widths: tuple[float, float] = (LOWER_WIDTH, UPPER_WIDTH)) -> DataFrame:
    """Rule counts, log perplexity and verdict of every text.

    base_failed: fewer than 50 words, or more than half of them in repeated
    windows. kept: not base_failed, and the text's log perplexity is within
    ``widths`` robust standard deviations (1.4826 times the median absolute
    deviation) of its language's median, taken over all texts that pass the base
    rules. The median and deviation are approximate within one part in 10,000.
    Words of the model are lower-cased from A to Z, and a text's end is a token.

    Null text: no words, base_failed. Null lang: a language of its own. A
    language of which the other half has no text: perplexity 1. Null doc_id:
    kept, null. Repeated rows: each is counted and judged. Empty table: no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "rules")
    lang = F.col("lang").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.lit(0).alias("fold"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("grp"),
    )
    told = text_sums(rows, KneserNey(), scratch).withColumn("n_words", F.col("n_tokens") - 1)
    measured = scratch.write(
        told.select("doc_id", "grp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("nats") / F.col("n_tokens")).alias("log_perplexity")), "measured"
    )
    measured = measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    good = measured.where("not base_failed")
    centre = scratch.write(good.groupBy("grp").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("centre")), "centre")
    few = centre.count() <= BROADCAST_BANDS
    hint = F.broadcast if few else (lambda df: df)
    spread = good.join(hint(centre), "grp").groupBy("grp", "centre").agg((1.4826 * F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("centre")), 0.5, 10000)).alias("spread"))
    bands = spread.select("grp", (F.col("centre") - widths[0] * F.col("spread")).alias("lower"), (F.col("centre") + widths[1] * F.col("spread")).alias("upper"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return measured.join(hint(bands), "grp", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "log_perplexity", "lower", "upper",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and perplexity bands over all documents."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
