"""Byte-pair encoding and decoding with a given vocabulary of merges.

A word starts as one symbol a byte, in a doubly linked list. A priority queue
holds the possible merges by rank; an entry is stale, and skipped, once one of
its symbols has been merged into another. Decoding joins vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices

#: Distinct pieces that a worker remembers, and the longest that it does.
CACHE_PIECES, CACHE_CHARS = 200_000, 64
#: What the vocabulary's own configuration calls \s.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


#: The one kind of file that is read: its normaliser and pre-tokenizer, as files of it say them.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def refuse_others(spec: dict) -> None:
    """Raise ValueError for a file that asks for anything else than what Bpe does."""
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    fits = {
        "normalizer": (spec.get("normalizer") or {}).get("normalizers") == NORMALISER,
        "pre_tokenizer": len(steps) == 2 and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == (SPLIT, "Removed", True)
        and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False),
        "decoder": spec.get("decoder") is None, "post_processor": spec.get("post_processor") is None,
        "added_tokens": not any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        "model": model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")),
    }
    if not all(fits.values()):
        raise ValueError(f"this vocabulary asks for another {', '.join(k for k, v in fits.items() if not v)} than is built here")


class Bpe:
    """Encoder and decoder of one vocabulary file (JSON, BPE model)."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        refuse_others(spec)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.bytes = byte_symbols()
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.lengths: dict[str, int] = {}
        self.mark = os.path.commonprefix(list(self.added))
        self.split_added = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")

    def piece(self, text: str) -> list[int]:
        """Ids of one word: merge by rank with a queue over a linked list."""
        raw = text.encode()
        names = [self.bytes[b] for b in raw]
        names[-1] += self.suffix
        sym = [self.vocab[x] for x in names]
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, queue = self.ranks, []
        for i in range(n - 1):
            if found := ranks.get((sym[i], sym[i + 1])):
                queue.append((found[0], i, sym[i], sym[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i] if sym[i] == left else -1
            if j < 0 or sym[j] != right:
                continue  # stale
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((made, sym[k])):
                    heapq.heappush(queue, (found[0], i, made, sym[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((sym[h], made))):
                heapq.heappush(queue, (found[0], h, sym[h], made, found[1]))
        out, i = [], 0
        while i >= 0:
            out.append(sym[i])
            i = after[i]
        return out

    def normalise(self, text: str) -> str:
        """NFC, runs of white space to one space, lower case character by character."""
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        text = self.spaces.sub(" ", text)
        return text.replace("Σ", "σ").lower()

    def _known(self, piece: str) -> tuple[bytes, str]:
        got = self.cache.get(piece)
        if got is None:
            ids = self.piece(piece)
            got = (struct.pack(f"<{len(ids)}I", *ids), self.join(ids))
            if len(piece) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = got
        return got

    def join(self, ids: list[int]) -> str:
        """Vocabulary strings of the ids, with a space between, as the vocabulary asks."""
        return " ".join(map(self.strings.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text as little-endian 32-bit integers, and the text decoded from them."""
        parts: list[tuple[bytes, str]] = []
        at = 0
        marks = list(self.split_added.finditer(text)) if self.split_added and self.mark in text else []
        for mark in [*marks, None]:
            plain = text[at : mark.start() if mark else len(text)]
            if plain:
                known = self._known
                parts += [known(p) for p in self.pieces.findall(self.normalise(plain))]
            if mark:
                parts.append((struct.pack("<I", self.added[mark[0]]), mark[0]))
                at = mark.end()
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def n_ids(self, text: str) -> int:
        """How many ids a text has."""
        if self.split_added and self.mark in text:
            return len(self.encode(text)[0]) // 4
        lengths, total = self.lengths, 0
        for piece in self.pieces.findall(self.normalise(text)):
            n = lengths.get(piece)
            if n is None:
                n = len(self.piece(piece))
                if len(piece) <= CACHE_CHARS:
                    if len(lengths) >= CACHE_PIECES:
                        lengths.clear()
                    lengths[piece] = n
            total += n
        return total

    def decode(self, ids: bytes) -> str:
        """Decode packed ids."""
        return self.join([x[0] for x in struct.iter_unpack("<I", ids)])


@lru_cache(maxsize=2)
def load(source: bytes) -> Bpe:
    """The encoder of a vocabulary file, made once in each worker."""
    return Bpe(source)


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every whole text with the vocabulary file at a path.

    The file is one of a lower-casing BPE with word ends, without decoder (see
    refuse_others); any other raises ValueError.

    Adds ids (binary, little-endian unsigned 32-bit integers) and decoded to
    doc_id. Special tokens written out in a text become those tokens.

    Null text: empty, no ids, decoded to an empty text. Null doc_id: kept, null.
    Repeated rows: one row each. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary, "rb") as file:
        source = spark.sparkContext.broadcast(file.read())  # a public vocabulary of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(source.value)
        for batch in batches:
            texts = batch.column("text")
            for first, end, _, _ in text_slices(batch):
                got = [bpe.encode(t or "") for t in texts.slice(first, end - first).to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(first, end - first), "ids": pa.array([g[0] for g in got], pa.binary()), "decoded": pa.array([g[1] for g in got], pa.string())}
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Number of ids and digests of ids and decoded text, a row each.

    Null ids or decoded text: null counts and digests. Empty ones: none, and the
    digest of nothing. Empty table: no rows. Other columns are ignored.
    """
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json")))
