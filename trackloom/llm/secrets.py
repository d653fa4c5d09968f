"""Secret scans: pattern rules, and a character convolution network over candidates.

Three patterns find the base spans. Candidates are runs of key characters: from
CANDIDATE characters on with a digit in them, from LETTERS on without. Every
candidate is read whole, in overlapping windows with their surroundings, by a
small network in numpy: character embeddings folded into a convolution, ReLU,
maximum and mean over places, and a logit. It learns from labelled findings:
values of base spans are secrets, other candidates are not. So that the network
can find what the patterns cannot, every secret is also shown away from its
name, in other surroundings of its text, as it is and in other forms that keys
take: other case, base 64, letters and digits of both cases, groups with dashes.
A temperature, fitted to smoothed labels of findings held back, calibrates
probabilities. The threshold is the highest that keeps a stated recall over all
labelled secrets of the table, in all forms, that the network was not fitted on,
and a half at most.
Candidates over it become spans of kind "network"; base spans stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import cycle, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, text_slices

KINDS = ("assign", "access", "hex", "network")
#: Least length of a candidate with a digit, and of one without; characters of a
#: window and of each side of it that the network sees, and from a window to the next.
CANDIDATE, LETTERS, VALUE, SIDE, STEP = 6, 16, 48, 24, 24
#: Labelled findings of each class that the network learns from at most.
SAMPLE = 2_000
#: Recall that the threshold keeps on findings not fitted on, and the most that it is:
#: a finding whose calibrated probability is over a half is a secret.
RECALL, SURE = 0.98, 0.5
#: Findings without a label that a network which did not see them scores higher than this are not learnt from.
DOUBT = 0.4

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-@"]] = True
_NUMBER = np.zeros(256, bool)
_NUMBER[48:58] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80
_SWAPPED = np.arange(256, dtype=np.uint8)
_SWAPPED[65:91], _SWAPPED[97:123] = np.arange(97, 123), np.arange(65, 91)
#: Character classes of the network: code points under 128 as they are, one for all others, one for nothing.
ALPHABET, OTHER, NOTHING = 130, 128, 129
WIDTH, FILTERS = 5, 24
SPAN = SIDE + VALUE + SIDE


def runs(member: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of maximal runs of members, within texts, of a least length."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(member) + 1, bool)
    cut[offsets] = True
    begins = member.copy()
    begins[1:] &= ~member[:-1] | cut[1:-1]
    ends = member.copy()
    ends[:-1] &= ~member[1:] | cut[1:-1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = b - a >= least
    return a[long], b[long]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans of one text but for hex runs, which are found on bytes."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def window_starts(begin: int, end: int) -> np.ndarray:
    """Places of the windows over a candidate; the last one ends with it."""
    last = max(begin, end - VALUE)
    return np.append(np.arange(begin, last, STEP), last)


def classes(text: str, begin: int, end: int) -> bytes:
    """Character classes of a candidate's windows between their surroundings, at fixed places, one after the other."""

    def code(part: str) -> bytes:
        if part.isascii():
            return part.encode()
        return np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), OTHER).astype(np.uint8).tobytes()

    blank = bytes([NOTHING])
    before, after = code(text[max(0, begin - SIDE) : begin]), code(text[end : end + SIDE])
    before, after = blank * (SIDE - len(before)) + before, after + blank * (SIDE - len(after))
    value = code(text[begin:end])
    if len(value) <= VALUE:
        return before + value + blank * (VALUE - len(value)) + after
    whole = np.frombuffer(before + value + after, np.uint8)
    return whole[(window_starts(begin, end) - begin)[:, None] + np.arange(SPAN)].tobytes()


class Places:
    """The spans of one text, found by place; spans of one kind don't overlap."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.kinds = []
        for kind in {k for k, *_ in spans}:
            mine = sorted((s, e) for k, s, e in spans if k == kind)
            self.kinds.append(([s for s, _ in mine], [e for _, e in mine]))

    def touching(self, begin: int, end: int) -> Iterator[tuple[int, int]]:
        """Spans that share a character with the range."""
        for starts, ends in self.kinds:
            for k in range(bisect_right(ends, begin), bisect_left(starts, end)):
                yield starts[k], ends[k]

    def free(self, begin: int, end: int) -> bool:
        """Whether no span is in the range or next to it."""
        return all(bisect_left(ends, begin) >= bisect_right(starts, end) for starts, ends in self.kinds)


def window_labels(places: Places, begin: int, end: int) -> bytes:
    """For each window of a candidate 1 if a base span is in it, else 0."""
    starts = window_starts(begin, end)
    ends = np.minimum(starts + VALUE, end)
    inside = np.zeros(len(starts), bool)
    for s, e in places.touching(begin, end):
        inside[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = True
    return inside.astype(np.uint8).tobytes()


_BOTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


#: Keys of each other form that a secret is shown as.
DRAWS = 4


def forms(value: str) -> list[str]:
    """A secret as it is and in other forms that keys take, the same ones each time."""
    out = [value, value.swapcase()]
    for draw in range(DRAWS):
        stream = b"".join(hashlib.sha256(value.encode() + bytes([draw, k])).digest() for k in range(3))
        a, b, c, d = stream[-4:]
        groups = "".join(_UPPER[x % 36] for x in stream[:32])
        wide = 4 + a % 3
        out += [
            base64.b64encode(stream[: 16 + b % 25]).decode(), "".join(_BOTH[x % 62] for x in stream[: 20 + c % 29]),
            "-".join(groups[k * wide : (k + 1) * wide] for k in range(4 + a % 2)), stream[: 12 + d % 21].hex().upper(), stream[: 12 + c % 21].hex(),
            "".join(chr(97 + x % 26) for x in stream[40 : 42 + b % 2]) + "_" + "".join(_BOTH[x % 62] for x in stream[: 24 + d % 17]),
        ]
    return out


def surroundings(text: str, blanks: np.ndarray, places: Places, own: tuple[int, int], seed: int) -> tuple[str, str]:
    """Characters on both sides of a space of the text that is away from every span; after eight tries those of a span itself."""
    for k in range(8):
        nth = int(np.searchsorted(blanks, (seed >> (5 * k)) % max(1, len(text))))
        if nth < len(blanks):
            at = int(blanks[nth])
            if places.free(at - SIDE, at + SIDE):
                return text[max(0, at + 1 - SIDE) : at + 1], text[at : at + SIDE]
    return text[max(0, own[0] - SIDE) : own[0]], text[own[1] : own[1] + SIDE].lstrip("\"'")


def taught(text: str, spans: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """Windows with each secret of a text in all forms, away from its name: alone, and at the end of a path.

    One after the other, as a text may hold very many; the time for each doesn't grow with their number.
    """
    places = Places(spans)
    blanks = np.array([m.start() for m in re.finditer(" ", text)], np.int64) if spans else np.zeros(0, np.int64)
    for kind, begin, end in spans:
        value = _ASSIGN.match(text, begin)[2] if kind == "assign" else text[begin:end]
        for k, form in enumerate(forms(value)):
            before, after = surroundings(text, blanks, places, (begin, end), xxhash.xxh64_intdigest(form.encode(), k))
            yield classes(before + form + after, len(before), len(before) + len(form))
            path = "/".join(islice(cycle(re.findall(r"[a-z]+", before + after) or ["a"]), 8)) + "/"
            start, last = len(before), len(before) + len(path) + len(form)
            seen = np.minimum(window_starts(start, last) + VALUE, last) - np.maximum(window_starts(start, last), start + len(path))
            windows = _windows(classes(before + path + form + after, start, last))
            yield from (w for w, n in zip(windows, seen, strict=True) if n >= 0.75 * min(len(form), VALUE))


def order_key(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
_CANDIDATES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("labels", pa.binary()), ("classes", pa.binary())]))
_SPANS_SQL = "array<struct<kind:string,begin:long,end:long>>"
FOUND_SQL = f"doc_id long, base {_SPANS_SQL}, holder string, candidates array<struct<begin:long,end:long,labels:binary,classes:binary>>"


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: base spans and candidates of every text, in code points; the text itself where it has base spans (holder)."""
    for batch in batches:
        texts_all = batch.column("text")
        for first, end, data, offsets in text_slices(batch):
            texts = [t or "" for t in texts_all.slice(first, end - first).to_pylist()]
            points = np.append(0, np.cumsum(_STARTS[data]))
            base = [base_spans(t) for t in texts]
            for a, b in zip(*runs(_HEX[data], offsets, 24), strict=True):
                d = int(np.searchsorted(offsets, a, "right")) - 1
                base[d].append(("hex", int(points[a] - points[offsets[d]]), int(points[b] - points[offsets[d]])))
            places = [Places(spans) for spans in base]
            numbers = np.append(0, np.cumsum(_NUMBER[data]))
            a, b = runs(_KEY[data], offsets, CANDIDATE)
            taken = (numbers[b] > numbers[a]) | (b - a >= LETTERS) if len(a) else np.zeros(0, bool)
            candidates: list[list[dict]] = [[] for _ in texts]
            for lo, hi in zip(a[taken].tolist(), b[taken].tolist(), strict=True):
                d = int(np.searchsorted(offsets, lo, "right")) - 1
                x, y = int(points[lo] - points[offsets[d]]), int(points[hi] - points[offsets[d]])
                candidates[d].append({"begin": x, "end": y, "labels": window_labels(places[d], x, y), "classes": classes(texts[d], x, y)})
            rows = [[{"kind": k, "begin": s, "end": e} for k, s, e in sorted(spans, key=order_key)] for spans in base]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(first, end - first), "base": pa.array(rows, _SPANS),
                "holder": pa.array([t if spans else None for t, spans in zip(texts, base, strict=True)], pa.string()), "candidates": pa.array(candidates, _CANDIDATES),
            })


class CharNet:
    """Convolution over character classes with max and mean pooling, trained by Adam."""

    def __init__(self, codes: np.ndarray, labels: np.ndarray, seed: int = 11, epochs: int = 16, batch: int = 64, recall: float = RECALL):
        rng = np.random.default_rng(seed)
        held = np.zeros(len(codes), bool)
        for label in (0, 1):
            mine = rng.permutation(np.flatnonzero(labels == label))
            held[mine[: max(len(mine) // 4, int(len(mine) > 1))]] = True
        # findings without a label may be secrets that no pattern knows: each half of them is
        # judged by a network that learnt from the other, and what it takes for a secret is left out
        half, doubtful = rng.random(len(codes)) < 0.5, np.zeros(len(codes), bool)
        self.temperature = 1.0
        for side in (half, ~half):
            use = ~held & ((labels == 1) | side)
            if (labels[use] == 0).any():
                self._fit(codes[use], labels[use].astype(float), rng, max(1, epochs // 2), batch)
                judged = np.flatnonzero((labels == 0) & ~side)
                doubtful[judged] = self.score(codes[judged]) > DOUBT
        if not ((labels == 0) & ~doubtful & ~held).any():
            doubtful[:] = False
        self._fit(codes[~held & ~doubtful], labels[~held & ~doubtful].astype(float), rng, epochs, batch)
        held &= ~doubtful
        test = held if held.any() else ~held
        logit, target = self.logit(codes[test]), labels[test]
        # smoothed labels: findings that are told apart without fault still have a best temperature
        goal = np.where(target > 0, (np.sum(target > 0) + 1) / (np.sum(target > 0) + 2), 1 / (np.sum(target == 0) + 2))
        grid = np.geomspace(0.05, 50, 120)
        self.temperature = float(grid[int(np.argmin([np.mean(np.logaddexp(0, logit / s) - goal * logit / s) for s in grid]))])
        sure = np.sort(self.score(codes[test])[target > 0])
        self.threshold = min(SURE, float(sure[int(np.floor((1 - recall) * len(sure)))])) if len(sure) else SURE
        self.fitted = frozenset(row.astype(np.uint8).tobytes() for row in codes[~held])

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int, batch: int) -> None:
        self.p = [rng.normal(0, 0.1, (WIDTH, ALPHABET, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1)]
        # each finding again in the surroundings of one of the other label, so that the value counts
        secret, other = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        moved = x.copy()
        for mine, theirs in ((secret, other), (other, secret)):
            lend = x[rng.choice(theirs, len(mine))] if len(theirs) else x[mine]
            moved[mine, :SIDE], moved[mine, SIDE + VALUE :] = lend[:, :SIDE], lend[:, SIDE + VALUE :]
        joined = self._joined(x, secret, other, rng)
        # what is no secret, in the other case: capitals alone make none
        cased = _SWAPPED[x[other]]
        x, y = np.vstack([x, moved, joined, cased]), np.concatenate([y, y, np.ones(len(joined)), np.zeros(len(cased))])
        # labels weigh the same, however many findings they have
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                k = order[lo : lo + batch]
                t += 1
                for a, g in enumerate(self._gradients(x[k], y[k], weight[k])):
                    m[a], v[a] = 0.9 * m[a] + 0.1 * g, 0.999 * v[a] + 0.001 * g * g
                    self.p[a] -= 0.005 * (m[a] / (1 - 0.9**t)) / (np.sqrt(v[a] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _joined(x: np.ndarray, secret: np.ndarray, other: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Secrets right behind the end of a value that is none."""
        out = x[secret].copy()
        if not len(other):
            return out[:0]
        value = slice(SIDE, SIDE + VALUE)
        for row, j in zip(out, rng.choice(other, len(secret)), strict=True):
            before = np.append(x[j, :SIDE], x[j, value][x[j, value] != NOTHING])
            own, cut = row[value][row[value] != NOTHING], int(rng.integers(2, 17))
            whole = np.append(before[-cut:], own)[:VALUE]
            row[value] = np.append(whole, np.full(VALUE - len(whole), NOTHING))
            row[:SIDE] = np.append(np.full(SIDE, NOTHING), before[:-cut])[-SIDE:]
        return out

    def _maps(self, codes: np.ndarray) -> np.ndarray:
        places = SPAN - WIDTH + 1
        return sum(self.p[0][o][codes[:, o : o + places]] for o in range(WIDTH)) + self.p[1]

    def _gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        maps = self._maps(codes)
        act = np.maximum(maps, 0)
        n, places, _ = act.shape
        top = act.argmax(1)
        pooled = np.hstack([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(1)])
        d = (1 / (1 + np.exp(-np.clip(pooled @ self.p[2] + self.p[3], -30, 30))) - y) * weight / n
        back = np.repeat((d[:, None] * self.p[2][FILTERS:] / places)[:, None], places, 1)
        i, f = np.meshgrid(np.arange(n), np.arange(FILTERS), indexing="ij")
        back[i, top, f] += d[:, None] * self.p[2][:FILTERS]
        back *= maps > 0
        kernel = np.zeros_like(self.p[0])
        flat = back.reshape(-1, FILTERS)
        for o in range(WIDTH):
            which = codes[:, o : o + places].reshape(-1)
            order = np.argsort(which, kind="stable")
            uniq, first = np.unique(which[order], return_index=True)
            kernel[o][uniq] = np.add.reduceat(flat[order], first, axis=0)
        return [kernel + 1e-5 * self.p[0], back.sum((0, 1)), pooled.T @ d + 1e-4 * self.p[2], d.sum(keepdims=True)]

    def logit(self, codes: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(codes), 512):
            act = np.maximum(self._maps(codes[lo : lo + 512]), 0)
            out.append(np.hstack([act.max(1), act.mean(1)]) @ self.p[2] + self.p[3])
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(codes) / self.temperature, -30, 30)))


def _codes(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, SPAN)


def _windows(blob: bytes) -> list[bytes]:
    return [blob[k : k + SPAN] for k in range(0, len(blob), SPAN)]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[list[dict], Iterator[bytes]]]:
    """Candidates of each text, and the forms of its secrets."""
    for row, base, text in zip(batch.column("candidates"), batch.column("base"), batch.column("holder"), strict=True):
        text = text.as_py()
        yield row.as_py(), taught(text, [(s["kind"], s["begin"], s["end"]) for s in base.as_py()]) if text else iter(())


class Smallest:
    """The distinct windows of smallest hash, of all that are added, so many; their order is that of xxhash64 in Spark."""

    def __init__(self, size: int):
        self.size, self.kept, self.last = size, {}, None

    def add(self, found: Iterable[bytes]) -> None:
        for w in found:
            key = ((xxhash.xxh64_intdigest(w, 42) ^ 1 << 63) - (1 << 63), w)
            if self.last is None or key < self.last:
                self.kept[w] = key
                if len(self.kept) >= 2 * self.size + 64:
                    self.cut()

    def cut(self) -> list[bytes]:
        keys = sorted(self.kept.values())[: self.size]
        self.kept = {w: (h, w) for h, w in keys}
        self.last = keys[-1] if keys and len(keys) == self.size else self.last
        return list(self.kept)


def windows(sample: int):
    """Map: of the windows of candidates and of forms of secrets, by label, those of smallest hash, ``sample`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {0: Smallest(sample), 1: Smallest(sample)}
        for batch in batches:
            for row, shown in _rows(batch):
                for c in row:
                    for w, label in zip(_windows(c["classes"]), c["labels"], strict=True):
                        best[label].add((w,))
                for blob in shown:
                    best[1].add(_windows(blob))
        for label, found in best.items():
            mine = found.cut()
            yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(mine), pa.int32()), "classes": pa.array(mine, pa.binary())})

    return run


#: Windows that are scored at once.
SCORED = 4096


def unseen_scores(net: CharNet):
    """Map: score of every labelled secret, in every form, that the network was not fitted on, that of its best window, as the bits of a double."""

    def scored(found: list[list[bytes]]) -> pa.RecordBatch:
        first = np.append(0, np.cumsum([len(w) for w in found])[:-1])
        best = np.maximum.reduceat(net.score(_codes([b"".join(w) for w in found])), first)
        return pa.RecordBatch.from_pydict({"bits": pa.array(best.astype(np.float64).view(np.int64))})

    def secrets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        for batch in batches:
            for row, shown in _rows(batch):
                for c in row:
                    yield [w for w, label in zip(_windows(c["classes"]), c["labels"], strict=True) if label]
                yield from map(_windows, shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for mine in secrets(batches):
            if mine and not any(w in net.fitted for w in mine):
                held.append(mine)
                n += len(mine)
                if n >= SCORED:
                    yield scored(held)
                    held, n = [], 0
        if held:
            yield scored(held)

    return run


def lowest_kept(scores: DataFrame, recall: float) -> float | None:
    """Highest threshold that ``recall`` of the scores (column bits, of doubles from 0 on) reach; None without scores.

    Doubles from 0 on have the order of their bits, which are counted 16 at a time.
    """
    prefix, skip = 0, None
    for shift in (48, 32, 16, 0):
        mine = scores.where(F.shiftright("bits", shift + 16) == prefix) if shift < 48 else scores
        table = mine.groupBy(F.shiftright("bits", shift).alias("bin")).count().toArrow().sort_by("bin")
        if not table.num_rows:
            return None
        counts = np.cumsum(table["count"].to_numpy())
        skip = int(np.floor((1 - recall) * counts[-1])) if skip is None else skip
        at = int(np.searchsorted(counts, skip, "right"))
        skip -= int(counts[at - 1]) if at else 0
        prefix = table["bin"][at].as_py()
    return float(np.array([prefix], np.int64).view(np.float64)[0])


def train(found: DataFrame, scratch: Scratch, sample: int = SAMPLE, recall: float = RECALL) -> CharNet | None:
    """Network from at most ``sample`` findings of each label, those of smallest hash; None if a label is missing.

    Its threshold is taken over all labelled secrets that are not of the fit.
    """
    rows = found.select("candidates", "base", "holder")
    each = rows.mapInArrow(windows(sample), "label int, classes binary").distinct()
    parts = [each.where(F.col("label") == k).orderBy(F.xxhash64("classes"), "classes").limit(sample).toArrow() for k in (0, 1)]
    if not all(p.num_rows for p in parts):
        return None
    blobs = [b for p in parts for b in p["classes"].to_pylist()]
    net = CharNet(_codes(blobs), np.repeat([0, 1], [p.num_rows for p in parts]), recall=recall)
    kept = lowest_kept(scratch.write(rows.mapInArrow(unseen_scores(net), "bits long"), "unseen"), recall)
    net.threshold = net.threshold if kept is None else min(SURE, kept)
    return net


def judge(net: CharNet | None):
    """Map: all spans of each text, the network's added to the base ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, candidates = batch.column("base").to_pylist(), batch.column("candidates").to_pylist()
            flat = [(d, c) for d, row in enumerate(candidates) for c in row]
            spans = [list(row) for row in base]
            if net and flat:
                scores = net.score(_codes([c["classes"] for _, c in flat]))
                labels = np.frombuffer(b"".join(c["labels"] for _, c in flat), np.uint8)
                first = np.append(0, np.cumsum([len(c["labels"]) for _, c in flat])[:-1])
                for (d, c), over in zip(flat, np.logical_or.reduceat((scores >= net.threshold) & (labels == 0), first), strict=True):
                    if over:
                        spans[d].append({"kind": "network", "begin": c["begin"], "end": c["end"]})
            for row in spans:
                row.sort(key=lambda s: order_key((s["kind"], s["begin"], s["end"])))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, _SPANS)})

    return run


def scan_secrets(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Spans of secrets of every whole text: doc_id and spans (kind, begin, end in code points, end exclusive).

    Null text: empty, no spans. Null doc_id: kept, null. Repeated rows: each is
    scanned; equal findings teach once. No finding of either label: base spans
    only. Empty table: no rows. Other columns are ignored. Texts with very many
    secrets: time and memory grow with their number, no faster.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "secrets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.write(rows.mapInArrow(find, FOUND_SQL), "found")
    return found.mapInArrow(judge(train(found, scratch)), f"doc_id long, spans {_SPANS_SQL}")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span replaced; overlapping spans become one mark. Null text or spans: null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, s, mark) for t, s in zip(texts, found, strict=True)], dtype=object)

    return run(text, spans)


def redacted(text: str | None, spans: Iterable[dict] | None, mark: str) -> str | None:
    """One text, spans in order of their begin."""
    if text is None or spans is None:
        return None
    parts, at = [], 0
    for s in spans:
        if s["begin"] >= at:
            parts += [text[at : s["begin"]], mark]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents, with counts and digest of the base ones."""
    spans = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    told = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "network")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count("network"))
