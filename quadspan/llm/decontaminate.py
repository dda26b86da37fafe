"""Benchmark decontamination: SimHash over item-sized windows, a multi-index for Hamming balls, exact verification.

A benchmark item of m words is compared with every window of m words of every document (a shorter document is one
window).  Windows and items are multisets of 5-word shingles, lower-cased, and SimHash turns each into 64 bits.  A
multi-index of the items' fingerprints has eight blocks of eight bits; two fingerprints within 23 bits agree in some
block to two bits, so looking up each block's neighbours finds all items within that radius.  Candidates are verified by
the exact weighted Jaccard similarity of the multisets, sum of minima over sum of maxima, 80 % or more.

A window with too few shingles of any item can't reach the similarity and is never hashed; that is exact, and spares
most of the text.
Documents are read once, where they lie, for each slice of the benchmark; a slice has a bounded number of items, so what
a task holds doesn't grow with the benchmark.  A worker builds the index of a slice once and keeps it for its later tasks.

Defined cases: null or empty texts and items match nothing; an item of under five words matches only a document that
consists of just these words; repeated rows of documents are reported each; of several windows the most similar, then
first, is reported; an empty table gives an empty result; clashing names in the two tables don't matter, as only ids and
texts are read.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidied
from .words import Texts, chunks, shingles, windows

SHINGLE, PERCENT = 5, 80
BLOCKS, NEAR = 8, 2
#: Guaranteed by BLOCKS blocks that are each looked up to NEAR bits.
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Items of one slice of the benchmark.
SLICE = 20_000
SLICE_BYTES = 32 << 20
#: Shingles of a document that are worked on at once.
PIECE = 1 << 16
_U1, U8 = np.uint64(1), np.uint64(255)
_SHIFTS = np.arange(64, dtype=np.uint64)
_BALL = [[v for v in range(256) if (v ^ u).bit_count() <= NEAR] for u in range(256)]


def signs(hashes: np.ndarray) -> np.ndarray:
    """For each hash 64 numbers, 1 or -1."""
    return (((hashes[:, None] >> _SHIFTS) & _U1).astype(np.int8) * 2 - 1).astype(np.int32)


def pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)


class Index:
    """The items of a slice."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.counts, self.sizes, self.prints, self.whole = [], [], [], [], defaultdict(list)
        self.lengths: dict[int, list[int]] = defaultdict(list)
        for item, text in items:
            for _, t in chunks(pa.array([text], pa.string()), lower=True):
                w = t.words()
                if 0 < len(w) < SHINGLE:
                    self.whole[int(shingles(w, SHINGLE)[0])].append(item)
                elif len(w):
                    s = windows(w, SHINGLE)
                    self.lengths[len(w)].append(len(self.ids))
                    self.ids.append(item)
                    self.counts.append(Counter(s.tolist()))
                    self.sizes.append(len(s))
                    self.prints.append(pack(signs(s).sum(axis=0)[None, :])[0])
        self.prints = np.array(self.prints, np.uint64)
        self.shingles = np.unique(np.array([k for c in self.counts for k in c], np.uint64))
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        #: For each length: its items, and for each block and value of it which of them lie within NEAR bits.
        self.near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m, items in self.lengths.items():
            table = np.zeros((BLOCKS, 256, len(items)), bool)
            for k, i in enumerate(items):
                for b in range(BLOCKS):
                    table[b, _BALL[(int(self.prints[i]) >> (8 * b)) & 255], k] = True
            self.near[m] = (np.array(items), table)

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Which shingles are some item's."""
        out = self.coarse[(s >> np.uint64(44)).astype(np.int64)]
        if at := np.flatnonzero(out).tolist():
            at = np.array(at)
            place = np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)
            out[at] = self.shingles[place] == s[at]
        return out

    def lookup(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS bits, for windows of an item length, by the multi-index."""
        items, table = self.near[length]
        found = table[0][(prints & U8).astype(np.int64)]
        for b in range(1, BLOCKS):
            found |= table[b][((prints >> np.uint64(8 * b)) & U8).astype(np.int64)]
        window, k = np.nonzero(found)
        close = np.bitwise_count(prints[window] ^ self.prints[items[k]]) <= RADIUS
        return window[close], items[k[close]]

    def match(self, s: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, first word, words, sum of minima, sum of maxima) of a document's best windows.  s: its shingles."""
        best: dict[int, tuple] = {}
        longest = max(self.lengths, default=0)
        for at in range(0, len(s), PIECE):
            if hit[at : at + PIECE + longest].any():
                self._match(s[at : at + PIECE + longest], hit[at : at + PIECE + longest], at, len(s), best)
        return list(best.values())

    def _match(self, s: np.ndarray, hit: np.ndarray, offset: int, whole: int, best: dict[int, tuple]) -> None:
        """The windows that begin in the first PIECE shingles of a part of a document."""
        total = np.concatenate(([0], np.cumsum(hit)))
        sums = np.zeros((len(s) + 1, 64), np.int32)
        np.cumsum(signs(s), axis=0, out=sums[1:])
        for m, items in self.lengths.items():
            n = min(m - SHINGLE + 1, whole)
            if n > len(s):
                continue
            # at most so many shingles are shared; where that can't reach the similarity, nothing is hashed
            most = total[n:] - total[: len(s) - n + 1]
            most = most[:PIECE]
            starts = np.flatnonzero((most > 0) & (100 * most >= PERCENT * (n + m - SHINGLE + 1 - most)))
            if not len(starts):
                continue
            for at, i in zip(*(x.tolist() for x in self.lookup(pack(sums[starts + n] - sums[starts]), m))):
                at = int(starts[at])
                window = Counter(s[at : at + n].tolist())
                low = sum(min(c, self.counts[i][k]) for k, c in window.items() if k in self.counts[i])
                high = n + self.sizes[i] - low
                if 100 * low >= PERCENT * high and (i not in best or low * best[i][4] > best[i][3] * high):
                    best[i] = (self.ids[i], offset + at, n + SHINGLE - 1, low, high)

    def scan(self, t: Texts) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text number, item, first word, words, sum of minima, sum of maxima)."""
        w = t.words()
        if len(self.shingles) and len(w) >= SHINGLE:
            s = windows(w, SHINGLE)
            hit = self.hits(s)
            ends = t.first[1:] - SHINGLE + 1
            # windows that reach into the next text are no shingles
            for i in np.unique(np.searchsorted(t.first, np.flatnonzero(hit), "right") - 1).tolist():
                a, e = int(t.first[i]), int(ends[i])
                if e > a and hit[a:e].any():
                    for found in self.match(s[a:e], hit[a:e]):
                        yield i, *found
        if self.whole:
            for i in np.flatnonzero((np.diff(t.first) > 0) & (np.diff(t.first) < SHINGLE)).tolist():
                for item in self.whole.get(int(shingles(w[t.first[i] : t.first[i + 1]], SHINGLE)[0]), ()):
                    yield i, item, 0, int(t.first[i + 1] - t.first[i]), 1, 1


#: The index that this worker used last, by the name of its slice: workers live on from task to task.
_LAST: dict[str, Index] = {}


def index_of(name: str, shared: Broadcast) -> Index:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Index(shared.value)
    return _LAST[name]


def slices_of(items: DataFrame) -> int:
    """How many slices keep a broadcast within SLICE items and SLICE_BYTES bytes of text, on average."""
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    return max(1, -(-n // SLICE), -(-(size or 0) // SLICE_BYTES))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, first_word, n_words, shared, total for each document and item of it: the best window's place and the
    two sums, whose quotient is the similarity."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    items = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    slices = slices_of(items)
    out = None
    for k in range(slices):
        part = [(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = index_of(name, shared)
            for b in batches:
                for at, t in chunks(b.column(1), lower=True):
                    if rows := list(index.scan(t)):
                        ids = b.column(0).slice(at, t.n).take(pa.array([r[0] for r in rows]))
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[j] for r in rows], pa.int64() if j > 1 else None) for j in range(1, 6))], [key, item, "first_word", "n_words", "shared", "total"])

        found = docs.select(key, text).mapInArrow(tidied(scan), f"{key} {kind}, {item} {item_kind}, first_word long, n_words long, shared long, total long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with the columns that they had."""
    items = benchmark.select(F.col("item_id").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    slices = slices_of(items)
    at, out = docs.columns.index(text), docs
    for k in range(slices):
        part = [(0, r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = index_of(name, shared)
            for b in batches:
                for place, t in chunks(b.column(at), lower=True):
                    clean = np.ones(t.n, bool)
                    clean[[r[0] for r in index.scan(t)]] = False
                    yield b.slice(place, t.n).filter(pa.array(clean))

        out = out.mapInArrow(tidied(keep), docs.schema)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("similarity", F.col("shared") / F.col("total"))
