"""Repeated passages across documents by common-prefix intervals of an enhanced suffix array.

A passage of LENGTH bytes that repeats has the same least GRAM-byte hash wherever it stands, so suffixes are only taken
at such anchors (one position in fourteen): every repeated passage holds an anchor at the same offset in each copy.

1. Texts are packed to chunks of about two MB, a row each, with the positions of their anchors.
2. A chunk sends each of its different anchors once, as a hash with a count, in packed blocks by ranges of the hash, and
   gets back for each whether another document may have it, and whether it is frequent.
3. At shared anchors a context is taken: the bytes behind the anchor that a passage can reach (the suffix) and those
   before it (its left extension).  Equal contexts of a chunk are sent once, with their occurrences, in packed blocks.
   Those of a block range are sorted to a suffix array with the lengths of common prefixes.  A stack scan gives its
   common-prefix intervals.  In each, the left extensions are sorted and scanned alike: an interval of these ends where
   the next byte to the left differs, so it is left-diverse, and (left, right) is a maximal repeat with all occurrences.
   Those of LENGTH bytes or more count, with the smallest document among the occurrences.
4. An anchor with more than MANY occurrences, as in a passage that a third of all documents hold, has no single task.
   Its tree is cut by prefix lengths instead: two contexts are in an interval of at least r common bytes that share
   LENGTH - r bytes to the left just if that window of LENGTH bytes is the same, so its windows of each r are grouped by
   a hash of 128 bits, each sent once for a chunk and summed up before the shuffle.
5. Every occurrence in a document that isn't the smallest is removed.  Spans are found on the input.  A chunk's reaches are
   merged to maximal runs before they meet its text, so they stay few bytes beside it and the texts needn't be dealt.

The number of ranges follows from the number of chunks, so a task's share doesn't grow with the data.

Defined cases: null or empty texts have no bytes; texts under LENGTH bytes lose nothing; rows with one id don't remove
each other's passages, but each of them loses what a smaller id has; a null id counts as larger than any other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, release, tidied
from .words import _BYTES, Texts, chunks, mix, powers

LENGTH, GRAM = 50, 24
#: Occurrences of an anchor that one task compares.
MANY = 50_000
#: Chunks for each range of anchors.
RANGE = 8
#: Bytes of flags or spans that may be broadcast to the chunks.
BROADCAST_BYTES = 64 << 20
U = np.uint64
_MASK40 = U((1 << 40) - 1)
LAST = (1 << 63) - 1


def grams(t: Texts, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of each run of ``size`` bytes, or of those at some positions."""
    n = len(t.data) - size + 1
    if n <= 0:
        return np.empty(0, U)
    up, down = powers(len(t.data))
    prefix = np.zeros(len(t.data) + 1, U)
    np.cumsum(_BYTES[t.data] * up[: len(t.data)], out=prefix[1:])
    if at is not None:
        return mix((prefix[at + size] - prefix[at]) * down[at])
    return mix((prefix[size:] - prefix[:-size]) * down[:n])


def anchors(t: Texts, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Positions of the least gram of each window; of equal ones the leftmost."""
    h = grams(t, gram)
    wide = length - gram + 1
    if len(h) < wide:
        return np.empty(0, np.int64)
    bits = U(max(32, int(len(h)).bit_length()))  # the same for all but huge texts, so ties are resolved alike
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < wide:
        step = min(have, wide - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    ends = np.repeat(t.bounds[1:], np.diff(t.bounds))[: len(low)]
    inside = np.arange(len(low)) + length <= ends
    at = (low[inside] & ((U(1) << bits) - U(1))).astype(np.int64)
    # the least position of a window doesn't go back from one window to the next
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def contexts(t: Texts, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each position the bytes around it, left ones nearest first, then right ones; 0xFF beyond the text."""
    left = length - gram
    text = np.searchsorted(t.bounds, at, "right") - 1
    spread = at[:, None] + np.concatenate((-1 - np.arange(left), np.arange(length)))
    good = (spread >= t.bounds[text][:, None]) & (spread < t.bounds[text + 1][:, None])
    return np.where(good, t.data[np.clip(spread, 0, len(t.data) - 1)], 255).astype(np.uint8)


def row_hash(rows: np.ndarray, seed: int = 0x243F6A8885A308D3) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    out = np.full(len(rows), seed, U)
    for word in padded.view(np.uint64).T:
        out = mix(out * U(0x9E3779B97F4A7C15) + word)
    return out


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, whose order is that of the bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(U)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes rows of a and b share; bytes beyond the text aren't shared."""
    different = (a != b) | (a == 255)
    return np.where(different.any(axis=1), different.argmax(axis=1), a.shape[1])


def intervals(lcp: list[int], least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common prefix, first, last) of every common-prefix interval, by one stack scan.  lcp[i] is that of entries i and
    i + 1; intervals below least[i], of the entry at which they end, are left out."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, n in enumerate(lcp):
        start = i
        while stack and stack[-1][0] > n:
            value, start = stack.pop()
            if value >= least[i]:
                out.append((value, start, i))
        if n >= least[i] and (not stack or stack[-1][0] < n):
            stack.append((n, start))
    end = len(lcp)
    out += [(value, start, end) for value, start in stack if value >= least[-1]] if stack else []
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) for each member of ranges first to last."""
    sizes = last - first + 1
    which = np.repeat(np.arange(len(first)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which]


def repeats(a: np.ndarray, rows: np.ndarray, low: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For different contexts, sorted by anchor and suffix, with their smallest documents: how far maximal repeats of
    ``length`` bytes or more that a smaller document also has reach before and behind each anchor; 0 if none."""
    left_size, n = length - gram, len(a)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return before, after
    right = rows[:, left_size:]
    lcp = np.where(a[1:] == a[:-1], common(right[:-1], right[1:]), 0)
    prefix, i, j = intervals(lcp.tolist(), [gram] * n)
    if not len(prefix):
        return before, after
    which, member = spread(i, j)
    left = rows[member][:, :left_size]
    order = np.lexsort((*_words(left).T[::-1], which))
    which, member, left = which[order], member[order], left[order]
    need = length - prefix[which]
    lcp = np.where(which[1:] == which[:-1], common(left[:-1], left[1:]), 0)
    # two different contexts share no whole left extension and suffix, but a suffix interval may need no left byte at all
    lcp = np.where((which[1:] == which[:-1]) & (lcp >= need[1:]), lcp + 1, 0)
    suffix, x, y = intervals(lcp.tolist(), [1] * len(which))
    if not len(suffix):
        return before, after
    group, place = spread(x, y)
    starts = np.cumsum(y - x + 1) - (y - x + 1)
    context = member[place]
    smallest = np.minimum.reduceat(low[context], starts)[group]
    hit = smallest < low[context]
    np.maximum.at(before, context[hit], (suffix - 1)[group[hit]])
    np.maximum.at(after, context[hit], prefix[which[x]][group[hit]])
    return before, after


def packed(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """key, id, text -> chunk, keys, ids, sizes, data, at: rows of about two MB of text, compressed, with the distances
    between their anchors (a byte each, 255 for each 255 more)."""
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for b in batches:
            for k, t in chunks(b.column(2)):
                far, near = np.divmod(np.diff(anchors(t, length, gram), prepend=0), 255)
                at = np.full(int((far + 1).sum()), 255, np.uint8)
                at[np.cumsum(far + 1) - 1] = near
                lists = [pa.ListArray.from_arrays(pa.array([0, t.n], pa.int32()), pa.concat_arrays([b.column(i).slice(k, t.n)])) for i in range(2)]
                rest = [np.diff(t.bounds).astype("<u4").tobytes(), squeeze.compress(t.data.tobytes()), at.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, *(pa.array([x], pa.binary()) for x in rest)], ["chunk", "keys", "ids", "sizes", "data", "at"])
                chunk += 1

    return texts.select("key", "id", "text").mapInArrow(tidied(run), f"chunk long, keys array<{kind}>, ids array<long>, sizes binary, data binary, at binary")


#: What a chunk needs to be read.
CHUNK = ("chunk", "keys", "ids", "sizes", "data", "at")


class Chunk:
    """One row of the packed texts."""

    def __init__(self, b: pa.RecordBatch, i: int, gram: int):
        number, keys, ids, sizes, data, at = (b.column(b.schema.names.index(n))[i] for n in CHUNK)
        self.number, self.keys, self.gram = number.as_py(), keys.values, gram
        self.ids = ids.values.to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(np.frombuffer(sizes.as_buffer(), "<u4").astype(np.int64))))
        self.text = Texts(np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), np.uint8), bounds)
        steps = np.frombuffer(at.as_buffer(), np.uint8)
        self.at = np.cumsum(steps, dtype=np.int64)[steps != 255]

    def hashes(self) -> np.ndarray:
        return grams(self.text, self.gram, self.at) & _MASK40 if len(self.at) else np.empty(0, U)

    def owners(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.text.bounds, at, "right") - 1]


def opened(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[tuple[Chunk, pa.RecordBatch, int]]:
    for b in batches:
        for i in range(b.num_rows):
            yield Chunk(b, i, gram), b, i


def _range_of(a: np.ndarray, ranges: int) -> np.ndarray:
    return ((a * U(ranges)) >> U(40)).astype(np.int64)


def shared_anchors(texts: DataFrame, ranges: int, gram: int, many: int) -> DataFrame:
    """chunk, flags: for each range of a chunk's different anchors, in ascending order, whether another document may have
    it (1) or it is frequent (2).  Equal hashes of different anchors only flag some in vain."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, _, _ in opened(batches, gram):
            h = c.hashes()
            if not len(h):
                continue
            a, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            ids = c.owners(c.at)
            lowest, highest = np.full(len(a), LAST), np.full(len(a), -LAST)
            np.minimum.at(lowest, inverse, ids)
            np.maximum.at(highest, inverse, ids)
            # a count of one stands for a single document
            count = np.where(lowest == highest, 1, np.minimum(count, 65_535)).astype("<u2")
            cuts = np.searchsorted(_range_of(a, ranges), np.arange(ranges + 1))
            five = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), c.number)), pa.array([five[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary()), pa.array([count[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary())], ["range", "chunk", "a", "n"])

    def meet(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in table.column("a").to_pylist()]
        wide = np.zeros((sum(map(len, blocks)), 8), np.uint8)
        wide[:, :5] = np.concatenate(blocks)
        a, n = wide.view("<u8").ravel(), np.frombuffer(b"".join(table.column("n").to_pylist()), "<u2").astype(np.int64)
        order = np.argsort(a, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], a[order][1:] != a[order][:-1])))
        total = np.repeat(np.add.reduceat(n[order], start), np.diff(np.append(start, len(a))))
        flag = np.empty(len(a), np.uint8)
        flag[order] = np.where(total > many, 2, np.where(total > 1, 1, 0))
        cuts = np.cumsum([0, *map(len, blocks)])
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "flags": pa.array([np.packbits(flag[s:e] > 0).tobytes() + np.packbits(flag[s:e] == 2).tobytes() for s, e in zip(cuts[:-1], cuts[1:])], pa.binary()), "hot": pa.array([bool((flag[s:e] == 2).any()) for s, e in zip(cuts[:-1], cuts[1:])])})

    sent = texts.select(*CHUNK).mapInArrow(tidied(send), "range long, chunk long, a binary, n binary")
    found = sent.groupBy("range").applyInArrow(meet, "chunk long, range long, flags binary, hot boolean")
    return found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", "flags"))).alias("flags"), F.max("hot").alias("hot"))


def flagged(c: Chunk, flags: pa.Scalar, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the flag of each of a chunk's anchors."""
    h = c.hashes()
    a, inverse = np.unique(h, return_inverse=True)
    sizes = np.bincount(_range_of(a, ranges), minlength=ranges)
    every = []
    for x in flags.as_py():
        n, bits = int(sizes[x["range"]]), np.frombuffer(x["flags"], np.uint8)
        every.append(np.unpackbits(bits[: len(bits) // 2], count=n) + np.unpackbits(bits[len(bits) // 2 :], count=n))
    return h, np.concatenate(every)[inverse]


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(x := a.tobytes()).to_bytes(8, "little") + x for a in arrays))


def _arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for k in kinds:
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, k, n // np.dtype(k).itemsize, at + 8))
        at += 8 + n
    return out


def reaches(known: DataFrame, ranges: int, length: int, gram: int) -> DataFrame:
    """chunk, reach: packed positions of occurrences that are removed, with how far before and behind them."""
    left, size = length - gram, 2 * length - gram

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, b, i in opened(batches, gram):
            h, flag = flagged(c, b.column(b.schema.names.index("flags"))[i], ranges)
            keep = flag == 1
            at, a = c.at[keep], h[keep]
            if not len(at):
                continue
            around, ids = contexts(c.text, at, length, gram), c.owners(at)
            order = np.lexsort((at, row_hash(around), a))
            at, a, around, ids = at[order], a[order], around[order], ids[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (around[1:] != around[:-1]).any(axis=1)))
            which, first = np.cumsum(new) - 1, np.flatnonzero(new)
            cuts = np.searchsorted(_range_of(a[first], ranges), np.arange(ranges + 1))
            full, edges, rows = np.flatnonzero(np.diff(cuts)), np.append(first, len(a)), []
            for r in full.tolist():
                s, e = cuts[r], cuts[r + 1]
                x, y = edges[s], edges[e]
                rows.append(_blob(a[first[s:e]], around[first[s:e]], (which[x:y] - s).astype(np.uint32), at[x:y].astype(np.uint32), ids[x:y]))
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), c.number)), pa.array(rows, pa.binary())], ["range", "chunk", "block"])

    def scan(table: pa.Table) -> pa.Table:
        parts = [_arrays(x, "u8", "u1", "u4", "u4", "i8") for x in table.column("block").to_pylist()]
        a, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).reshape(-1, size)
        offsets = np.cumsum([0, *(len(p[0]) for p in parts)])
        which = np.concatenate([p[2].astype(np.int64) + o for p, o in zip(parts, offsets)])
        at, ids = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(p[2]) for p in parts])
        # the suffix array: by anchor, the bytes behind it, the bytes before it
        order = np.lexsort((*_words(rows[:, :left]).T[::-1], *_words(rows[:, left:]).T[::-1], a))
        a, rows = a[order], rows[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        a, rows, which = a[new], rows[new], number[which]
        low = np.full(len(a), LAST)
        np.minimum.at(low, which, ids)
        several = np.concatenate(([False], a[1:] == a[:-1]))
        several[:-1] |= several[1:]
        before, after = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        before[several], after[several] = repeats(a[several], rows[several], low[several], length, gram)
        # equal contexts are a repeat that reaches as far as any passage through the anchor can
        whole = rows != 255
        full = whole[:, :left].cumprod(axis=1).sum(axis=1), whole[:, left:].cumprod(axis=1).sum(axis=1)
        larger = ids > low[which]
        b, e = np.where(larger, full[0][which], before[which]), np.where(larger, full[1][which], after[which])
        return _reach(chunk, at, b, e)

    blocks = known.select(*CHUNK, "flags").mapInArrow(tidied(send), "range long, chunk long, block binary")
    return blocks.groupBy("range").applyInArrow(scan, "chunk long, reach binary")


def _reach(chunk: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.Table:
    hit = before + after > 0
    chunk, at, before, after = chunk[hit], at[hit], before[hit], after[hit]
    order = np.argsort(chunk, kind="stable")
    chunk, start, end = chunk[order], (at - before)[order].astype(np.uint32), (at + after)[order].astype(np.uint32)
    first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(chunk) else np.empty(0, np.int64)
    return pa.table({"chunk": pa.array(chunk[first], pa.int64()), "reach": pa.array([_blob(start[s:e], end[s:e]) for s, e in zip(first, np.append(first, len(chunk))[1:])], pa.binary())})


def frequent_reaches(known: DataFrame, ranges: int, length: int, gram: int, tables: Tables) -> DataFrame:
    """The same for frequent anchors, whose windows are grouped by their hashes."""
    left = length - gram
    windows = lambda rows, x: np.concatenate((rows[:, :x], rows[:, left : left + length - x]), axis=1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, b, i in opened(batches, gram):
            _, flag = flagged(c, b.column(b.schema.names.index("flags"))[i], ranges)
            at = c.at[flag == 2]
            if not len(at):
                continue
            rows, ids = contexts(c.text, at, length, gram), c.owners(at)
            order = np.argsort(row_hash(rows), kind="stable")
            at, rows, ids = at[order], rows[order], ids[order]
            first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
            low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
            occurrences = [_blob(at[s:e].astype(np.uint32), ids[s:e]) for s, e in zip(first, np.append(first, len(at))[1:])]
            rows = rows[first]
            for x in range(left + 1):
                window = windows(rows, x)
                real = np.flatnonzero((window != 255).all(axis=1))
                take = lambda v: pa.array(v[real])
                h = [(row_hash(window[real], seed) ^ mix(np.full(len(real), x, U))).astype(np.int64) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                number = pa.array(real.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(len(real), c.number)), number, pa.array(np.full(len(real), x)), take(low), take(high), pa.array([occurrences[k] for k in real] if x == 0 else [None] * len(real), pa.binary())], ["w1", "w2", "chunk", "context", "before", "low", "high", "places"])
            # contexts that are too near the start of a text for x = 0 still need their places
            late = np.flatnonzero(~(windows(rows, 0) != 255).all(axis=1))
            none = pa.nulls(len(late), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(late), c.number)), pa.array(late.astype(np.int64)), none, none, none, pa.array([occurrences[k] for k in late], pa.binary())], ["w1", "w2", "chunk", "context", "before", "low", "high", "places"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for number, places, found in zip(*(b.column(i) for i in range(3))):
                at, ids = _arrays(places.as_py(), "u4", "i8")
                before, after = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                for f in found.as_py():
                    hit = ids > f["lowest"]
                    before[hit], after[hit] = np.maximum(before[hit], f["before"]), np.maximum(after[hit], length - f["before"])
                for o, v in zip(out, (np.full(len(at), number.as_py()), at, before, after)):
                    o.append(v)
            if out[0]:
                yield from _reach(*map(np.concatenate, out)).to_batches()

    rows = tables.write(known.filter("hot").select(*CHUNK, "flags").mapInArrow(tidied(send), "w1 long, w2 long, chunk long, context long, before long, low long, high long, places binary"), "windows")
    lowest = rows.filter("w1 is not null").groupBy("w1", "w2").agg(F.min("low").alias("lowest"), F.max("high").alias("highest")).filter("lowest < highest").select("w1", "w2", "lowest")
    hit = rows.drop("places").join(lowest, ["w1", "w2"]).filter("lowest < high")
    hit = hit.groupBy("chunk", "context").agg(F.collect_set(F.struct("before", "lowest")).alias("found"))
    places = rows.filter("places is not null").select("chunk", "context", "places")
    return places.join(hit, ["chunk", "context"]).select("chunk", "places", "found").mapInArrow(tidied(unpack), "chunk long, reach binary")


def runs(found: DataFrame) -> DataFrame:
    """chunk, runs: the reaches of each chunk as maximal runs of removed bytes, which may go over the ends of texts: the
    distances between their starts and ends, compressed.  An anchor stands every fourteen bytes, so a run has many reaches."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for reach in b.column(1):
                parts = [_arrays(x, "u4", "u4") for x in reach.as_py()]
                start, end = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(2))
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.concatenate(([True], start[1:] > end[:-1]))
                edges = np.stack((start[new], end[np.append(new[1:], True)]), axis=1).ravel()
                out.append(_blob(np.diff(edges, prepend=0).astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["chunk", "runs"])

    return found.groupBy("chunk").agg(F.collect_list("reach").alias("reach")).mapInArrow(tidied(merge), "chunk long, runs binary")


def light(df: DataFrame, size: Column) -> DataFrame:
    """df, marked for a broadcast if its rows' sizes sum up to few enough bytes; else the chunks are shuffled."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """key, n_bytes, spans (start, end of each maximal removed run), kept (the remaining bytes) for every row."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    tables = Tables(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.col(text).alias("text"))
    texts = tables.write(packed(rows, length, gram), "chunks")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.count() // RANGE)
    shared = tables.write(shared_anchors(texts, ranges, gram, many), "shared_anchors")
    release(spark)
    known = texts.join(light(shared, F.aggregate("flags", F.lit(0), lambda n, x: n + F.length(x["flags"]))), "chunk")
    parts = [tables.write(reaches(known, ranges, length, gram), "reaches")]
    release(spark)
    if not shared.filter("hot").isEmpty():
        parts.append(tables.write(frequent_reaches(known, ranges, length, gram, tables), "frequent_reaches"))
        release(spark)
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    spans = tables.write(runs(found), "spans")
    tables.drop(shared, *parts)
    release(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, b, i in opened(batches, gram):
            t, n = c.text, len(c.text.data)
            edges = np.zeros(n + 1, np.int64)
            if (x := b.column(b.schema.names.index("runs"))[i].as_py()) is not None:
                at = np.cumsum(_arrays(x, "u4")[0], dtype=np.int64)
                edges[at[::2]], edges[at[1::2]] = 1, -1
            gone = np.cumsum(edges[:-1]) > 0
            # runs of removed bytes; none goes over the end of a text
            first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            first[t.bounds[:-1]] = last[t.bounds[1:]] = True
            before, behind = np.concatenate(([False], gone)), np.concatenate((gone, [False]))
            starts, ends = np.flatnonzero(behind & (~before | first)), np.flatnonzero(before & (~behind | last))
            at = np.searchsorted(starts, t.bounds)
            owner = np.searchsorted(t.bounds, starts, "right") - 1
            list_of = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - t.bounds[owner]), pa.array(ends - t.bounds[owner])], ["s", "e"]))
            kept, left = np.concatenate(([0], np.cumsum(~gone))), t.data[~gone].tobytes()
            cuts = kept[t.bounds].tolist()
            rest = pa.array([left[s:e] for s, e in zip(cuts[:-1], cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([c.keys, pa.array(np.diff(t.bounds)), list_of, rest], [key, "n_bytes", "spans", "kept"])

    spans = light(spans, F.length("runs"))
    return texts.join(spans, "chunk", "left").select(*CHUNK, "runs").mapInArrow(tidied(run), f"{key} {kind}, n_bytes long, spans array<struct<s: long, e: long>>, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
