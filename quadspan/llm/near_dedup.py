"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles; two are linked if their Jaccard similarity is ``percent`` or more.  Equal sets are
one class from the start, found by a 64-bit hash of the set, so copies cost one aggregation.

Each class has TOKENS minwise tokens.  A tree node is a path of chosen tokens and holds the classes that have all of
them.  A node with up to SMALL classes is compared exhaustively; a larger one branches: its path chooses one or two
further tokens, 1.25 on average, which is what a link at the threshold needs to survive down to any depth, and each
class goes to the children of its own values.  Trees are independent.  How many a class needs follows from the target
recall and from the depth of its deepest large node (``trees_needed``): five at depth one for 0.999.

Work goes in rounds, a level and sometimes some new trees at a time, with components joined after each: nodes that hold
one component only can't change a component and end.  A large node also compares random bounded groups of its classes,
each together with the same few pivots, so that a dense group of near copies becomes one component in its first round,
by a number of comparisons that is linear in the group.  A large node with few classes outside of its largest component
compares these with all of that component, block by block, and ends; that is linear, too.

Comparison is in two steps.  In a node, classes are kept that agree on enough tokens with one of another component;
what leaves a node is those classes, never pairs.  Then the node's kept classes meet with their full sets, of which a
matrix product gives all intersections exactly; what leaves it is a spanning tree of each group of linked components.
Components are merged by contracting each to its neighbour of the smallest random rank until no edge is left.

Nothing is collected, every group that a task gets is bounded, and a table in the shared folder goes as soon as the next
one has been written.

Defined cases: null or empty texts, or texts without words, have an empty set and are linked with nothing; texts of
fewer words than a shingle are one shingle; repeated rows share a class; rows without a key are in a component of the
smallest key of their class, else null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, narrow, release, row_hash, tidied
from .words import chunks, mix, shingles

TOKENS, ROOTS = 64, 32
#: Classes of a node that is compared exhaustively; classes and pivots of a random group of a larger node.
SMALL, GROUP, PIVOTS = 1024, 960, 16
#: A node with so few classes outside of its largest component compares them with all of that component.
OUTSIDE = 512
#: Classes of a group that are compared at once.
WIDE = 64
#: Trees of the first round.
START = 2
#: Large nodes of the last level are compared block by block, all pairs of blocks.
LEVELS = 24
#: One node in four has a second branch.
SECOND = 0.25
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
U = np.uint64


def least_agreement(percent: int) -> int:
    """Tokens on which a pair at the threshold agrees but for one case in ten thousand."""
    j = percent / 100
    return int(TOKENS * j - 4 * (TOKENS * j * (1 - j)) ** 0.5)


def trees_needed(depth: int, percent: int, recall: float) -> int:
    """Trees after which a link at the threshold, if it has to meet at this depth, has met with probability ``recall``."""
    j, below = percent / 100, 1.0
    for _ in range(depth - 1):
        below = 1 - ((1 - SECOND) * (1 - j * below) + SECOND * (1 - j * below) ** 2)
    return ceil(log(1 - recall) / log(1 - j * below)) if j < 1 else 1


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 8192):
        np.minimum(out, (s[at : at + 8192, None] * _A + _B).min(axis=0), out=out)
    return mix(out)


def class_of(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + U(len(s))]))[0].astype(np.int64))


def signatures(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """key, row, n, cls, roots, sketch.  row is the hash of a row, from docs; roots are the first ROOTS tokens, sketch has
    a byte of each token."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, t in chunks(b.column(1), lower=True):
                words, n, cls, roots, sketch = t.words(), [], [], [], []
                for i in range(t.n):
                    s = shingles(words[t.first[i] : t.first[i + 1]], k)
                    n.append(len(s))
                    if len(s):
                        m = minima(s)
                        cls.append(class_of(s))
                        roots.append((m[:ROOTS] >> U(32)).astype("<u4").tobytes())
                        sketch.append((m & U(255)).astype(np.uint8).tobytes())
                    else:
                        cls.append(None)
                        roots.append(None)
                        sketch.append(None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, t.n), b.column(2).slice(at, t.n), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(roots, pa.binary()), pa.array(sketch, pa.binary())], [key, "row", "n", "cls", "roots", "sketch"])

    return docs.select(key, text, "row").mapInArrow(tidied(run), f"{key} {kind}, row long, n long, cls long, roots binary, sketch binary")


def full_sets(docs: DataFrame, k: int, text: str) -> DataFrame:
    """cls, items: the sets themselves, each once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, t in chunks(b.column(0), lower=True):
                words, sets = t.words(), {}
                for i in range(t.n):
                    s = shingles(words[t.first[i] : t.first[i + 1]], k)
                    if (c := class_of(s)) not in seen:
                        seen.add(c)
                        sets[c] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], ["cls", "items"])

    return docs.select(text).mapInArrow(tidied(run), "cls long, items binary")


_NODES = ["depth", "node", "cls", "label", "n", "sketch"]
_NODE_TYPES = "depth int, node long, cls long, label long, n long, sketch binary"


def rooted(classes: DataFrame) -> DataFrame:
    """The roots of the trees low up to high of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            roots = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(-1, ROOTS)
            low, high = b.column(5).to_numpy(), b.column(6).to_numpy()
            for t in range(int(low.min()), int(high.max())):
                rows = np.flatnonzero((low <= t) & (t < high))
                seed = mix(np.array([t + 1], U))[0]
                node = mix(roots[rows, t % ROOTS].astype(np.uint64) ^ seed).astype(np.int64)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows), np.int32)), pa.array(node), *(b.column(i).take(at) for i in range(1, 5))], _NODES)

    return classes.select("roots", "cls", "label", "n", "sketch", "low", "high").mapInArrow(tidied(run), _NODE_TYPES)


def children(nodes: DataFrame) -> DataFrame:
    """The same a level deeper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            depth, node = pa.array(b.column(0).to_numpy() + 1), b.column(1).to_numpy().astype(np.uint64)
            sketch = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, TOKENS)
            h = mix(node ^ U(0x5851F42D4C957F2D))
            first = (h & U(63)).astype(np.int64)
            second = (first + 1 + ((h >> U(6)) % U(63)).astype(np.int64)) % TOKENS
            for choice, rows in ((first, np.arange(len(node))), (second, np.flatnonzero((h >> U(20)) % U(1000) < U(int(1000 * SECOND))))):
                c = choice[rows]
                child = mix(node[rows] * U(0xD1342543DE82EF95) + _C[c] * (sketch[rows, c].astype(np.uint64) + U(1)))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([depth.take(at), pa.array(child.astype(np.int64)), *(b.column(i).take(at) for i in range(2, 6))], _NODES)

    return nodes.select(*_NODES).mapInArrow(tidied(run), _NODE_TYPES)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds of groups) of batches that are sorted by their first column: no group is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(0)[-1] != b.column(0)[0]:
            cuts = np.concatenate(([0], cuts))
        if len(cuts):
            yield _bounded(pa.Table.from_batches([*held, b.slice(0, cuts[-1])]))
            held, b = [], b.slice(cuts[-1])
        held.append(b)
    if held:
        yield _bounded(pa.Table.from_batches(held))


def _bounded(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    keys = t.column(0).to_numpy()
    return t, np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)


def partners(label: np.ndarray, n: np.ndarray, sketch: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Which classes of some equally large groups may be linked with one of another component in their group."""
    agree = np.zeros((*n.shape, n.shape[1]), np.uint8)
    for token in range(TOKENS):
        agree += sketch[:, :, None, token] == sketch[:, None, :, token]
    sizes = 100 * np.minimum(n[:, :, None], n[:, None, :]) >= percent * np.maximum(n[:, :, None], n[:, None, :])
    return ((agree >= least) & (label[:, :, None] != label[:, None, :]) & sizes).any(axis=2)


def banded(label: np.ndarray, n: np.ndarray, sketch: np.ndarray, least: int, percent: int) -> np.ndarray:
    """The same for one large group: sets of similar sizes only are compared, each with those up to 100 / percent times as
    large, in runs by ascending size."""
    order, out = np.argsort(n, kind="stable"), np.zeros(len(n), bool)
    label, n, sketch = label[order], n[order], sketch[order]
    reach = np.searchsorted(n, n * 100 // percent, "right")
    at = 0
    while at < len(n):
        to = min(at + WIDE, len(n))
        x, y = slice(at, to), slice(at, int(reach[to - 1]))
        agree = np.zeros((to - at, y.stop - at), np.uint8)
        for token in range(TOKENS):
            agree += sketch[x, None, token] == sketch[None, y, token]
        good = (agree >= least) & (label[x, None] != label[None, y]) & (100 * n[x, None] >= percent * n[None, y])
        out[order[x][good.any(axis=1)]] = True
        out[order[y][good.any(axis=0)]] = True
        at = to
    return out


def close(groups: DataFrame, least: int, percent: int) -> DataFrame:
    """leaf, cls, label, n, sketch -> leaf, cls, label: the classes that may be linked with one of another component in
    their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches):
            label, n = t.column("label").to_numpy(), t.column("n").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
            by_size, keep = defaultdict(list), np.zeros(len(label), bool)
            for g, size in enumerate(np.diff(bounds).tolist()):
                if size > 1:
                    by_size[size].append(g)
            for size, found in by_size.items():
                if size > WIDE:
                    for g in found:
                        rows = bounds[g] + np.arange(size)
                        keep[rows[banded(label[rows], n[rows], sketch[rows], least, percent)]] = True
                    continue
                step = max(1, (1 << 20) // (size * size))
                for at in range(0, len(found), step):
                    rows = bounds[np.array(found[at : at + step])][:, None] + np.arange(size)
                    keep[rows[partners(label[rows], n[rows], sketch[rows], least, percent)]] = True
            if keep.any():
                yield t.select(["leaf", "cls", "label"]).filter(pa.array(keep)).combine_chunks().to_batches()[0]

    return groups.select("leaf", "cls", "label", "n", "sketch").mapInArrow(tidied(run), "leaf long, cls long, label long")


def intersections(items: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of some sets, by products of their incidence with the items that several have."""
    m = len(items)
    every = np.concatenate(items)
    owner = np.repeat(np.arange(m), [len(x) for x in items])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    several = np.bincount(number) > 1 if len(every) else np.zeros(0, bool)
    keep = several[number]
    column, owner = (np.cumsum(several) - 1)[number[keep]], owner[keep]
    out = np.zeros((m, m), np.float64)
    width = max(64, (1 << 21) // m)
    for at in range(0, int(several.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        dense = np.zeros((m, width), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def joined(members: DataFrame, percent: int) -> DataFrame:
    """leaf, label, items -> a, b: edges between labels that span each group of components which full sets link."""

    def edges(label: np.ndarray, items: list[np.ndarray]) -> list[tuple[int, int]]:
        size, both = np.array([len(x) for x in items]), intersections(items)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        linked |= label[:, None] == label[None, :]
        out, open_ = [], np.ones(len(label), bool)
        for i in range(len(label)):
            if not open_[i]:
                continue
            reached = np.zeros(len(label), bool)
            reached[i] = True
            front = reached
            while front.any():
                front = linked[front].any(axis=0) & ~reached
                reached = reached | front
            open_ &= ~reached
            first, *rest = np.unique(label[reached]).tolist()
            out += [(first, x) for x in rest]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches):
            label, items, found = t.column("label").to_numpy(), t.column("items"), []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s > 1:
                    found += edges(label[s:e], [np.frombuffer(x.as_buffer(), np.uint64) for x in items[s:e]])
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return members.select("leaf", "label", "items").mapInArrow(tidied(run), "a long, b long")


def contracted(edges: DataFrame, tables: Tables) -> DataFrame:
    """old, new for every vertex of the edges a, b: one new label for each component (one of its vertices)."""
    edges = tables.write(edges.distinct(), "edges")
    at = None
    while True:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        to = near.select(F.col("a").alias("u"), F.when(F.col("m") < F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")), F.col("m.v")).otherwise(F.col("a")).alias("p"))
        to = tables.write(to, "parents")
        of = narrow(to)
        if at is None:
            new = to.select(F.col("u").alias("old"), F.col("p").alias("new"))
        else:
            new = at.join(of, F.col("new") == F.col("u"), "left").select("old", F.coalesce("p", "new").alias("new"))
        at, old = tables.write(new, "labels"), at
        tables.drop(old)
        moved = edges.join(of.select(F.col("u").alias("a"), F.col("p").alias("x")), "a").join(of.select(F.col("u").alias("b"), F.col("p").alias("y")), "b")
        left = tables.write(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        tables.drop(edges, to)
        edges = left
        if edges.isEmpty():
            tables.drop(edges)
            return at


def relabelled(labels: DataFrame | None, moved: DataFrame, tables: Tables) -> DataFrame:
    """cls, label after labels (or classes without one) have moved from old to new."""
    if labels is None:
        return moved.select(F.col("old").alias("cls"), F.col("new").alias("label"))
    kept = labels.join(narrow(moved), F.col("label") == F.col("old"), "left").select("cls", F.coalesce("new", "label").alias("label"))
    fresh = moved.join(labels, F.col("old") == F.col("cls"), "left_anti").select(F.col("old").alias("cls"), F.col("new").alias("label"))
    out = tables.write(kept.unionByName(fresh), "labels")
    tables.drop(labels, moved)
    return out


def measured(nodes: DataFrame, merged: bool) -> DataFrame:
    """node, m, bulk, outside for nodes with classes of several components: how many classes it has, the component with
    most of them, and how many are outside of that one."""
    if not merged:
        return nodes.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1").select("node", "m", F.lit(None).cast("long").alias("bulk"), F.col("m").alias("outside"))
    by_label = nodes.groupBy("node", "label").agg(F.count("*").alias("c"))
    of = by_label.groupBy("node").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"))
    return of.select("node", "m", F.col("top.label").alias("bulk"), (F.col("m") - F.col("top.c")).alias("outside")).filter("outside > 0")


def dealt(live: DataFrame) -> DataFrame:
    """The groups in which nodes are compared: rows of live with a leaf.  Small nodes are groups of their own."""
    small, last, few = F.col("m") <= SMALL, F.col("depth") == LEVELS, F.col("outside") <= OUTSIDE
    place = lambda size: F.pmod(F.xxhash64("node", "cls"), F.ceil(size)).cast("int")
    upto = lambda size: F.sequence(F.lit(0), (F.ceil(size) - 1).cast("int"))
    blocks, bulk = F.col("m") / GROUP, (F.col("m") - F.col("outside")) / OUTSIDE
    pivot = F.pmod(F.xxhash64("cls", "node", F.lit(1)), F.col("m")) < PIVOTS
    pair = lambda x, y: F.least(x, y) * F.lit(1 << 20) + F.greatest(x, y)
    groups = (
        F.when(small, F.array(F.lit(0).cast("long")))
        .when(few & (F.col("label") == F.col("bulk")), F.array(place(bulk).cast("long")))
        .when(few, upto(bulk).cast("array<long>"))
        .when(last, F.transform(upto(blocks), lambda y: pair(place(blocks).cast("long"), y.cast("long"))))
        .when(pivot, upto(blocks).cast("array<long>"))
        .otherwise(F.array(place(blocks).cast("long")))
    )
    return live.withColumn("group", F.explode(groups)).withColumn("leaf", F.xxhash64("node", "group"))


def united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def sets_of(members: DataFrame, sets: list[DataFrame], reps: DataFrame, docs: DataFrame, k: int, key: str, text: str, tables: Tables) -> None:
    """Adds to sets a table of the full sets of members' classes that aren't there yet."""
    wanted = members.select("cls").distinct()
    for s in sets:
        wanted = wanted.join(s.select("cls"), "cls", "left_anti")
    wanted = tables.write(wanted.join(reps.select("cls", "first"), "cls").select(F.col("first.key").alias("_rep"), F.col("first.row").alias("_row")), "wanted")
    if not wanted.isEmpty():
        rows = docs.select(F.col(key).alias("_key"), text, row_hash(docs).alias("_hash"))
        texts = rows.join(narrow(wanted), F.col("_key").eqNullSafe(F.col("_rep")) & (F.col("_hash") == F.col("_row")), "left_semi")
        new = tables.write(full_sets(texts, k, text), "sets")
        if not new.groupBy("cls").count().filter("count > 1").isEmpty():  # equal rows in several tasks
            new, old = tables.write(new.groupBy("cls").agg(F.first("items").alias("items")), "sets"), new
            tables.drop(old)
        sets.append(new)
    tables.drop(wanted)


def classes(docs: DataFrame, k: int, percent: int, key: str, text: str, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and cls, component_id, first (the component's first row: smallest key, null last, then row)."""
    spark, tables, least = docs.sparkSession, Tables(docs.sparkSession), least_agreement(percent)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base, need = trees_needed(1, percent, recall), F.array(*(F.lit(trees_needed(d, percent, recall)) for d in range(1, LEVELS + 2)))
    sig = tables.write(signatures(docs.withColumn("row", row_hash(docs)), k, key, text), "signatures")
    first = F.min(F.struct(F.col(key).isNull().alias("keyless"), F.col(key).alias("key"), "row")).alias("first")
    reps = tables.write(sig.filter("cls is not null").groupBy("cls").agg(F.min(key).alias("rep"), first, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots")), "classes")
    labels, deep, last, sets = None, None, None, []
    start = min(START, base)
    nodes = rooted(reps.select("roots", "cls", F.col("cls").alias("label"), "n", "sketch", F.lit(0).alias("low"), F.lit(start).alias("high")))
    planted, old_nodes = start, None
    while True:
        live = tables.write(nodes.join(measured(nodes, labels is not None), "node"), "tree_nodes")
        groups = dealt(live).repartition(parts, "leaf").sortWithinPartitions("leaf")
        members = tables.write(close(groups, least, percent), "close")
        sets_of(members, sets, reps, docs, k, key, text, tables)
        if sets:
            full = united(sets).join(narrow(members), "cls").select("leaf", "label", "items").repartition(parts, "leaf").sortWithinPartitions("leaf")
            edges = tables.write(joined(full, percent), "links")
            if not edges.isEmpty():
                labels = relabelled(labels, contracted(edges, tables), tables)
            tables.drop(edges)
        tables.drop(members)
        release(spark)

        # what goes on: the children of large nodes, and the roots of further trees
        going = live.filter((F.col("m") > SMALL) & (F.col("outside") > OUTSIDE) & (F.col("depth") < LEVELS))
        going = tables.write(going.select(*_NODES), "large_nodes")
        tables.drop(live, old_nodes)
        now = going.groupBy("cls").agg((F.max("depth") + 1).alias("depth"), F.lit(base).alias("trees"))
        if deep is not None:
            now = now.unionByName(deep).groupBy("cls").agg(F.max("depth").alias("depth"), F.max("trees").alias("trees"))
        now = now.withColumn("goal", F.greatest("trees", F.element_at(need, F.col("depth"))))
        now, old = tables.write(now, "depths"), last
        tables.drop(old)
        last = now
        more = [children(going)]
        roots = now.filter("goal > trees").select("cls", F.col("trees").alias("low"), F.col("goal").alias("high"))
        more.append(rooted(reps.join(narrow(roots), "cls").select("roots", "cls", F.col("cls").alias("label"), "n", "sketch", "low", "high")))
        if planted < base:
            more.append(rooted(reps.select("roots", "cls", F.col("cls").alias("label"), "n", "sketch", F.lit(planted).alias("low"), F.lit(base).alias("high"))))
            planted = base
        deep = now.select("cls", "depth", F.col("goal").alias("trees"))
        new = united(more)
        if labels is not None:
            own = labels.select(F.col("cls").alias("_cls"), F.col("label").alias("_label"))
            new = new.join(narrow(own), F.col("cls") == F.col("_cls"), "left").withColumn("label", F.coalesce("_label", "cls")).select(*_NODES)
        nodes = old_nodes = tables.write(new, "nodes")
        tables.drop(going)
        if nodes.isEmpty():
            break
    of = reps.select("cls", "rep", "first")
    of = of.withColumn("label", F.col("cls")) if labels is None else of.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = of.groupBy("label").agg(F.min("rep").alias("component_id"), F.min("first").alias("first"))
    out = tables.write(of.select("cls", "label").join(smallest, "label").select("cls", "component_id", "first"), "components")
    tables.drop(reps, labels, last, nodes, *sets)
    return sig, out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", recall: float = 0.999) -> DataFrame:
    """key, n_shingles, component_id for every row."""
    sig, of = classes(docs, k, percent, key, text, recall)
    out = sig.select(key, F.col("n").alias("n_shingles"), "cls").join(of.drop("first"), "cls", "left")
    return out.select(key, "n_shingles", F.coalesce("component_id", F.when(F.col("cls").isNull(), F.col(key))).alias("component_id"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", recall: float = 0.999) -> DataFrame:
    """One row of each component, with the columns that it had: the smallest key, null last, then the smallest row hash.
    Rows without words are linked with nothing, so each of them stays."""
    sig, of = classes(docs, k, percent, key, text, recall)
    first = of.select("first.key", "first.row").distinct()
    # the first row may be there several times, equal in every column
    rows = sig.filter("cls is not null").groupBy(F.col(key).alias("_key"), F.col("row").alias("_row")).agg(F.count("*").alias("_n"))
    chosen = first.join(rows, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row"))).select("_key", "_row", (F.col("_n") > 1).alias("_many"))
    wordless = sig.filter("cls is null").select(F.col(key).alias("_key"), F.col("row").alias("_row"), F.lit(False).alias("_many")).distinct()
    kept = Tables(docs.sparkSession).write(chosen.unionByName(wordless), "kept_rows")
    named = docs.withColumn("_hash", row_hash(docs))
    here = named[key].eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_row"))
    out = named.join(narrow(kept.filter("not _many")), here, "left_semi")
    if not (many := kept.filter("_many")).isEmpty():
        out = out.unionByName(named.join(many, here, "left_semi").dropDuplicates([key, "_hash"]))
    return out.drop("_hash")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
