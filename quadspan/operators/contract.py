"""Graphs in logarithmic rounds: pointer jumping, contracted strands, components, reach and longest paths.

A strand is a run of nodes that each have one edge in and one out.  Pointer jumping ranks the nodes of all strands at
once, in as many rounds as the longest has binary digits; the graph of the other nodes, with one edge for a strand, is
what hop-by-hop work is left for.  Every round joins on single nodes, aggregates by node before it shuffles, and writes
what is still open, so nothing is collected and no plan grows.  Once no more than ``SMALL`` edges are left, as counted, one
task finishes them.

Links that stand near one another in their table are first combined where they stand, a block of rows at a time, as counts
are before a shuffle; only links that go on in another block are jumped over and dealt.  What occurs once is told by hashes,
which are dealt instead of nodes; nodes with equal hashes are compared themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import small
from ..storage import Scratch

c, lit = F.col, F.lit
#: Edges that one task finishes.
SMALL = 50_000
#: Trimming goes on alone while it leaves at most this part of the edges; else strands are contracted as well.
MOVED = 0.9
#: Links that are combined where they stand.
BLOCK = 500_000
#: Hashes (8 bytes each) that are broadcast.
HASHES = 2_000_000
#: How the values of two links in a row combine: name -> (value of the first, of the second, row's other values) -> value.
Combine = dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]]


def _steps(near: Callable[[str], Column], far: Callable[[str], Column]) -> Column:
    return near("steps") + far("steps")


def _finished(edges: DataFrame, run: Callable[[dict[str, list]], dict[str, list]], like: DataFrame) -> DataFrame:
    """run on the columns of a few edges, in one task; like: a frame with the result's columns."""
    names = edges.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {n: [] for n in names}
        for b in batches:
            for n in names:
                columns[n] += b.column(n).to_pylist()
        yield pa.RecordBatch.from_pydict(run(columns))

    return edges.coalesce(1).mapInArrow(task, like.schema)


def _strong(x: list, y: list) -> dict:
    """The root of each node's strongly connected component: two depth-first walks without recursion."""
    out: dict = {}
    into: dict = {}
    for a, b in zip(x, y, strict=True):
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    order, seen = [], set()
    for start in [*out, *into]:
        if start in seen:
            continue
        seen.add(start)
        walk = [(start, iter(out.get(start, ())))]
        while walk:
            node, rest = walk[-1]
            for b in rest:
                if b not in seen:
                    seen.add(b)
                    walk.append((b, iter(out.get(b, ()))))
                    break
            else:
                order.append(node)
                walk.pop()
    root: dict = {}
    for start in reversed(order):
        stack = [start] if start not in root else []
        while stack:
            node = stack.pop()
            if node not in root:
                root[node] = start
                stack += [a for a in into.get(node, ()) if a not in root]
    return root


def _cycles_of(edges: dict[str, list]) -> dict[str, list]:
    """node, root of a few edges."""
    root = _strong(edges["x"], edges["y"])
    on = {a for a, b in zip(edges["x"], edges["y"], strict=True) if root[a] == root[b]}
    on |= {b for a, b in zip(edges["x"], edges["y"], strict=True) if root[a] == root[b]}
    return {"node": list(on), "root": [root[n] for n in on]}


def _longest_of(edges: dict[str, list]) -> dict[str, list]:
    """The most that any node has, over a few edges (x, y, plus, least, has, has_y: what x and y have so far)."""
    root = _strong(edges["x"], edges["y"])
    has, waits, out = {}, dict.fromkeys(root, 0), {}
    for a, b, plus, least, of_a, of_b in zip(*(edges[n] for n in ("x", "y", "plus", "least", "has", "has_y")), strict=True):
        has[a], has[b] = max(has.get(a, 0), of_a), max(has.get(b, 0), of_b)
        if root[a] != root[b]:
            out.setdefault(a, []).append((b, plus, least))
            waits[b] += 1
    ready = [n for n, k in waits.items() if not k]
    while ready:
        a = ready.pop()
        for b, plus, least in out.get(a, ()):
            has[b] = max(has[b], has[a] + plus, least)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return {"has": [max(has.values(), default=0)]}


def _roots_of(edges: dict[str, list]) -> dict[str, list]:
    """node, root: the least node of each component of a few edges."""
    up: dict = {}

    def top(n):
        while up.setdefault(n, n) != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in zip(edges["x"], edges["y"], strict=True):
        p, q = sorted((top(a), top(b)))
        up[q] = p
    return {"node": list(up), "root": [top(n) for n in up]}


def repeated(values: DataFrame) -> DataFrame:
    """The values of a one-column frame that several rows have, each once."""
    (name,), tables = values.columns, Scratch(values.sparkSession)
    values = values.filter(c(name).isNotNull())
    twice = tables.put(values.select(F.xxhash64(name).alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"), "hashes")
    near = F.broadcast(twice) if twice.count() <= HASHES else twice
    return tables.keep(tables.put(values.join(near, F.xxhash64(name) == c("_h"), "left_semi").groupBy(name).agg(F.count("*").alias("_n")).filter("_n > 1").select(name), "repeated"))


def parted(rows: DataFrame, name: str, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose column is in a one-column frame of values, and those where it isn't; rows stay where they are unless their
    hash is one of a value's, or values are many."""
    values = values.toDF("_v")
    if values.count() > HASHES:
        return rows.join(values, c(name) == c("_v"), "left_semi"), rows.join(values, c(name) == c("_v"), "left_anti")
    hashes = F.broadcast(values.select(F.xxhash64("_v").alias("_h"), lit(True).alias("_in")).distinct())
    marked = rows.join(hashes, F.xxhash64(name) == c("_h"), "left")
    doubt, sure = marked.filter("_in").select(*rows.columns), marked.filter("_in is null").select(*rows.columns)
    return doubt.join(values, c(name) == c("_v"), "left_semi"), sure.unionByName(doubt.join(values, c(name) == c("_v"), "left_anti"))


def _combined(links: DataFrame) -> DataFrame:
    """node, at, steps, low, open of links (node, next): for each block of rows, how far the block's links lead from a node;
    low is the least node on the way, null if it is the node or ``at``.  Links that lead to a cycle of the block's stay as
    they are and are open."""

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        n = sum(b.num_rows for b in held)
        ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in held]).combine_chunks().dictionary_encode()
        codes, names = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends.dictionary
        node, next_ = codes[:n], codes[n:]
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        to = np.full(len(names), -1)
        to[node] = next_
        has = to >= 0
        at, steps, low = np.where(has, to, np.arange(len(to))), has.astype(np.int64), np.where(has, np.minimum(rank, rank[to]), rank)
        live = np.flatnonzero(has & has[at])
        for _ in range(n.bit_length() + 1):
            far = at[live]
            steps[live], low[live], at[live] = steps[live] + steps[far], np.minimum(low[live], low[far]), at[far]
            live = live[has[at[live]]]
        at[live], steps[live], low[live] = to[live], 1, np.minimum(rank[live], rank[to[live]])
        open_ = np.zeros(len(to), bool)
        open_[live] = True
        plain = low == np.minimum(rank, rank[at])
        lows = names.take(pa.array(order[low[node]], pa.int64(), mask=plain[node]))
        nodes = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
        return pa.RecordBatch.from_arrays([nodes, names.take(pa.array(at[node])), pa.array(steps[node]), lows, pa.array(open_[node])], ["node", "at", "steps", "low", "open"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK:
                yield run(held)
                held = []
        if sum(x.num_rows for x in held):
            yield run(held)

    kind = links.schema["node"].dataType.simpleString()
    return links.select("node", "next").mapInArrow(task, f"node {kind}, at {kind}, steps long, low {kind}, open boolean")


def jump(links: DataFrame, combine: Combine | None = None) -> DataFrame:
    """node, end, steps, cycle of links (node, next), where a node has one next at most: the node without a next that is
    reached, in how many steps; where a cycle is reached instead, end is null and cycle its least node.

    Other columns of links are values of a link; ``combine`` says how those of consecutive links combine."""
    if combine:
        start = links.withColumn("steps", lit(1).cast("long"))
        return _jumped(start.select("node", c("next").alias("at"), F.least("node", "next").alias("low"), "steps", *combine), {"steps": _steps} | combine)
    tables = Scratch(links.sparkSession)
    runs = tables.put(_combined(links), "runs")
    rest = runs.filter("not open")
    # the nodes where runs of different blocks meet
    meets = runs.select(F.xxhash64("node").alias("_h")).join(rest.select(F.xxhash64("at").alias("_h")).distinct(), "_h", "left_semi")
    meets = tables.put(meets.distinct(), "meets")
    near = F.broadcast(meets) if meets.count() <= HASHES else meets
    met = runs.join(near, F.xxhash64("node") == c("_h"), "left_semi").filter("not open").unionByName(runs.filter("open"))
    part = tables.put(met.select("node", "at", F.coalesce("low", F.least("node", "at")).alias("low"), "steps", "open"), "met")
    if part.isEmpty():
        return tables.keep(tables.put(rest.select("node", c("at").alias("end"), "steps", lit(None).cast(runs.schema["node"].dataType).alias("cycle")), "ranks"))
    far = _jumped(part.drop("open"), {"steps": _steps})
    on = tables.put(far.join(near, F.xxhash64("node") == c("_h"), "left_semi").select(c("node").alias("at"), c("end").alias("far"), c("steps").alias("more"), "cycle"), "meets")
    led = rest.join(small(on), "at", "left").select("node", F.when(c("more").isNull(), c("at")).otherwise(c("far")).alias("end"), (c("steps") + F.coalesce("more", lit(0))).alias("steps"), "cycle")
    out = led.unionByName(far.join(part.filter("open").select("node"), "node", "left_semi"))
    return tables.keep(tables.put(out.select("node", "end", "steps", "cycle"), "ranks"))


def _jumped(start: DataFrame, combine: Combine) -> DataFrame:
    """``jump`` of links (node, at, low, steps, values): low is the least node from node to at."""
    tables, kind = Scratch(start.sparkSession), start.schema["node"].dataType
    carried = list(combine)
    open_ = tables.put(start, "links")
    rounds = max(1, open_.count()).bit_length() + 1
    done: list[DataFrame] = []
    for _ in range(rounds):
        near, far = (lambda n: c(f"a.{n}")), (lambda n: c(f"b.{n}"))
        known = open_
        for d in done:
            known = known.unionByName(d)
        met = open_.alias("a").join(known.alias("b"), c("a.at") == c("b.node"), "left")
        on = c("b.node").isNotNull()
        stepped = met.select(c("a.node").alias("node"), F.when(on, c("b.at")).otherwise(c("a.at")).alias("at"), F.least("a.low", "b.low").alias("low"), *(F.when(on, f(near, far)).otherwise(near(n)).alias(n) for n, f in combine.items()), (~on).alias("over"))
        stepped = tables.put(stepped, "jumped")
        tables.drop(open_)
        # a link whose end has no link is over; those that met one that is over are found so in the next round
        done.append(stepped.filter("over").drop("over"))
        open_ = stepped.filter("not over").drop("over")
        if open_.isEmpty():
            break
    # in more steps than there are links: a cycle, whose least node its nodes have all met
    within = open_.select(c("node").alias("at"), c("low").alias("cycle"))
    round_ = open_.join(within, "at").select("node", lit(None).cast(kind).alias("end"), *carried, "cycle")
    out = round_
    for d in done:
        out = out.unionByName(d.select("node", c("at").alias("end"), *carried, lit(None).cast(kind).alias("cycle")))
    return tables.keep(tables.put(out, "ranks"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, ins, outs"""
    ends = edges.select(c("x").alias("node"), lit(0).alias("i"), lit(1).alias("o")).unionByName(edges.select(c("y").alias("node"), lit(1).alias("i"), lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))


def strands(edges: DataFrame, keep: DataFrame | None = None, combine: Combine | None = None) -> tuple[DataFrame, DataFrame]:
    """The contracted graph (x, y, steps, strand, values) of edges (x, y, values), and the members of its strands
    (node, strand, rank).  keep (node): nodes that stay.  A strand is named by its first node; edges that are none have
    a null strand and one step.  Cycles of such nodes alone keep their least node."""
    tables = Scratch(edges.sparkSession)
    names = [n for n in edges.columns if n not in ("x", "y")]
    inner = degrees(edges).filter("ins = 1 and outs = 1").select("node")
    if keep is not None:
        inner = inner.join(keep.select("node").distinct(), "node", "left_anti")
    inner = tables.put(inner, "inner")
    before, after = inner.select(c("node").alias("x"), lit(True).alias("x_in")), inner.select(c("node").alias("y"), lit(True).alias("y_in"))
    marked = tables.put(edges.join(before, "x", "left").join(after, "y", "left").withColumns({n: F.coalesce(n, lit(False)) for n in ("x_in", "y_in")}), "marked")
    ranks = jump(marked.filter("x_in and y_in").select(c("y").alias("node"), c("x").alias("next")))
    if not ranks.filter("cycle is not null").isEmpty():
        heads = ranks.filter("cycle is not null").select(c("cycle").alias("node")).distinct()
        return strands(edges, heads if keep is None else keep.select("node").unionByName(heads), combine)
    first = marked.filter("y_in and not x_in").select(c("y").alias("node"), c("y").alias("strand"), lit(0).cast("long").alias("rank"))
    members = tables.put(ranks.select("node", c("end").alias("strand"), c("steps").alias("rank")).unionByName(first), "members")
    # the links between the nodes of a strand, combined from its first node to the node after it
    whole = members.groupBy("strand").agg(F.max_by("node", "rank").alias("last"), (F.max("rank") + 2).alias("steps"))
    entry = marked.filter("y_in and not x_in").select("x", c("y").alias("strand"), *names)
    leave = marked.filter("x_in and not y_in").select(c("x").alias("last"), "y")
    joined = entry.join(whole, "strand").join(leave, "last")
    if combine:
        runs = jump(marked.filter("x_in").select(c("x").alias("node"), c("y").alias("next"), *names), combine)
        far = runs.select(c("node").alias("strand"), *(c(n).alias(f"far_{n}") for n in names))
        joined = joined.join(far, "strand")
        joined = joined.withColumns({n: combine[n](c, lambda m: c(f"far_{m}")) for n in names})
    straight = marked.filter("not x_in and not y_in").select("x", "y", lit(1).cast("long").alias("steps"), lit(None).cast(edges.schema["x"].dataType).alias("strand"), *names)
    out = tables.put(straight.unionByName(joined.select("x", "y", "steps", "strand", *names)), "contracted")
    tables.drop(inner, marked)
    return out, members


def reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """x, y, hops: nodes y that one edge or more lead to from the sources (column x), with the fewest edges.

    Rounds: the binary digits of the longest strand, and the hops between other nodes."""
    edges, sources = edges.select("x", "y").distinct(), sources.select("x").distinct()
    tables = Scratch(edges.sparkSession)
    graph, members = strands(edges, sources.select(c("x").alias("node")))
    step = graph.groupBy(c("x").alias("at"), c("y").alias("to")).agg(F.min("steps").alias("steps"))
    known = tables.put(sources.join(step.withColumnRenamed("at", "x"), "x").select("x", c("to").alias("y"), c("steps").alias("hops")), "reach")
    front = known
    while not front.isEmpty():
        grown = front.join(step, c("y") == c("at")).groupBy("x", c("to").alias("y")).agg(F.min(c("hops") + c("steps")).alias("hops"))
        old = known.select("x", "y", c("hops").alias("best"))
        front = tables.put(grown.join(old, ["x", "y"], "left").filter("best is null or hops < best").drop("best"), "front")
        known = tables.put(known.unionByName(front).groupBy("x", "y").agg(F.min("hops").alias("hops")), "reach")
    # strands that hang off a reached node or a source
    from_ = known.select("x", c("y").alias("at"), "hops").unionByName(sources.select("x", c("x").alias("at"), lit(0).cast("long").alias("hops")))
    inside = from_.join(graph.filter("strand is not null").select(c("x").alias("at"), "strand"), "at").join(members, "strand").select("x", c("node").alias("y"), (c("hops") + c("rank") + 1).alias("hops"))
    out = known.unionByName(inside).groupBy("x", "y").agg(F.min("hops").alias("hops"))
    return tables.keep(tables.put(out, "reached"))


def reachable(edges: DataFrame, sources: DataFrame, inner: DataFrame) -> DataFrame:
    """node: nodes that one edge (x, y) or more lead to from the sources (column x); inner (x): those of the sources that
    edges may lead to.

    A node with one edge in hangs below the node that it comes from.  ``jump`` finds the root of each such tree at once;
    what is left to go through is the graph of the roots, with the edges to nodes that have several edges in."""
    tables = Scratch(edges.sparkSession)
    edges = tables.put(edges.select("x", "y").filter("x is not null and y is not null"), "edges")
    tops = tables.put(repeated(edges.select("y")).unionByName(inner.select(c("x").alias("y"))).distinct(), "tops")
    into, down = parted(edges, "y", tops)
    ranks = jump(down.select(c("y").alias("node"), c("x").alias("next")))
    into = tables.put(into, "into")
    roots = parted(ranks, "node", into.select("x").distinct())[0].select(c("node").alias("x"), lit(True).alias("_below"), "end")
    above = into.join(roots, "x", "left").select(F.when(c("_below"), c("end")).otherwise(c("x")).alias("x"), "y").filter("x is not null")
    above = tables.put(above.distinct(), "above")
    hit = above.select(c("y").alias("node")) if above.isEmpty() else reach(above, sources).select(c("y").alias("node")).distinct()
    hit = tables.put(hit, "hit")
    below = ranks.join(sources.select(c("x").alias("end")).unionByName(hit.select(c("node").alias("end"))).distinct(), "end", "left_semi").select("node")
    return tables.keep(tables.put(below.unionByName(hit), "reached"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's connected component, edges (x, y) taken both ways.

    Large and small stars by turns: each node ties its larger neighbours, then its smaller ones and itself, to the least
    of them, until nothing moves; a logarithmic number of rounds.  A star's centre is aggregated before it is shuffled."""
    tables = Scratch(edges.sparkSession)
    pairs = tables.put(edges.select("x", "y").filter("x <> y").distinct(), "pairs")
    like = pairs.select(c("x").alias("node"), c("y").alias("root"))
    nodes = edges.select(c("x").alias("node")).union(edges.select("y")).distinct()
    while pairs.count() > SMALL:
        both = pairs.unionByName(pairs.select(c("y").alias("x"), c("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("low"))
        large = tables.put(both.join(least, "x").filter("y > x").select(c("y").alias("x"), c("low").alias("y")).filter("x <> y").distinct(), "large")
        down = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        low = down.groupBy("x").agg(F.min("y").alias("low"))
        small = down.join(low, "x").filter("y <> low").select(c("y").alias("x"), c("low").alias("y"))
        fresh = tables.put(small.unionByName(low.select("x", c("low").alias("y"))).distinct(), "small")
        moved = not (fresh.join(pairs, ["x", "y"], "left_anti").isEmpty() and pairs.join(fresh, ["x", "y"], "left_anti").isEmpty())
        tables.drop(pairs, large)
        pairs = fresh
        if not moved:
            break
    roots = pairs.select(c("x").alias("node"), c("y").alias("root")) if pairs.count() > SMALL else _finished(pairs, _roots_of, like)
    return tables.keep(tables.put(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots"))


def cycles(edges: DataFrame) -> DataFrame:
    """node, root: nodes that are on a cycle of edges (x, y), with one node of their strongly connected component.

    Nodes without an edge in or out are trimmed and strands contracted, by turns; what then stays is coloured forward by
    the largest node that reaches it, and the nodes that reach the root of their colour within it are a component."""
    tables = Scratch(edges.sparkSession)
    at = tables.put(edges.select("x", "y").distinct(), "edges")
    layers, found = [], []
    n, like = at.count(), edges.select(c("x").alias("node"), c("x").alias("root"))
    while n > SMALL:
        while n > SMALL:
            live = degrees(at).filter("ins > 0 and outs > 0").select("node")
            at = tables.put(at.join(live.withColumnRenamed("node", "x"), "x", "left_semi").join(live.withColumnRenamed("node", "y"), "y", "left_semi"), "trimmed")
            was, n = n, at.count()
            if n <= max(SMALL, was * MOVED):
                continue
            graph, members = strands(at)
            layers.append((graph.filter("strand is not null"), members))
            at = tables.put(graph.select("x", "y").distinct(), "edges")
            n = at.count()
            if n == was:
                break
        if n <= SMALL:
            break
        colour = tables.put(at.select(c("x").alias("node")).union(at.select("y")).distinct().withColumn("root", c("node")), "colour")
        while True:
            pushed = at.join(colour.withColumnRenamed("node", "x"), "x").select(c("y").alias("node"), "root")
            best = colour.withColumn("was", c("root")).unionByName(pushed.withColumn("was", lit(None).cast(edges.schema["x"].dataType)))
            fresh = tables.put(best.groupBy("node").agg(F.max("root").alias("root"), F.max("was").alias("was")), "colour")
            same = fresh.filter("root <> was").isEmpty()
            colour = fresh.drop("was")
            if same:
                break
        own = at.join(colour.select(c("node").alias("x"), c("root").alias("of_x")), "x").join(colour.select(c("node").alias("y"), c("root").alias("of_y")), "y").filter("of_x = of_y")
        back = reach(own.select(c("y").alias("x"), c("x").alias("y")), colour.filter("node = root").select(c("root").alias("x")))
        members_ = tables.put(back.select(c("y").alias("node"), c("x").alias("root")).distinct(), "cycle")
        found.append(members_)
        gone = colour.filter("node = root").select("node").unionByName(members_.select("node")).distinct()
        at = tables.put(at.join(gone.withColumnRenamed("node", "x"), "x", "left_anti").join(gone.withColumnRenamed("node", "y"), "y", "left_anti"), "edges")
        n = at.count()
    out = tables.put(_finished(at, _cycles_of, like), "cycle")
    for more in found:
        out = out.unionByName(more)
    # a strand between two nodes of a component is in it
    for graph, members in reversed(layers):
        ends = graph.join(out.select(c("node").alias("x"), "root"), "x").join(out.select(c("node").alias("y"), c("root").alias("other")), "y").filter("root = other")
        out = out.unionByName(ends.select("strand", "root").join(members, "strand").select("node", "root"))
    return tables.put(out.distinct(), "cycles")


def acyclic(edges: DataFrame) -> DataFrame:
    """Edges (x, y) that are on no cycle."""
    of = cycles(edges)
    a, b = of.select(c("node").alias("x"), c("root").alias("_a")), of.select(c("node").alias("y"), c("root").alias("_b"))
    return edges.join(a, "x", "left").join(b, "y", "left").filter("_a is null or _b is null or _a <> _b").select(*edges.columns)


def longest(edges: DataFrame) -> int:
    """Edges of the longest path over edges (x, y) that are on no cycle.

    Nodes that nothing leads to hand what they have on to their successors and go; then strands are contracted, where an
    edge stands for max(t + plus, least) of what its start has.  What neither moves is on or behind cycles, whose edges go."""
    tables = Scratch(edges.sparkSession)
    combine = {"plus": lambda a, b: a("plus") + b("plus"), "least": lambda a, b: F.greatest(a("least") + b("plus"), b("least"))}
    long = lambda k: lit(k).cast("long")
    at = tables.put(edges.select("x", "y").distinct().filter("x <> y").withColumns({"plus": long(1), "least": long(0)}), "edges")
    # what nodes have so far; those without a row have 0
    base = edges.sparkSession.createDataFrame([], edges.select(c("x").alias("node"), long(0).alias("has")).schema)
    cleared = False
    n = at.count()
    while n > SMALL:
        top = degrees(at).filter("ins = 0").select("node")
        off = at.join(top.withColumnRenamed("node", "x"), "x", "left_semi").join(base.withColumnRenamed("node", "x"), "x", "left")
        given = off.groupBy(c("y").alias("node")).agg(F.max(F.greatest(F.coalesce("has", long(0)) + c("plus"), "least")).alias("has"))
        base = tables.put(base.unionByName(given).groupBy("node").agg(F.max("has").alias("has")), "base")
        rest = tables.put(at.join(top.withColumnRenamed("node", "x"), "x", "left_anti"), "edges")
        was, n, at = n, rest.count(), rest
        if n <= max(SMALL, was * MOVED):
            continue
        # what a node inside a strand has is the least that the edge into it gives
        ends = rest.join(base.withColumnRenamed("node", "y"), "y", "left")
        inner = degrees(rest).filter("ins = 1 and outs = 1").select(c("node").alias("y"), lit(True).alias("_in"))
        folded = ends.join(inner, "y", "left").withColumn("least", F.when(c("_in"), F.greatest("least", F.coalesce("has", long(0)))).otherwise(c("least"))).select("x", "y", "plus", "least")
        graph, _ = strands(tables.put(folded, "folded"), None, combine)
        at = tables.put(graph.groupBy("x", "y").agg(F.max("plus").alias("plus"), F.max("least").alias("least")), "edges")
        n = at.count()
        if n == was:
            if cleared:
                raise RuntimeError("a cycle is left")
            at, cleared = tables.put(acyclic(at), "edges"), True
            n = at.count()
    known = at.join(base.withColumnRenamed("node", "x"), "x", "left").join(base.select(c("node").alias("y"), c("has").alias("has_y")), "y", "left")
    left = _finished(known.withColumns({k: F.coalesce(k, long(0)) for k in ("has", "has_y")}), _longest_of, base.select("has"))
    best = base.select("has").unionByName(left).agg(F.max("has")).collect()[0][0] or 0
    for t, _ in list(tables.at.values()):
        tables.drop(t)
    return best
