"""A trie of conversation prefixes, merged family first.

Conversations c - c % 20 to c - c % 20 + 19 are a family; each starts with the first turns of its base.  The base's first
turns and the family's own turns are cogrouped by base id, each conversation is rebuilt, and the family's small trie is
built there.  Only the families' combined nodes are shuffled, by their prefix, and merged.

A turn is carried as a 128-bit hash of its role and text with the number of its words, and a prefix as the exclusive or
of its turns' hashes, each mixed with its depth; so the texts themselves are read once and never shuffled.
``with_turns`` joins the role and text of a node's last turn to it.

What a subtree holds is added up along chains: a node belongs to the chain of the member with the smallest hash of its
id, so a chain is a run of depths, and along any path the chain changes a logarithmic number of times.  Chains are summed
by two-level running sums, and what hangs off a chain is sent up chain by chain.

No group grows with the data: turns are numbered within ranges of (conversation, turn), a long conversation is cogrouped
in pieces of ``PIECE`` turns, each with the prefix before it, and the ids that end at a node are written as pieces of
text that one task, as SHA-256 asks for, only digests in their order.

Defined cases: turns are ordered by turn (null first), equal ones by a hash of role and text; repeated rows are turns of
their own; null roles and texts are empty; rows without conv_id belong to no conversation; an empty table has no nodes,
not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Tables
from .words import U64, mix

FAMILY, HEADS = 20, 4
#: Turns of a conversation that are cogrouped at once, and nodes of a chain that are summed at once.
PIECE = 4096
#: Rows of a range that turns are numbered in, at most on average.
RANGE_ROWS = 1_000_000
#: Bytes of a piece of joined ids.
TEXT = 1 << 20
NODE = ["x", "y", "depth"]
FAMILY_NODE = "x long, y long, depth long, px long, py long, words long, src long, pos long, conv long, rep_hash long, rep long, n long, ends array<long>"


def head_length(conv: Column, heads: int = HEADS) -> Column:
    """How many turns of its base a conversation starts with."""
    return (F.crc32(conv.cast("string").cast("binary")) % heads).cast("int")


def _turn_hash() -> dict[str, Column]:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return {name: F.conv(F.substring(both, at, 15), 16, 10).cast("long") for name, at in (("k1", 1), ("k2", 17))}


def numbered(turns: DataFrame, tables: Tables) -> DataFrame:
    """conv, pos (from 1), n (turns of the conversation), k1, k2 (hash of role and text), words."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    hashes = [k.alias(n) for n, k in _turn_hash().items()]
    slim = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", *hashes, words.alias("words"), F.xxhash64(F.monotonically_increasing_id()).alias("lot"))
    slim = tables.write(slim, "turns")
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), slim.count() // RANGE_ROWS)
    ranged = slim.repartitionByRange(parts, "conv", F.col("turn").asc_nulls_first(), "k1", "k2", "lot")
    ranged = tables.write(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    tables.drop(slim)
    sizes = ranged.groupBy("conv", "part").agg(F.count("*").alias("size"))
    of = Window.partitionBy("conv")
    starts = sizes.select("conv", "part", (F.sum("size").over(of.orderBy("part")) - F.col("size")).alias("start"), F.sum("size").over(of).alias("n"))
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "k1", "k2", "lot"))
    out = ranged.withColumn("within", within).join(starts, ["conv", "part"])
    out = tables.write(out.select("conv", (F.col("start") + F.col("within")).alias("pos"), "n", "k1", "k2", "words"), "numbered")
    tables.drop(ranged)
    return out


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy(zero_copy_only=False) for c in names]


def _rebuilt(heads: pa.Table, own: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each conversation of a family's piece: its id, the hashes of the prefix before the piece, and of each turn that
    it has there (conversation and place it comes from, two hashes mixed with its depth, words), with the depth of the
    first in the fourth place."""
    base = own.column("base")[0].as_py() if len(own) else heads.column("base")[0].as_py()
    conv, pos, k1, k2, words = _columns(own, "conv", "pos", "k1", "k2", "words")
    order = np.lexsort((pos, conv))
    conv, pos, k1, k2, words = (a[order] for a in (conv, pos, k1, k2, words))
    first = _columns(heads.filter(pc.is_valid(heads.column("pos"))).sort_by("pos"), "pos", "k1", "k2", "words")
    plans = heads.filter(pc.is_null(heads.column("pos")))
    for c, h, piece, x, y in zip(*_columns(plans, "conv", "h", "piece", "x", "y"), strict=True):
        given = min(h, len(first[0])) if piece == 0 else 0
        lo, hi = np.searchsorted(conv, [c, c + 1])
        lo += np.searchsorted(pos[lo:hi], h, "right")
        src = np.concatenate((np.full(given, base), np.full(hi - lo, c)))
        place, a, b, w = (np.concatenate((f[:given], o[lo:hi])) for f, o in zip(first, (pos, k1, k2, words), strict=True))
        begin = 1 if piece == 0 else int(pos[lo]) - h + min(h, len(first[0])) if hi > lo else 1
        depth = U64(begin) + np.arange(len(a), dtype=U64)
        salt = mix(depth * U64(0x9E3779B97F4A7C15))
        ka, kb = a.astype(np.int64).view(U64), b.astype(np.int64).view(U64)
        yield int(c), int(x), int(y), begin, src, place, w, np.stack((mix(mix(ka ^ salt) + kb), mix(mix(kb + salt) ^ mix(ka))))


def _totals(heads: pa.Table, own: pa.Table) -> pa.Table:
    """The hash of all turns of each conversation's piece."""
    rows = [(c, *(int(np.bitwise_xor.reduce(k).view(np.int64)) if k.size else 0 for k in keys)) for c, _, _, _, _, _, _, keys in _rebuilt(heads, own)]
    piece = heads.column("piece")[0].as_py()
    return pa.table({"conv": pa.array([r[0] for r in rows], pa.int64()), "piece": pa.array([piece] * len(rows), pa.int64()), "x": pa.array([r[1] for r in rows], pa.int64()), "y": pa.array([r[2] for r in rows], pa.int64())})


def _family_trie(heads: pa.Table, own: pa.Table) -> pa.Table:
    """The trie of a family's piece: its nodes, with what merging needs."""
    nodes: dict[tuple[int, int, int], list] = {}
    plans = heads.filter(pc.is_null(heads.column("pos")))
    last = dict(zip(plans.column("conv").to_pylist(), plans.column("ends_here").to_pylist(), strict=True))
    ranks = dict(zip(plans.column("conv").to_pylist(), plans.column("rep_hash").to_pylist(), strict=True))
    piece = heads.column("piece")[0].as_py()
    for c, x, y, begin, src, place, words, keys in _rebuilt(heads, own):
        above = np.array([[x], [y]], np.int64).view(U64)
        prefix = np.concatenate((above, np.bitwise_xor.accumulate(keys, axis=1) ^ above), axis=1).view(np.int64)
        path = [(0, 0, 0, None, None, 0, c, 0)] if piece == 0 else []
        path += zip(*prefix[:, 1:].tolist(), range(begin, begin + len(words)), *prefix[:, :-1].tolist(), words.tolist(), src.tolist(), place.tolist(), strict=True)
        rank = (ranks[c], c)
        for a, b, depth, *rest in path:
            node = nodes.setdefault((a, b, depth), [rest, c, rank, 0, []])
            node[1], node[2], node[3] = min(node[1], c), min(node[2], rank), node[3] + 1
        if last[c]:
            nodes[(path[-1][:3] if path else (x, y, begin - 1))][4].append(c)
    rows = [(*k, *rest, c, *rank, n, sorted(ends)) for k, (rest, c, rank, n, ends) in nodes.items()]
    kinds = [pa.int64()] * 12 + [pa.list_(pa.int64())]
    return pa.table({f.split()[0]: pa.array([r[i] for r in rows], kind) for i, (f, kind) in enumerate(zip(FAMILY_NODE.split(", "), kinds, strict=True))})


def family_nodes(turns: DataFrame, family: int, heads: int, tables: Tables) -> DataFrame:
    """The nodes of all families' tries.  turns: see ``numbered``."""
    base = F.col("conv") - F.col("conv") % family
    convs = turns.filter("pos = 1").select(base.alias("base"), "conv", "n", head_length(F.col("conv"), heads).alias("h"))
    own = turns.select(base.alias("base"), F.expr(f"(pos - 1) div {PIECE}").alias("piece"), "conv", "pos", "n", "k1", "k2", "words")
    long = lambda x: F.lit(x).cast("long")
    pieces = F.expr(f"(n - 1) div {PIECE}")
    plans = convs.withColumn("piece", F.explode(F.sequence(long(0), pieces))).withColumn("ends_here", F.col("piece") == pieces)
    # each piece of a family gets the base's first turns as well
    span = convs.groupBy("base").agg(F.explode(F.sequence(long(0), F.max(pieces))).alias("piece"))
    first = turns.filter(f"conv % {family} = 0 and pos < {heads}").select(F.col("conv").alias("base"), "pos", "k1", "k2", "words").join(span, "base")

    def left(before: DataFrame | None, keep: Column) -> DataFrame:
        rows = plans.filter(keep)
        rows = rows.join(before, ["conv", "piece"], "left") if before is not None else rows.withColumns({"x": long(0), "y": long(0)})
        rows = rows.select("base", "piece", "conv", "h", F.coalesce("x", long(0)).alias("x"), F.coalesce("y", long(0)).alias("y"), "ends_here", F.xxhash64("conv").alias("rep_hash"))
        return rows.unionByName(first, allowMissingColumns=True)

    def cogroup(given: DataFrame, rows: DataFrame):
        # both come from one table: new names tell their columns apart
        return given.toDF(*given.columns).groupBy("base", "piece").cogroup(rows.toDF(*rows.columns).groupBy("base", "piece"))

    many = F.col("n") > PIECE
    cogrouped = cogroup(left(None, many), own.filter(many))
    totals = tables.write(cogrouped.applyInArrow(_totals, "conv long, piece long, x long, y long"), "pieces")
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv", "piece", F.bit_xor("x").over(earlier).alias("x"), F.bit_xor("y").over(earlier).alias("y"))
    cogrouped = cogroup(left(before, F.lit(True)), own)
    return tables.write(cogrouped.applyInArrow(_family_trie, FAMILY_NODE), "families")


def merged(families: DataFrame) -> DataFrame:
    """Families' nodes, merged by their prefix."""
    any_ = lambda *names: [F.min(c).alias(c) for c in names]  # noqa: E731  # equal for equal prefixes
    rep = F.min(F.struct("rep_hash", "rep"))
    source = F.min(F.struct("src", "pos"))
    out = families.groupBy(*NODE).agg(*any_("px", "py", "words", "conv"), rep["rep"].alias("rep"), source.alias("source"), F.sum("n").alias("n"))
    return out.select(*NODE, "px", "py", "words", "conv", "rep", F.col("source.src").alias("src"), F.col("source.pos").alias("pos"), "n")


def _suffix_sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds to each node of a chain (rep, depth) what the deeper ones have, in two levels: within pieces, then over them."""
    rows = rows.withColumn("piece", F.expr(f"depth div {PIECE}"))
    later = Window.partitionBy("rep").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("rep", "piece").agg(*(F.sum(c).alias(f"{c}_piece") for c in names))
    sums = sums.select("rep", "piece", *(F.coalesce(F.sum(f"{c}_piece").over(later), F.lit(0)).alias(f"{c}_after") for c in names))
    within = Window.partitionBy("rep", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({c: F.sum(c).over(within) for c in names}).join(sums, ["rep", "piece"])
    return rows.withColumns({c: F.col(c) + F.col(f"{c}_after") for c in names}).drop("piece", *(f"{c}_after" for c in names))


def with_subtrees(nodes: DataFrame, tables: Tables) -> DataFrame:
    """Adds parent_conv, n_children, n_leaves and saved (of the whole subtree) to nodes."""
    up = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv"), F.col("rep").alias("parent_rep"))
    linked = nodes.join(up, ["px", "py", "depth"], "left")
    below = linked.filter("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    whole = linked.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    whole = whole.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("words")})
    whole = tables.write(whole, "trie_nodes")
    names = ["n_leaves", "saved"]
    # a chain hangs off the node above its first one; what it holds goes there, and from there on up
    chains = tables.write(whole.filter("depth > 0 and parent_rep <> rep").select("rep", "parent_rep", (F.col("depth") - 1).alias("at")), "chains")
    sums = whole.groupBy("rep").agg(*(F.sum(c).alias(c) for c in names))
    rounds = []
    while True:
        rounds.append(tables.write(sums.join(chains, "rep").groupBy("parent_rep", "at").agg(*(F.sum(c).alias(c) for c in names)).withColumnsRenamed({"parent_rep": "rep", "at": "depth"}), "hung"))
        if rounds[-1].isEmpty():
            break
        sums = rounds[-1].groupBy("rep").agg(*(F.sum(c).alias(c) for c in names))
    hung = rounds[0]
    for more in rounds[1:]:
        hung = hung.unionByName(more)
    hung = hung.groupBy("rep", "depth").agg(*(F.sum(c).alias(f"{c}_hung") for c in names))
    whole = whole.join(hung, ["rep", "depth"], "left")
    return _suffix_sums(whole.withColumns({c: F.col(c) + F.coalesce(f"{c}_hung", F.lit(0)) for c in names}).drop(*(f"{c}_hung" for c in names)), names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x, y, depth, conv) as pieces of comma-joined ids of a node, in their order."""
    for b in batches:
        keys = np.stack([b.column(i).to_numpy() for i in range(3)])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1 if b.num_rows else []
        out, ids = [], b.column(3).to_pylist()
        for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
            for at in range(lo, hi, TEXT // 16):
                some = ids[at : min(hi, at + TEXT // 16)]
                out.append((*keys[:, lo].tolist(), some[0], ",".join(map(str, some))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 4 else pa.string()) for i in range(5)], [*NODE, "conv", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in their order."""
    now, digest = None, None
    done: list[tuple] = []
    for b in batches:
        for *key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if key == now:
                digest.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((*now, digest.hexdigest()))
            now, digest = key, hashlib.sha256(ids.encode())
        yield _digests(done)
        done = []
    yield _digests([(*now, digest.hexdigest())] if now is not None else [])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4)], [*NODE, "ends_sha256"])


def ends_digests(families: DataFrame, tables: Tables) -> DataFrame:
    """x, y, depth, ends_sha256 for the nodes where a conversation ends."""
    spark = families.sparkSession
    ends = tables.write(families.filter(F.size("ends") > 0).select(*NODE, F.explode("ends").alias("conv")), "ends")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ends.count() // RANGE_ROWS)
    ranged = ends.repartitionByRange(parts, *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    pieces = ranged.mapInArrow(_joined, "x long, y long, depth long, conv long, ids string")
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "conv")
    return dealt.mapInArrow(_digested, "x long, y long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and src_conv_id and src_pos, the turn that is the node's last."""
    tables = Tables(turns.sparkSession)
    rows = numbered(turns, tables)
    families = family_nodes(rows, family, heads, tables)
    nodes = with_subtrees(merged(families), tables).join(ends_digests(families, tables), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.when(F.col("depth") > 0, F.col("src")).alias("src_conv_id"), F.when(F.col("depth") > 0, F.col("pos")).alias("src_pos"))


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes of ``prefix_trie`` with the role and text of their last turn (null for the root)."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_k1", "_k2"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = turns.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"), *(k.alias(f"_{n}") for n, k in _turn_hash().items()))
    said = said.select(F.col("conv_id").alias("src_conv_id"), place.cast("long").alias("src_pos"), "role", "text")
    return nodes.join(said, ["src_conv_id", "src_pos"], "left")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("src_conv_id", "src_pos")


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
cr AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT DISTINCT conv_id FROM t)
UNION ALL SELECT conv_id, s, i + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS x FROM cr WHERE i < 8 * length(s))),
c AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM cr WHERE i = 8 * length(s)),
b AS (SELECT conv_id AS base, count(*) AS held FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.pos AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.held, 0)), role, text FROM c JOIN t USING (conv_id) LEFT JOIN b ON b.base = c.base WHERE t.pos > c.h),
p AS (SELECT conv_id, 0 AS depth, '' AS pre, '' AS text FROM c UNION ALL SELECT conv_id, depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth), text FROM r),
q AS (SELECT *, lag(pre) OVER w AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT depth, pre, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n, any_value(len(regexp_extract_all(text, '[^ 	-
]+'))) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM q GROUP BY depth, pre),
k AS (SELECT depth - 1 AS depth, above AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, pre)),
a AS (SELECT q.depth, q.pre, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n - 1) * m.words) AS BIGINT) AS saved_tokens FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY q.depth, q.pre)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.n_children, a.n_leaves, a.saved_tokens, m.ends_sha256 FROM m JOIN a USING (depth, pre) LEFT JOIN n u ON u.depth = m.depth - 1 AND u.pre = m.above
"""
