"""Transcript parsing by a hidden Markov model, and canonical rendering of turns.

A transcript comes in fragments (id, order, text) of one or more lines, and of one or more turns; a fragment starts a turn.  Each line is seen as
a speaker marker (of a role, of an unknown speaker, or none) and a few line features.  The hidden states are the roles,
each as the first line of a turn or a further one.  Role transitions, feature frequencies and those of markers, also
missing ones, are counted from labelled turns (``fit``); Viterbi then recovers the states, and turns are rendered without their markers.

Transcripts of more than FAN fragments are cut into blocks of FAN by the fragments' places, whatever their orders are.
Places come from a prefix sum: long transcripts are dealt to ranges of (id, order, text), each range counts its rows of
each transcript, and the counts of the ranges before are added.  A block is summed up as a matrix of its best scores between
each state before it and each state at its end; such matrices multiply (maximum, plus) to those of larger blocks, level
by level, until one is left for each transcript.  On the way down every block gets its two end states and Viterbi runs
within it.  So no task gets a whole transcript, and the result is that of one run over all lines.

Defined cases: a null or empty text is one empty line; a null order counts as 0, ties follow by text, repeated rows are
turns of their own; unknown markers are read as a new turn whose role the neighbours decide; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

ROLES = ("system", "user", "assistant")
#: Names that speakers go by.
NAMES = {"system": "system", "instruction": "system", "instructions": "system", "user": "user", "human": "user", "question": "user", "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant"}
#: Fragments of a block, and matrices of a larger one.
FAN = 512
# Name: / Name> / [Name] / <Name> / **Name:** / ### Name: , with the line's text behind it
MARKER = re.compile(r"^\s{0,3}(?:#{1,4}\s*)?(?:\*\*)?(?:([A-Za-z][\w ]{0,20}?)\s?(?::\*\*|\*\*:|:|>)|\[([A-Za-z][\w ]{0,20})\]:?|<\|?([A-Za-z][\w ]{0,20})\|?>:?)(?: |$)")
STATES = [(r, first) for r in range(3) for first in (True, False)]
#: The state before a transcript, which no line has.
START, N = 6, 7
NONE, UNKNOWN = 3, 4
LOW = -1e9


def features(line: str) -> int:
    """Which of 16 kinds a line is, without its marker."""
    return (line.rstrip().endswith("?")) + 2 * (len(line) > 120) + 4 * line.lstrip().startswith(("-", "*", "```", "1.")) + 8 * (not line.strip())


def marker(line: str) -> tuple[int, int]:
    """The role of a line's marker (NONE, or UNKNOWN for another name) and where its text begins."""
    if not (m := MARKER.match(line)):
        return NONE, 0
    name = next(g for g in m.groups() if g).strip().lower()
    if name in NAMES:
        return ROLES.index(NAMES[name]), m.end()
    return (UNKNOWN, m.end()) if len(name.split()) == 1 and m[0].strip()[-1] in ">]" else (NONE, 0)


@dataclass(frozen=True)
class Model:
    """Log-probabilities: of the first role, of a role after another, of line features by role, of markers by role on the
    first line of a turn (0) and on others (1), and of a further line being one or the other."""

    start: np.ndarray
    follow: np.ndarray
    features: np.ndarray
    marks: np.ndarray
    lines: np.ndarray

    def emissions(self, marks: np.ndarray, kinds: np.ndarray, head: np.ndarray) -> np.ndarray:
        out = np.full((len(marks), N), LOW)
        for k, (role, first) in enumerate(STATES):
            out[:, k] = self.marks[role, 0 if first else 1, marks] + self.features[role, kinds]
            out[:, k] += np.where(head, 0 if first else LOW, self.lines[0 if first else 1])
        return out

    def moves(self) -> np.ndarray:
        """Scores from state to state."""
        out = np.full((N, N), LOW)
        for j, (s, first) in enumerate(STATES):
            for i, (r, _) in enumerate(STATES):
                out[i, j] = self.follow[r, s] if first else (0.0 if r == s else LOW)
            out[START, j] = self.start[s] if first else LOW
        return out


def fit(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", unmarked: int = 10) -> Model:
    """Counts over all labelled turns, of markers as transcripts write them with ``unmarked`` percent of the turns left
    without one: a few hundred numbers come to the driver."""
    rows = turns.filter(F.col(role).isin(*ROLES)).select(F.col(key).alias("conv_id"), F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            roles = [ROLES.index(x) for x in b.column(0).to_pylist()]
            lines, marks, kinds, head = _read(b.column(1).to_pylist())
            who = np.repeat(roles, [len(x) for x in lines]) if lines else np.zeros(0, np.int64)
            seen.update(zip(who.tolist(), np.where(head, 0, 1).tolist(), marks.tolist(), kinds.tolist()))
        cells = list(zip(*seen)) if seen else [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cells), pa.array(list(seen.values()), pa.int64())], ["role", "place", "mark", "kind", "n"])

    written_ = as_transcripts(rows, unmarked).select("role", "text")
    seen = written_.mapInArrow(count, "role long, place long, mark long, kind long, n long").groupBy("role", "place", "mark", "kind").agg(F.sum("n")).collect()
    marks, kinds = np.full((3, 2, 5), 0.5), np.ones((3, 16))
    for r, place, mark, kind, n in seen:
        marks[r, place, mark] += n
        kinds[r, kind] += n
    # turns of one number are counted before they meet
    said = rows.groupBy(F.col("conv_id").alias("id"), F.col("turn").alias("n"), F.col("role").alias("x")).agg(F.count("*").alias("c"))
    after = said.select("id", (F.col("n") - 1).alias("n"), F.col("x").alias("y"), F.col("c").alias("d"))
    pairs = {(r[0], r[1]): r[2] for r in said.join(after, ["id", "n"]).groupBy("x", "y").agg(F.sum(F.col("c") * F.col("d"))).collect()}
    first = {r[0]: r[1] for r in rows.filter(F.col("turn") == 0).groupBy("role").count().collect()}
    norm = lambda m: np.log(m / m.sum(axis=-1, keepdims=True))
    return Model(
        norm(np.array([first.get(r, 0) + 1.0 for r in ROLES])),
        norm(np.array([[pairs.get((r, s), 0) + 1.0 for s in ROLES] for r in ROLES])),
        norm(kinds),
        norm(marks),
        norm(marks.sum(axis=(0, 2))),
    )


def _read(texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Lines without markers, and for all lines marks, kinds and whether they begin a fragment."""
    out, marks, kinds, head = [], [], [], []
    for t in texts:
        lines = []
        for k, line in enumerate((t or "").split("\n")):
            m, at = marker(line)
            lines.append(line[at:])
            marks.append(m)
            kinds.append(features(line[at:]))
            head.append(k == 0)
        out.append(lines)
    return out, np.array(marks), np.array(kinds), np.array(head)


def product(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best scores from each state before the lines to each state at their end."""
    out = moves + scores[0]
    for e in scores[1:]:
        out = (out[:, :, None] + moves[None]).max(axis=1) + e
    return out


def viterbi(scores: np.ndarray, moves: np.ndarray, enter: np.ndarray, last: int | None = None) -> list[int]:
    """The best states, with the scores of those at entry, and the last one if it is known."""
    best, back = enter + scores[0], []
    for e in scores[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + e
    path = [int(best.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def ends_of(matrices: list[np.ndarray], before: int, last: int) -> list[int]:
    """The end state of each of some blocks in order, from the state before the first and that of the last (-1: any)."""
    best, back = matrices[0][before], []
    for m in matrices[1:]:
        ways = best[:, None] + m
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    path = [int(best.argmax()) if last < 0 else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def placed(rows: DataFrame, fan: int) -> DataFrame:
    """id, n, text, block: the blocks of fan rows in the order (n, text) of each id.  Equal rows are dealt apart by where
    they were read, so a range has a bounded share of the rows whatever they hold."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("n"), F.asc_nulls_last("text"), F.asc("_at")]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, F.asc("id"), *order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("id", "_part").agg(F.count("*").alias("_n"))
    # one row for each range that has rows of the id
    before = counts.select(F.col("id").alias("_id"), F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy("id").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = dealt.withColumn("_within", F.row_number().over(Window.partitionBy("id", "_part").orderBy(*order)) - 1)
    out = within.join(before, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_part") == F.col("_p")))
    return out.select("id", "n", "text", F.expr(f"(_before + _within) div {fan}").alias("block"))


def parse(fragments: DataFrame, model: Model, key: str = "conv_id", order: str = "turn", text: str = "text", fan: int = FAN) -> DataFrame:
    """key, order, part, role, text, rendered: the turns of every transcript, in order."""
    kind = fragments.schema[key].dataType.simpleString()
    rows = fragments.select(F.col(key).alias("id"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("n"), F.col(text).alias("text"))
    spans = written(rows.groupBy("id").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > fan).select(F.col("id").alias("_id")), "long_transcripts")
    whole, long_ = spans.isEmpty(), F.col("id").eqNullSafe(F.col("_id"))
    if whole:
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    else:
        long_rows = placed(rows.join(spans, long_, "left_semi"), fan)
        rows = rows.join(spans, long_, "left_anti").withColumn("block", F.lit(0).cast("long")).unionByName(long_rows)

    def sum_up(table: pa.Table) -> pa.Table:
        got = table.sort_by([("n", "ascending"), ("text", "ascending")])
        _, marks, kinds, head = _read(got.column("text").to_pylist())
        m = product(model.emissions(marks, kinds, head), model.moves())
        return pa.table({"id": got.column("id")[:1], "n": got.column("block")[:1], "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})

    def combine(table: pa.Table) -> pa.Table:
        got = table.sort_by("n")
        ms = [np.array(m).reshape(N, N) for m in got.column("m").to_pylist()]
        out = ms[0]
        for m in ms[1:]:
            out = (out[:, :, None] + m[None]).max(axis=1)
        return pa.table({"id": got.column("id")[:1], "n": got.column("up")[:1], "m": pa.array([out.ravel().tolist()], pa.list_(pa.float64()))})

    schema = f"id {kind}, n long, m array<double>"
    ends = None
    if not whole:
        # upwards: matrices of the blocks of transcripts that have more than one
        levels = [written(long_rows.groupBy("id", "block").applyInArrow(sum_up, schema), "blocks")]
        while levels[-1].agg(F.max("n")).first()[0] >= fan:
            up = levels[-1].withColumn("up", F.expr(f"n div {fan}"))
            levels.append(written(up.groupBy("id", "up").applyInArrow(combine, schema), "blocks"))

        # downwards: the state before each block and the one at its end (-1: any)
        def choose(table: pa.Table) -> pa.Table:
            got = table.sort_by("n")
            ms = [np.array(m).reshape(N, N) for m in got.column("m").to_pylist()]
            before, last = got.column("before")[0].as_py(), got.column("last")[0].as_py()
            path = ends_of(ms, before, last)
            return pa.table({"id": got.column("id"), "n": got.column("n"), "before": pa.array([before, *path[:-1]], pa.int64()), "last": pa.array(path, pa.int64())})

        for k in range(len(levels) - 1, -1, -1):
            below = levels[k].withColumn("up", F.expr(f"n div {fan}"))
            if ends is None:
                below = below.withColumn("before", F.lit(START).cast("long")).withColumn("last", F.lit(-1).cast("long"))
            else:
                above = ends.select(F.col("id").alias("_id"), F.col("n").alias("_up"), "before", "last")
                below = below.join(above, long_ & (F.col("up") == F.col("_up"))).drop("_id", "_up")
            ends = written(below.groupBy("id", "up").applyInArrow(choose, f"id {kind}, n long, before long, last long"), "ends")
    if ends is None:
        rows = rows.withColumn("before", F.lit(START).cast("long")).withColumn("last", F.lit(-1).cast("long"))
    else:
        ends = ends.select(F.col("id").alias("_id"), F.col("n").alias("_block"), "before", "last")
        rows = rows.join(ends, long_ & (F.col("block") == F.col("_block")), "left").drop("_id", "_block").fillna({"before": START, "last": -1})

    def turns(table: pa.Table) -> pa.Table:
        got = table.sort_by([("n", "ascending"), ("text", "ascending")])
        lines, marks, kinds, head = _read(got.column("text").to_pylist())
        last = got.column("last")[0].as_py()
        states = viterbi(model.emissions(marks, kinds, head), model.moves(), model.moves()[got.column("before")[0].as_py()], None if last < 0 else last)
        out, at = [], 0
        for n, ls in zip(got.column("n").to_pylist(), lines):
            part = -1
            for line in ls:
                role, first = STATES[states[at]]
                at += 1
                if first:
                    part += 1
                    out.append([n, part, ROLES[role], [line]])
                else:
                    out[-1][3].append(line)
        # a marker alone on its line is no text
        texts = ["\n".join(t[3][1:] if len(t[3]) > 1 and not t[3][0] else t[3]) for t in out]
        return pa.table({key: pa.array([got.column("id")[0].as_py()] * len(out), got.schema.field("id").type), order: pa.array([t[0] for t in out], pa.int64()), "part": pa.array([t[1] for t in out], pa.int64()), "role": [t[2] for t in out], "text": pa.array(texts, pa.string())})

    found = rows.groupBy("id", "block").applyInArrow(turns, f"{key} {kind}, {order} long, part long, role string, text string")
    return found.withColumn("rendered", render(F.col("role"), F.col("text")))


def render(role: Column, text: Column) -> Column:
    """One turn in canonical form."""
    return F.concat(F.lit("<|turn|>"), role, F.lit("\n"), text, F.lit("<|end|>"))


def as_transcripts(turns: DataFrame, unmarked: int = 0) -> DataFrame:
    """conv_id, turn, role, text: labelled turns as they are written in transcripts of several styles, one for each
    conversation, with the role as a marker before the first line; ``unmarked`` percent of the turns have no marker."""
    name = F.when(F.col("role") == "user", F.element_at(F.array(*map(F.lit, ("User", "Human", "user", "Q"))), F.pmod("conv_id", F.lit(4)).cast("int") + 1))
    name = name.when(F.col("role") == "assistant", F.element_at(F.array(*map(F.lit, ("Assistant", "AI", "assistant", "A"))), F.pmod("conv_id", F.lit(4)).cast("int") + 1)).otherwise(F.lit("System"))
    style, text = F.pmod("conv_id", F.lit(5)), F.coalesce("text", F.lit(""))
    shaped = F.when(style == 0, F.concat(name, F.lit(": "), text)).when(style == 1, F.concat(name, F.lit("> "), text)).when(style == 2, F.concat(F.lit("["), name, F.lit("] "), text))
    shaped = shaped.when(style == 3, F.concat(F.lit("**"), name, F.lit(":** "), text)).otherwise(F.concat(F.lit("### "), name, F.lit(":\n"), text))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(100)) < unmarked
    return turns.select("conv_id", "turn", "role", F.when(bare, text).otherwise(F.coalesce(shaped, text)).alias("text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return parse(as_transcripts(turns), fit(turns))


OP5_SQL = """SELECT conv_id, turn, CAST(0 AS BIGINT) AS part, role, coalesce(text, '') AS text, '<|turn|>' || role || chr(10) || coalesce(text, '') || '<|end|>' AS rendered FROM conversations"""
