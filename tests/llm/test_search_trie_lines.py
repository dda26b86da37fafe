"""Ranked search, the prefix trie and line dedup against brute force, on the smallest tables and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from quadspan.llm import lexical, line_dedup, prefix_trie, shared
from quadspan.llm.queries import ORACLE, QUERIES

from . import plain

SF = "/root/testdata/sf0.001"
_dice = random.Random(11)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def sort_key(values):
    return tuple((v is not None, v) for v in values)


# --- brute force ----------------------------------------------------------------------------------------------------


def ranked(docs, items, k=10):
    found = [(d, Counter(TERM.findall((t or "").translate(plain.LOWER)))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(plain.LOWER)))
        scores = []
        for (d, c), n in zip(found, sizes, strict=True):
            m = 10 + (90 * n * n_docs) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=sort_key)


def trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for path, ms in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(plain.WORD.findall(p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in ms if len(whole[c]) == len(path))))
        out.append((min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=sort_key)


def deduped(docs):
    low = lambda d: -(1 << 63) if d is None else d
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(plain.LOWER)
    held = defaultdict(list)
    for i, (_, t) in enumerate(docs):
        for k in {key(line) for line in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [len(held.get(key(line), ())) >= 3 and max(low(docs[i][0]) for i in held[key(line)]) != low(d) for line in lines]
        kept = "\n".join(line for line, g in zip(lines, gone, strict=True) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=sort_key)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=sort_key)


RANKED, TRIE, LINES = ("item_id", "rank", "doc_id", "score"), ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), ("doc_id", "n_lines", "n_dropped", "kept_sha256")
CLASH = "row long, key string, conv long, base long, line string, gone long, query long, id long"


def clashing(spark, data, schema):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, "x", 4, 5, 6) for r in data], f"{schema}, {CLASH}")


def digests(found):
    f = line_dedup.F
    return found.select("row.doc_id", "n_lines", "n_dropped", f.sha2(f.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


# --- the tables -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "columns", "brute"), [("op11_search", RANKED, ranked), ("op12_prefix_trie", TRIE, trie), ("op13_line_dedup", LINES, deduped)])
def test_whole_tables(spark, name, columns, brute):
    table = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    given = {"op11_search": lambda: (table("documents", "doc_id", "text"), table("benchmark", "item_id", "text")), "op12_prefix_trie": lambda: (table("conversations", "conv_id", "turn", "role", "text"),), "op13_line_dedup": lambda: (table("documents", "doc_id", "text"),)}[name]()
    got = rows(QUERIES[name](spark, SF), *columns)
    assert got == brute(*given)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    asked = con.execute(ORACLE[name])
    names = [d[0] for d in asked.description]
    assert sorted((tuple(r[names.index(c)] for c in columns) for r in asked.fetchall()), key=sort_key) == got


# --- odd rows -------------------------------------------------------------------------------------------------------

_WORDS = ["".join(_dice.choices("abcdefghij", k=4)) for _ in range(40)]
TEXTS = [
    (1, "Alpha beta GAMMA beta."), (1, "alpha"), (2, None), (3, ""), (4, "..."), (None, "alpha beta"), (5, "é alpha étoile\x7fbeta"), (6, "alpha beta gamma " * 3000),
    (7, "alpha beta"), (8, "alpha beta"), (8, "alpha beta"), *((20 + i, " ".join(_dice.choices(_WORDS, k=_dice.randint(0, 60)))) for i in range(120)),
]
ITEMS = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "-- !"), (None, "Étoile gamma"), (4, "nowhere"), (5, " ".join(_WORDS)), (6, "alpha " * 500)]


@pytest.mark.parametrize(("block", "stride", "part"), [(lexical.BLOCK, lexical.STRIDE, lexical.SLICE_BYTES), (200, 1, 600)])
def test_op11_odd_rows(spark, monkeypatch, block, stride, part):
    """Blocks, strides and slices don't matter; nulls, ties, repeated rows and queries."""
    monkeypatch.setattr(lexical, "SLICE_BYTES", part)
    docs, items = clashing(spark, TEXTS, "doc_id long, text string").repartition(3), clashing(spark, ITEMS, "item_id long, text string")
    assert rows(lexical.search(docs, items), *RANKED) == ranked(TEXTS, ITEMS)
    words = lexical.Vocabulary([t for _, t in ITEMS])
    index = lexical.forward_index(docs, words)
    assert {r["id"] for r in index.collect()} >= {1, 5, 6, 7, 8, None}


def test_op11_threshold_stops_and_keeps_ties():
    """With lists of 4,000 documents the algorithm reads a small part, and finds what reading all of them finds."""
    np = lexical.np
    n, terms = 4000, 6
    dice = np.random.default_rng(5)
    doc, term = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(terms), indexing="ij"))
    for ties in (False, True):
        impact = dice.integers(1, 4, n * terms) * 100 if ties else (dice.pareto(1.0, n * terms) * 100).astype(np.int64) + 1
        block = lexical.Block(np.arange(n, dtype=np.int64), doc, term, impact.astype(np.int64), terms)
        seen = []
        score = block.score
        block.score = lambda d, t, score=score, seen=seen: seen.append(len(d)) or score(d, t)
        best = lexical.Best(10)
        block.search(np.arange(terms, dtype=np.int32), best)
        whole = impact.reshape(n, terms).sum(axis=1)
        want = sorted(range(n), key=lambda d: (-whole[d], d))[:10]
        assert best.ids.tolist() == want
        assert ties or sum(seen) < n / 2


TURNS = [
    *((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3}") for c in range(45) for t in range(c % 6)),
    (60, None, None, None), (60, 1, "user", "late"), (60, 1, "user", "late"), (60, 1, "assistant", "a tie"), (67, 3, "user", ""), (None, 1, "user", "lost"), (81, 0, "user", "one"), (81, 1, "user", "two"), (81, 2, "user", "three"), (81, 3, "user", "four"),
    *((100, t, "user", f"deep {t}") for t in range(40)), *((100 + c, t, "user", f"deep {t}") for c in (1, 2, 3) for t in range(20 + c)), *((200, t, "x", "long " * 50_000) for t in range(2)),
]


@pytest.mark.parametrize("piece", [prefix_trie.PIECE, 4])
def test_op12_odd_rows(spark, monkeypatch, piece):
    """Missing bases, ties, nulls, conversations in several pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    ties = [t for t in TURNS if t[0] != 60]  # equal turns are ordered by a hash: see the next test
    found = prefix_trie.prefix_trie(clashing(spark, ties, "conv_id long, turn long, role string, text string").repartition(5))
    assert rows(found, *TRIE) == trie(ties)


def test_op12_ties_and_texts(spark):
    turns = clashing(spark, [t for t in TURNS if t[0] == 60], "conv_id long, turn long, role string, text string")
    nodes = prefix_trie.with_turns(prefix_trie.prefix_trie(turns), turns)
    said = [(r["role"], r["text"]) for r in sorted(nodes.collect(), key=lambda r: r["depth"])]
    assert said[:2] == [(None, None), ("", "")] and sorted(said[2:]) == [("assistant", "a tie"), ("user", "late"), ("user", "late")]


_line = lambda k: f"a line that is long enough, number {k}"
NOTES = [
    (1, None), (2, ""), (3, "\n\n"), (None, _line(1)), (4, _line(1) + "\n" + _line(1)), (5, "  " + _line(1).upper() + "\t"), (6, "short\n" + _line(2)), (7, "short\n" + _line(2)), (8, "short\n" + _line(3)), (8, "short\n" + _line(2)), (8, "short\n" + _line(2)),
    (9, "\n".join(_line(k % 7) for k in range(5000))), *((10 + i, _line(i % 4) + "\nown line number " + str(i) + " of this one\n" + _line(9)) for i in range(40)), (60, "é" * 19 + "\n" + "é" * 20), (61, "é" * 20), (62, "é" * 20 + "\n" + "é" * 19),
]


@pytest.mark.parametrize(("few", "batches", "fan"), [(shared.BROADCAST_ROWS, 8, 3), (2, 5, 2), (2, 1, 3)])
def test_op13_odd_rows(spark, monkeypatch, few, batches, fan):
    """Batches, compaction and the way of the join don't matter."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", few)
    monkeypatch.setattr(line_dedup, "HEAVY", 10)
    docs = clashing(spark, NOTES, "doc_id long, text string").repartition(3)
    assert rows(digests(line_dedup.line_dedup(docs, batches=batches, fan=fan)), *LINES) == deduped(NOTES)


def test_op13_runs_are_levelled(spark):
    """Runs are sorted, merged level by level, and known keys are found in them."""
    runs = line_dedup.LineRuns(spark, fan=3, buckets=2)
    for k in range(7):
        runs.add(spark.createDataFrame([(bytes([x]), 100 - k, 1) for x in range(k, k + 3)], "key binary, doc long, n long"))
    assert [len(level) for level in runs.levels] == [1, 2]
    got = {bytes(r["key"])[0]: (r["holder"], r["n"]) for r in runs.totals().collect()}
    assert got == {x: (100 - max(0, x - 2), sum(k <= x < k + 3 for k in range(7))) for x in range(9)}
    fresh = runs.fresh(spark.createDataFrame([(bytes([x]),) for x in range(12)], "key binary"))
    assert {bytes(r["key"])[0] for r in fresh.collect()} == {9, 10, 11}
    runs.drop()


def test_empty_tables(spark):
    docs, turns = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(clashing(spark, TEXTS, "doc_id long, text string"), items.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(turns).count() == 0
    assert line_dedup.line_dedup(docs).count() == 0
