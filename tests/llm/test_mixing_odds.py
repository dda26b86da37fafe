"""op7's inclusion: probabilities by propensity, certain copies, and rows that share an id or have none."""

from __future__ import annotations

import random
from collections import defaultdict

from quadspan.llm import mixing


def test_inclusion_frequencies(spark):
    """Many sources of equal make-up stand for many draws.  The plain version draws by the definition."""
    sizes = [1] * 40 + [3] * 30 + [15] * 20 + [63] * 10
    draws = 240
    rows = [(s * 1000 + i, " ".join(["w"] * n), f"s{s:04d}", n) for s in range(draws) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    got = mixing.mix(docs, mixing.words_of()).collect()
    share, want = defaultdict(list), defaultdict(list)
    for r in got:
        whole = int(r["target"] / r["source_size"])
        share[r["source"], r["size"]].append(r["copies"] - whole)
        want[r["source"], r["size"]].append(r["p"])
    for kind in {w for w in {tuple(sorted({(n, round(p[0], 9)) for (s, n), p in want.items() if s == x})) for x in {s for s, _ in want}}}:
        same = [s for s in {s for s, _ in want} if tuple(sorted({(n, round(p[0], 9)) for (y, n), p in want.items() if y == s})) == kind]
        for n, p in kind:
            mean = sum(sum(share[s, n]) for s in same) / sum(len(share[s, n]) for s in same)
            assert abs(mean - p) < 0.06, (n, p, mean)
        dice, taken, plain_p = random.Random(1), defaultdict(list), dict(kind)
        need = sum(plain_p[n] * n for n in sizes)
        for _ in range(draws):  # the definition: ranks are random odds by inclusion odds
            rank = lambda n: 0 if plain_p[n] >= 1 else (u := dice.random()) / (1 - u) * (1 - plain_p[n]) / max(plain_p[n], 1e-12)
            upto = 0
            for n in sorted(sizes, key=lambda n: rank(n)):
                taken[n].append(upto + n / 2 <= need)
                upto += n
        for n, p in kind:
            assert abs(sum(taken[n]) / len(taken[n]) - sum(sum(share[s, n]) for s in same) / sum(len(share[s, n]) for s in same)) < 0.08
        # longer documents are likelier, in proportion to their propensity where none is certain
        assert all(a[1] <= b[1] for a, b in zip(kind, kind[1:]))


def test_certain_copies(spark):
    """A document so likely that its probability passes one is certain, and the others share the rest."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (500 if i == 0 else 2)), s) for s in ("a", "b", "c") for i in range(60)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, mixing.words_of(), propensity=mixing.F.when(mixing.words_of() > 100, 1e6).otherwise(1.0)).collect()
    for r in rows:
        assert 0 <= r["p"] <= 1 and (r["p"] < 1 or r["copies"] == int(r["target"] / r["source_size"]) + 1)
    assert any(r["p"] == 1 and r["size"] == 500 for r in rows)


def test_rows_without_an_id_or_with_one_id_and_clashing_columns(spark):
    text = lambda i: f"word{i} " * (i % 7 + 1)
    rows = [(None if i % 2 else 7, text(i), "a" if i % 3 else None, i, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies long, row long")
    found = mixing.mixed(docs)
    assert found.columns == docs.columns
    got = [tuple(r) for r in found.collect()]
    assert set(got) <= set(rows)
    size = sum(len(r[1].split()) for r in rows)
    assert abs(sum(len(r[1].split()) for r in got) - size) < 0.1 * size
    again = [tuple(r) for r in mixing.mixed(docs.repartition(3)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_equal_rows_are_drawn_one_by_one(spark):
    """A source of one row, repeated: its target lies between none and all of them, and is met to the row."""
    rows = [(1, "one two three four five", "a")] * 3000 + [(2, "x y z", "b")] * 40 + [(10 + i, "w " * (i % 9 + 1), "c") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, mixing.words_of()).collect()
    assert len(got) == len(rows)
    for name in "abc":
        own = [r for r in got if r["source"] == name]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 5
        assert len({r["copies"] for r in own}) == 2 or own[0]["target"] == 3 * own[0]["source_size"]
    made = sorted(map(str, mixing.mixed(docs).collect()))
    assert made == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))
    assert sum(len(r[1].split()) for r in mixing.mixed(docs).collect()) == sum(r["size"] * r["copies"] for r in got)
