"""op5: Viterbi against all paths, and roles of held-out transcripts in one text with markers missing."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from quadspan.llm import chat


def test_viterbi_against_all_paths():
    dice = np.random.default_rng(2)
    for _ in range(40):
        scores, moves, enter = dice.normal(size=(5, 4)), dice.normal(size=(4, 4)), dice.normal(size=4)
        value = lambda p: enter[p[0]] + sum(scores[i, s] for i, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(4), repeat=5), key=value)
        assert tuple(chat.viterbi(scores, moves, enter)) == best
        ends = max((p for p in itertools.product(range(4), repeat=5) if p[-1] == 2), key=value)
        assert tuple(chat.viterbi(scores, moves, enter, 2)) == ends


def test_held_out_transcripts_in_one_text(spark):
    """Each held-out conversation is one text; a tenth of its turns has no marker, and some lines mislead."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").filter("text is not null")
    model = chat.fit(turns.filter("conv_id % 2 = 0"))
    held = turns.filter("conv_id % 2 = 1").dropDuplicates(["conv_id", "turn"])
    shown = chat.as_transcripts(held, 10).withColumn("text", F.regexp_replace("text", "\n", " "))
    joined = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("x"))
    whole = joined.select("conv_id", F.lit(0).cast("long").alias("turn"), F.concat_ws("\n", F.transform("x", lambda t: F.concat(t["text"], F.lit("\nNote: see above")))).alias("text"))
    got = chat.parse(whole, model).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "role", "text"))).alias("y"))
    right = total = marked = marked_right = 0
    for r in got.join(joined, "conv_id").collect():
        found = {}
        for part in r["y"]:  # a turn's role is that of the part that has its words
            for line in part["text"].split("\n"):
                found.setdefault(line.strip(), part["role"])
        for t in r["x"]:
            _, at = chat.marker(t["text"])
            role = found.get(t["text"][at:].strip())
            total, right = total + 1, right + (role == t["role"])
            if at:
                marked, marked_right = marked + 1, marked_right + (role == t["role"])
    assert total > 250 and right >= 0.9 * total and marked_right >= 0.97 * marked, (right, total, marked_right, marked)


def test_nulls_ties_and_an_empty_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    model = chat.fit(turns)
    rows = [(None, None, None, 1), (None, None, None, 1), (1, 0, "", 2), (1, 0, "User: a", 2), (1, 0, "User: a", 2), (1, None, "Bot: b", 3)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, text string, role int")
    got = chat.parse(docs, model).collect()
    assert len(got) == 6 and sorted(str(r["text"]) for r in got) == ["", "", "", "a", "a", "b"]
    assert chat.parse(docs.limit(0), model).count() == 0
