"""op6 where ids are null or repeated with different texts."""

from __future__ import annotations

import random
import re

import pytest

from quadspan.llm import suffix

from . import plain

_dice = random.Random(11)
WORDS = ["".join(_dice.choices("abcdefghij", k=6)) for _ in range(400)]
said = lambda n: " ".join(_dice.choices(WORDS, k=n))


@pytest.mark.parametrize("same", [None, 900])
def test_op6_null_and_repeated_ids(spark, same):
    """A passage of a small document is removed from every row of one larger (or null) id, wherever the rows are."""
    passage = said(20)
    small = [(5, "first " + passage + " " + said(15))]
    many = [(same, said(12) + " " + passage + " " + said(12)) for _ in range(40)]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(small, schema).coalesce(1).union(spark.createDataFrame(many, schema).coalesce(2))
    kept = sorted(bytes(r["kept"]).decode() for r in suffix.remove_repeats(docs).collect())
    assert not any(passage in k for k in kept if not k.startswith("first"))
    assert sum(passage in k for k in kept) == 1 and len(kept) == 41
    alone = suffix.remove_repeats(spark.createDataFrame(many, schema).repartition(3)).collect()
    assert sorted(bytes(r["kept"]).decode() for r in alone) == sorted(t for _, t in many)


@pytest.mark.parametrize("many", [3, 10**9])
def test_op6_frequent_anchors_and_ranges(spark, many):
    """The same result whether an anchor's contexts meet in one task or are cut by prefix lengths; against brute force."""
    frequent, dice = said(16), random.Random(many)
    rows = [(i, " ".join(dice.choices(WORDS, k=dice.randint(0, 6)) + [frequent] * dice.randint(0, 2) + dice.choices(WORDS, k=dice.randint(0, 9)))) for i in range(60)]
    rows += [(60, "ab" * 90), (61, "b" + "ab" * 70), (62, "é" * 40), (63, "x" + "é" * 30), (64, None), (65, ""), (66, rows[3][1]), (67, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", suffix.F.lit("clash"))
    gone = plain.removed(rows)
    for r in suffix.remove_repeats(docs.repartition(5), many=many).collect():
        data, cut = (dict(rows)[r["doc_id"]] or "").encode(), gone[r["doc_id"]]
        assert bytes(r["kept"]) == bytes(b for b, g in zip(data, cut) if not g)
        assert [(s["s"], s["e"]) for s in r["spans"]] == [m.span() for m in re.finditer(b"\1+", cut)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(empty, many=many).count() == 0


def test_op6_texts_stay_where_they_are(spark, monkeypatch):
    """A long passage has an anchor every fourteen bytes; what is sent back to the chunks is a run, not their reaches."""
    passage, dice = said(600), random.Random(5)
    rows = [(i, " ".join(dice.choices(WORDS, k=9)) + " " + passage) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes, light = [], suffix.light
    monkeypatch.setattr(suffix, "light", lambda df, size: sizes.append(df.agg(suffix.F.sum(size)).first()[0]) or light(df, size))
    found = suffix.remove_repeats(docs)
    assert 0 < sizes[-1] < 400, sizes
    gone = plain.removed(rows)
    assert all(bytes(r["kept"]) == bytes(b for b, g in zip(dict(rows)[r["doc_id"]].encode(), gone[r["doc_id"]]) if not g) for r in found.collect())
