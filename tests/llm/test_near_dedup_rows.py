"""near_dedup decides by row: repeated rows and rows without an id."""

from __future__ import annotations

import random

from quadspan.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string, source string"
_dice = random.Random(3)
WORDS = ["".join(_dice.choices("abcdefghij", k=6)) for _ in range(400)]
said = lambda: " ".join(_dice.choices(WORDS, k=60))


def test_one_row_of_each_component_stays(spark):
    copied, keyless, alone, other = said(), said(), said(), said()
    rows = [(1, copied, "en", "a")] * 3 + [(1, copied.upper(), "en", "b"), (1, other, "en", "a"), (2, copied, "en", "a")]  # one id, several rows and texts
    rows += [(None, keyless, "en", "a")] * 5 + [(None, keyless, None, "en"), (None, keyless, "en", None), (None, copied, "en", "a"), (None, alone, "en", "a")]
    rows += [(None, "", "en", "a"), (None, None, "en", "a"), (3, "", "en", "a")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    texts = [(r["doc_id"], (r["text"] or "").lower()) for r in got]
    assert sorted(texts, key=str) == sorted([(1, copied), (1, other), (None, keyless), (None, alone), (None, ""), (None, ""), (3, "")], key=str)
    assert all(tuple(r) in rows for r in got)
    again = near_dedup.near_dedup(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
