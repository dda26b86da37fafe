"""op5's blocks are bounded by rows, not by turn values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quadspan.llm import chat

SCHEMA = "conv_id long, turn long, text string"


@pytest.mark.parametrize("conv,turn", [(7, lambda i: None), (None, lambda i: 0), (None, lambda i: i // 10), (7, lambda i: i * 1000)])
def test_op5_blocks_of_hot_conversations(spark, conv, turn):
    rows = [(conv, turn(i), ("User: ask " if i % 2 else "Assistant: tell ") + f"{i:05d}") for i in range(300)] + [(8, i, f"User: short {i}") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    turns = df.select(F.col("conv_id").alias("id"), F.coalesce("turn", F.lit(0)).alias("n"), "text").filter("id is null or id = 7")
    blocks = chat.placed(turns, 8).collect()
    assert sorted(r["block"] for r in blocks) == [i // 8 for i in range(300)]
    order = [(r["n"], r["text"]) for r in sorted(blocks, key=lambda r: (r["block"], r["n"], r["text"]))]
    assert order == sorted(order)


def test_op5_null_ids_in_blocks_are_one_run(spark):
    """Many small blocks give what one block gives, null ids and equal rows included."""
    labelled = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "x?" if t % 2 == 0 else "a long answer") for c in range(20) for t in range(6)], "conv_id long, turn long, role string, text string")
    model = chat.fit(labelled)
    texts = ["User: x?", "a plain line", "Assistant: a long answer\nand on", "> ok?", "[Guest] who"]
    rows = [(None, i // 3, texts[i % 5]) for i in range(90)] + [(1, None, "User: same")] * 40 + [(1, 2, None)] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    few, whole = (sorted(map(str, chat.parse(df, model, fan=f).collect())) for f in (4, 512))
    assert few == whole and len(few) >= len(rows)
