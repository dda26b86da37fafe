"""Empty tables, repeated rows, nulls, long texts and clashing columns, for the operators that lacked such tests."""

from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from quadspan.llm import chat, decontaminate, html, orc, token_counts
from quadspan.llm.near_dedup import trees_needed
from quadspan.llm.shared import new_path

_dice = random.Random(8)
WORDS = ["".join(_dice.choices("abcdefghij", k=5)) for _ in range(300)]
CLASH = "row long, key string, number long, kind string, task long, chunk long, id string, host string"


def clashing(spark, rows, schema):
    return spark.createDataFrame([(*r, 1, "k", 2, "x", 3, 4, "i", "h") for r in rows], f"{schema}, {CLASH}")


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_op2_blocks_keys_and_odd_rows(spark, block):
    """Counts and keys of rows as they lie, with blocks that cut documents."""
    rows = [(1, "one two three"), (1, "one two three"), (1, "other"), (None, None), (None, "null key"), (2, ""), (3, " ".join(_dice.choices(WORDS, k=3000))), (4, "ünï ćode   x")]
    at = new_path(spark, "flat")
    token_counts.write_flat(clashing(spark, rows, "doc_id long, text string").repartition(3), at)
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = sorted((str(d), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows)
    got = token_counts.keys_of(spark, at).join(token_counts.count_tokens(spark, at, block=block), "number").collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want
    assert sorted(r["number"] for r in got) == list(range(len(rows)))


def test_op2_empty(spark):
    at = new_path(spark, "flat")
    token_counts.write_flat(spark.createDataFrame([], "doc_id long, text string"), at)
    assert token_counts.keys_of(spark, at).count() == token_counts.count_tokens(spark, at).count() == 0


def test_op4_odd_rows(spark):
    page = "<article><p>A text</p></article>"
    rows = [(1, "http://h/1", page)] * 3 + [(None, None, page), (2, "http://h/2", None), (3, "http://h/3", "<p>" + "long " * 200_000)]
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in html.main_text(clashing(spark, rows, "page_id long, url string, html string").drop("host")).collect())
    assert got == sorted([("1", 6)] * 3 + [("None", 6), ("2", 0), ("3", 999_999)])
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op4_whole_table_against_all_pages_of_a_host(spark):
    """The text that a page keeps is what it says besides the texts that most pages of its host have in one place, and
    the groups that a host is dealt to don't matter."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    again = {r["page_id"]: r["text"] for r in html.main_text(pages.repartition(5)).collect()}
    assert got == again
    for r in pages.collect():
        blocks = {text for _, text in html.outline(r["html"])[3]}
        assert set(got[r["page_id"]].split("\n")) - {""} <= {line for b in blocks for line in b.split("\n")}


def test_op9_long_text_and_parts(spark, monkeypatch):
    """A benchmark item at the border of two parts of a long document is found, once."""
    item = " ".join(_dice.choices(WORDS, k=40))
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    index = decontaminate.Index([(7, item)])
    for at in (0, 20, 50, 63, 64, 65, 127, 200):
        words = _dice.choices(WORDS, k=300)
        words[at:at] = item.split()
        for _, t in decontaminate.chunks(decontaminate.pa.array([" ".join(words)]), lower=True):
            assert [(r[1], r[2], r[4], r[5]) for r in index.scan(t)] == [(7, at, 36, 36)]
    docs = clashing(spark, [(1, item), (1, item), (None, item), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontaminate.contaminated(docs, bench).collect()) == ["1", "1", "None"]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [2]


def test_op10_ties_and_pruning(spark):
    """start follows the file's rows where an id has several texts; a filter on ids reads fewer rows."""
    rows = [(5, "a a a"), (5, "b"), (5, "a a a"), (None, "z"), (4, None), *((i, "w " * (i % 9)) for i in range(10, 3000))]
    at = new_path(spark, "orc")
    orc.write_token_ids(clashing(spark, rows, "doc_id long, text string").repartition(4), at, files=3)
    got = sorted(orc.token_report(spark, at).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows) and got[0]["doc_id"] is None
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    files = spark.read.orc(at).inputFiles()
    held = {str(r["f"]) for r in orc.read_token_ids(spark, at).filter("doc_id = 2000").select(orc.F.input_file_name().alias("f")).collect()}
    assert len(held) == 1 and len(files) == 3
    one = orc.read_token_ids(spark, at).filter("doc_id = 2000")
    assert "doc_id,2000" in one._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    assert one.count() == 1


def test_op5_block_size_does_not_matter(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    model = chat.fit(turns)
    shown = chat.as_transcripts(turns, 30)
    assert sorted(map(str, chat.parse(shown, model, fan=3).collect())) == sorted(map(str, chat.parse(shown, model).collect()))


def test_trees_for_a_target_recall():
    assert [trees_needed(d, 80, 0.999) for d in (1, 2, 3)] == [5, 7, 8]
    assert trees_needed(1, 80, 0.9) == 2 and trees_needed(5, 100, 0.99) == 1


def test_op10_one_id_for_most_rows(spark, tmp_path):
    """A hot id, with equal and with different texts, is dealt to several files, and starts stay whole."""
    rows = [(7, "the same text")] * 1500 + [(7, f"text number {i}") for i in range(1500)] + [(i, "x y") for i in range(100) if i != 7] + [(None, None)] * 50
    at = f"file://{tmp_path}/hot"
    orc.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), at, files=6)
    held = orc.read_token_ids(spark, at).filter("doc_id = 7").groupBy(orc.F.input_file_name()).count().collect()
    assert len(held) >= 4 and max(r["count"] for r in held) < 1200
    got = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in orc.token_report(spark, at).collect())
    assert len(got) == len(rows) and all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(got, got[1:]))
