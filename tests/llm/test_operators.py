"""The numbered queries against brute force, over whole small tables and a table of odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quadspan.llm import chat, decontaminate, html, mixing, near_dedup, orc, quality, suffix, urls
from quadspan.llm.queries import ORACLE, QUERIES

from . import plain

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long"
_dice = random.Random(5)
_WORDS = ["".join(_dice.choices("abcdefghij", k=5)) for _ in range(300)]
LONG = " ".join(_dice.choices(_WORDS, k=6000))
PASSAGE = " ".join(_dice.choices(_WORDS, k=60))
ODD = [
    (1, None, None, None, None, 1),
    (2, "", "en", "a", 0, 1),
    (3, " \t\n", "en", "a", 3, 1),
    (4, "one two", "en", "a", 7, None),
    (5, "ONE  two", "en", "b", 8, 1),
    (6, LONG, "en", "b", len(LONG), 1),
    (7, LONG + " extra", "en", None, len(LONG) + 6, 1),
    (8, PASSAGE + " tail of the first é text", "en", "c", 1, 1),
    (9, "head " + PASSAGE + " other end", "en", "c", 1, 1),
    (10, PASSAGE + " tail of the first é text", "en", "c", 1, 1),
    (11, "same line here\n" * 30, "en", "c", 1, 1),
    (12, "#### $$$ %%% && || <> ** ## $$ %% && ||", "en", "c", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def cases(spark, odd):
    return [table(spark, "documents"), odd]


def test_op1_components(spark, odd, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op1_near_dedup"](spark, SF).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in plain.components(texts(table(spark, "documents")), 2).items()}
    for k in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(odd, k).collect()}
        assert got == plain.components(texts(odd), k)
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.near_dedup(empty).columns == empty.columns
    twice = {r["component_id"] for r in near_dedup.near_duplicates(odd.filter("doc_id = 6").union(odd.filter("doc_id = 6"))).collect()}
    assert twice == {6}


def test_op1_large_group_of_variants(spark):
    """More near copies than a node compares: each differs from the first in a word of its own."""
    base = _WORDS[:120]
    rows = [(i, " ".join(base[: i % 100] + [f"x{i}"] + base[i % 100 + 1 :])) for i in range(400)] + [(1000 + i, " ".join(_dice.choices(_WORDS, k=40))) for i in range(100)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == plain.components(rows, 2)


def test_op2_token_counts(spark):
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in texts(table(spark, "documents"))}
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op2_token_counts"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, found.fetchall()))


def test_op3_rules(spark):
    rows = [(1, "http://A.example.net/en/x?q#f", None), (2, "https://example.net/fr", ""), (3, None, "<a href='http://x.org/'>"), (4, "no scheme", None), (5, "http://w.org/fr/?a", None), (6, "x://notexample.com/de/", None), (7, "x://example.com/de/", None), (8, "http://planet/", None)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/fr", "net/", "block")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None)
    assert got[5] == ("w.org", "/fr/", "org/fr/", "allow")
    assert got[6][2] is None and got[7][2:] == ("example.com/de/", "block") and got[8][2] is None


def test_op4_text(spark):
    page = lambda n: f"<html><head><title>t</title><script>var a=1;</script></head><body><nav><a href='/'>Home</a></nav><article><h1>Head {n}</h1><p>First &amp; <b>bold</b>\n words of {n}.</p><p>Second&#33; part {n}</p></article><div class='comments'><p>Nice {n}!</p></div><footer>Foot</footer></body></html>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(6)] + [(6, "http://h.org/6", None), (7, None, ""), (8, "x", "<p>unclosed <b")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        want = f"Head {i}\nFirst & bold words of {i}.\nSecond! part {i}"
        assert got[i] == (want, len(want))
    assert got[6] == ("", 0) and got[7] == ("", 0) and len(got) == 9


def test_op5_held_out(spark):
    """Roles of conversations that the model hasn't seen."""
    turns = table(spark, "conversations")
    model = chat.fit(turns.filter("conv_id % 2 = 0"))
    held = turns.filter("conv_id % 2 = 1")
    got = {(r["conv_id"], r["turn"]): r["role"] for r in chat.parse(chat.as_transcripts(held), model).filter("part = 0").collect()}
    want = {(r["conv_id"], r["turn"]): r["role"] for r in held.collect()}
    assert sum(got.get(k) == x for k, x in want.items()) >= 0.95 * len(want)
    few = chat.parse(chat.as_transcripts(held), model, fan=2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, chat.parse(chat.as_transcripts(held), model).collect()))


def test_op6_removed(spark, odd, empty):
    def report(rows):
        out = {}
        for d, gone in plain.removed(rows).items():
            data = (dict(rows)[d] or "").encode()
            out[d] = (len(data), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
        return out

    def got(df):
        return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}

    assert got(QUERIES["op6_suffix_dedup"](spark, SF)) == report(texts(table(spark, "documents")))
    periodic = [(20, "ab" * 80), (21, "x" + "ab" * 60), (22, "a" * 49), (23, "a" * 51), (24, "a" * 50 + "é"), (25, "y" * 48 + "é" + "z" * 3), (26, "y" * 48 + "è" + "z" * 3)]
    rows = texts(odd) + periodic
    odd_rows = spark.createDataFrame(rows, "doc_id long, text string")
    odd_rows.write.mode("overwrite").parquet(f"file://{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/odd/documents.parquet")
    assert got(QUERIES["op6_suffix_dedup"](spark, f"{spark.conf.get('spark.checkpoint.dir')}/odd")) == report(rows)


def test_op7_mix(spark, odd, empty):
    for docs in cases(spark, odd):
        rows = mixing.mix(docs, mixing.words_of()).collect()
        assert len(rows) == docs.count()
        size = {d: len(plain.WORD.findall(t or "")) for d, t in texts(docs)}
        assert all(r["size"] == size[r["doc_id"]] and r["copies"] <= 3 for r in rows)
        sources = {}
        for r in rows:
            sources.setdefault(r["source"], []).append(r)
        order = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        total = {s: sum(r["size"] for r in sources[s]) for s in order}
        full, target = set(), {}
        while True:
            open_ = [s for s in order if s not in full]
            left = sum(total.values()) - sum(3 * total[s] for s in full)
            target = {s: 3.0 * total[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in order}
            over = {s for s in open_ if target[s] > 3 * total[s]}
            if not over:
                break
            full |= over
        for s in order:
            assert sources[s][0]["target"] == pytest.approx(target[s])
            assert abs(sum(r["copies"] * r["size"] for r in sources[s]) - target[s]) <= max(r["size"] for r in sources[s]) / 2 + 1
        again = mixing.mix(docs.repartition(5), mixing.words_of()).collect()
        assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix(empty, mixing.words_of()).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_op8_counts(spark, odd, empty):
    for docs in cases(spark, odd):
        text = dict(texts(docs))
        for r in quality.quality_report(docs).collect():
            want = plain.base_counts(text[r["doc_id"]])
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["base_failed"] and r["kept"])
        kept = {r["doc_id"] for r in quality.quality_report(docs).filter("kept").collect()}
        assert {d for d, _ in texts(quality.quality_filter(docs))} == kept
    assert quality.quality_report(empty).count() == 0
    # the order of the rules changes no verdict
    a = {r["doc_id"]: r["kept"] for r in quality.quality_report(odd, quality.RULES).collect()}
    assert a == {r["doc_id"]: r["kept"] for r in quality.quality_report(odd, quality.RULES[::-1]).collect()}


def test_op9_leaks(spark, odd, empty):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    assert got == plain.leaks(texts(docs), pairs)
    odd_items = [(1, PASSAGE), (2, None), (3, ""), (4, "One Two"), (5, " ".join(_WORDS[:30])), (6, PASSAGE.replace(PASSAGE.split()[3], "new", 1))]
    bench = spark.createDataFrame(odd_items, "item_id long, text string")
    want = plain.leaks(texts(odd), odd_items)
    assert {(8, 1), (9, 1), (10, 1), (4, 4), (5, 4)} <= want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd.drop("item_id"), bench).collect()} == want
    assert {d for d, _ in texts(decontaminate.decontaminate(odd, bench))} == {r[0] for r in ODD} - {d for d, _ in want}
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_op10_round_trip(spark, odd, empty):
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))

    def want(rows):
        out, start = {}, 0
        for d, x in sorted(rows):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
            out[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
            start += len(ids)
        return out

    def got(df):
        return {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()}

    assert got(QUERIES["op10_token_ids"](spark, SF)) == want(texts(table(spark, "documents")))
    for docs, rows in ((odd, texts(odd)), (empty, [])):
        at = f"{spark.conf.get('spark.checkpoint.dir')}/orc{len(rows)}"
        orc.write_token_ids(docs, at)
        assert got(orc.token_report(spark, at)) == want(rows)


def test_pipeline(spark):
    """Each stage against its brute-force version on the rows that the plain versions keep."""
    docs = table(spark, "documents")
    kept = {r["doc_id"] for r in quality.quality_report(docs, quality.RULES).filter("kept").collect()}
    rows = [x for x in texts(docs) if x[0] in kept]
    rows = [x for x, c in zip(rows, [plain.components(rows, 5)] * len(rows)) if c[x[0]][1] == x[0]]
    gone = {d for d, _ in plain.leaks(rows, [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()])}
    rows = [x for x in rows if x[0] not in gone]
    left = docs.filter(docs["doc_id"].isin([d for d, _ in rows]))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(left, mixing.words_of()).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    start, want = 0, []
    for d, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        for _ in range(copies[d]):
            want.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
            start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "decontamination", "mixing", "token ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_op6_spans(spark, odd):
    """The operator's spans and remaining bytes are those of the brute force."""
    rows = texts(odd)
    gone, data = plain.removed(rows), {d: (t or "").encode() for d, t in rows}
    for r in suffix.remove_repeats(odd).collect():
        d = r["doc_id"]
        assert bytes(r["kept"]) == bytes(b for b, g in zip(data[d], gone[d]) if not g)
        assert len(r["spans"]) == len(re.findall(b"\1+", gone[d]))
