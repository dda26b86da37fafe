"""op3's propagation over a planted host graph of many hops, against a plain power iteration."""

from __future__ import annotations

from collections import defaultdict

from quadspan.llm import urls


def plain(pages):
    """host: (trust, distrust, blocked), by the definition in exact fractions of the unit."""
    links, counts = defaultdict(int), defaultdict(lambda: [0, 0, 0])
    for host, good, bad, targets in pages:
        counts[host][0] += 1
        counts[host][1] += good
        counts[host][2] += bad
        for t in set(targets):
            if t != host:
                links[host, t] += 1
    seeds = {"trust": [h for h, (n, g, _) in counts.items() if 2 * g > n], "distrust": [h for h, (n, _, b) in counts.items() if 2 * b > n]}
    out = {}
    for kind, own in seeds.items():
        edges = defaultdict(list)
        total = defaultdict(int)
        for (a, b), n in links.items():
            src, dst = (a, b) if kind == "trust" else (b, a)
            edges[src].append((dst, n))
            total[src] += n
        base = {h: 0.15 / len(own) for h in own}
        rank = dict(base)
        for _ in range(400):
            new = defaultdict(float, base)
            for src, score in rank.items():
                for dst, n in edges[src]:
                    new[dst] += 0.85 * score * n / total[src]
            rank = new
        out[kind] = rank
    least = 0.15 / len(seeds["distrust"]) / urls.SHARE
    return {h: out["distrust"].get(h, 0) >= least and out["distrust"].get(h, 0) > out["trust"].get(h, 0) for h in {*out["trust"], *out["distrust"]}}


def test_many_hops(spark):
    page = lambda targets: "".join(f"<a href='http://{t}/x'>l</a>" for t in targets)
    chain = [f"c{i}.com" for i in range(22)]
    hosts = {chain[i]: [chain[i + 1]] for i in range(21)} | {chain[21]: ["bad.net"]} | {"bad.net": [], "good.org": ["mid.com", "both.com"], "mid.com": ["leaf.com"], "leaf.com": [], "both.com": ["bad.net"], "alone.com": []}
    rows = [(i, f"http://{h}/{'fr/' if h == 'good.org' else ''}p", page(t)) for i, (h, t) in enumerate(hosts.items())]
    rows += [(100 + i, "http://c5.com/q", page([chain[6]])) for i in range(300)]  # one host with most pages
    seen = [(urls_host, h_good, h_bad, t) for urls_host, h_good, h_bad, t in ((h, int(h == "good.org"), int(h == "bad.net"), t) for h, t in hosts.items())] + [("c5.com", 0, 0, [chain[6]])] * 300
    want = plain(seen)
    got = {r["host"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {h for h, v in got.items() if v == "block" and h != "bad.net"} == {h for h, b in want.items() if b and h != "bad.net"}
    # a host many links before the blocked one still gets its share
    assert sum(got[c] == "block" for c in chain) > 8 and got["alone.com"] == got["leaf.com"] == "allow"


def test_empty_and_repeated_rows(spark):
    schema = "page_id long, url string, html string, host string"
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://a.net/x", None, "clash")] * 3 + [(None, None, None, None)]
    got = sorted(str((r["page_id"], r["host"], r["verdict"])) for r in urls.judge(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([str((1, "a.net", "block"))] * 3 + [str((None, "", "allow"))])


def test_a_hub_hands_on_all_of_its_score(spark):
    """A trusted hub of two million links to hosts that all link to one: each link's part is below a millionth."""
    n = 2_000_000
    many = spark.range(n).select(urls.F.concat(urls.F.lit("m"), "id").alias("m"))
    edge = lambda src, dst, total: many.select(urls.F.lit("trust").alias("kind"), src.alias("src"), dst.alias("dst"), urls.F.lit(1).cast("long").alias("n"), urls.F.lit(total).cast("long").alias("total"))
    edges = edge(urls.F.lit("hub"), urls.F.col("m"), n).unionByName(edge(urls.F.col("m"), urls.F.lit("end"), 1))
    seeds = spark.createDataFrame([("trust", "hub")], "kind string, host string")
    found = {r["host"]: int(r["score"]) for r in urls.propagate(seeds, edges).filter("host in ('hub', 'end', 'm7')").collect()}
    assert found["hub"] == urls.BASE
    assert abs(found["end"] - urls.BASE * 0.85**2) <= 2 * n and found["m7"] == urls.BASE * 85 // (100 * n)


def test_sql_on_the_planted_graph(spark):
    """The SQL's 64 rounds give the verdicts of the rounds that stop by themselves."""
    import duckdb

    links = {"a.com": ["b.com"], "b.com": ["c.com", "bad.net"], "c.com": ["a.com"], "bad.net": [], "good.org": ["b.com", "z.com"], "z.com": ["bad.net"], "y.com": ["z.com"]}
    rows = [(i, f"http://{h}/{'fr/' if h == 'good.org' else ''}p", "".join(f"<a href='http://{t}/x'>l</a>" for t in own)) for i, (h, own) in enumerate(links.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect())
    with duckdb.connect() as db:
        db.register("pages", pages.toPandas())
        assert sorted(db.sql(urls.OP3_SQL).fetchall()) == got
    assert {v for *_, v in got} == {"allow", "block"}
