"""Wrapper induction where the template is most of each page's blocks."""

from __future__ import annotations

from quadspan.llm import html


def test_op4_opaque_boilerplate_and_short_articles(spark):
    """No element says what it is: four blocks are the same on all pages, three are the page's own."""
    own = lambda n: [f"Opening {n} of its own.", f"Middle {n} says more.", f"Ending {n} closes."]
    page = lambda n: "<body>" + "".join(f"<div class='q{i}'>Boilerplate {i} of the host.</div>" for i in range(4)) + "".join(f"<p>{x}</p>" for x in own(n)) + "</body>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(12)] + [(100 + i, f"http://h.org/c{i}", page(0)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(own(i if i < 100 else 0)) for i, _, _ in rows}


def test_op4_copies_make_no_template(spark):
    """Copies of one page that differ in the host's template only don't outvote the other pages."""
    page = lambda n, foot: f"<body><div>Same on all.</div><p>Text {n} of the page.</p><p>More of {n}.</p>{foot}</body>"
    rows = [(0, "http://h.org/0", page(0, "<div>Foot of all.</div>")), (1, "http://h.org/1", page(0, ""))] + [(i, f"http://h.org/{i}", page(i, "<div>Foot of all.</div>")) for i in range(2, 12)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {max(i, 0) if i != 1 else 0} of the page.\nMore of {i if i != 1 else 0}." for i in range(12)}


def test_op4_formulas_stay(spark):
    rows = [(1, "http://h.org/1", "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>")]
    assert html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["text"] == "Let x=2 hold."


def plain_text(pages):
    """id: text, by one wrapper for each host over all of its different pages; no groups, no Spark."""
    hosts = {}
    for i, url, page in pages:
        hosts.setdefault(url.partition("://")[2].partition("/")[0].lower(), []).append((i, html.outline(page)))
    out = {}
    for own in hosts.values():
        n, counts = html.evidence([o[:3] for _, o in own])
        fixed = {k for k, c in counts.items() if n >= html.LEAST_PAGES and 100 * c >= html.CONSTANT * n}
        for i, o in own:
            out[i] = "\n".join(t for k, t in o[3] if k not in fixed)
    return out


def test_op4_against_one_wrapper_for_a_whole_host(spark):
    """Many groups of a host together find what one wrapper over the host finds; a third of the rows is one page."""
    page = lambda n: f"<body><div>Host head.</div><div class='k'><p>Say {n} once.</p><p>Fixed line.</p>{'<p>Rare.</p>' if n % 9 == 0 else ''}</div><table>" + "".join(f"<tr><td>{n * k}</td><td>unit</td></tr>" for k in range(n % 4)) + f"</table><div>Foot of the host</div><p>See <a>more {n}</a></p></body>"
    rows = [(i, f"http://h{i % 2}.org/{i}", page(i)) for i in range(300)] + [(1000 + i, f"http://h0.org/c{i}", page(0)) for i in range(150)]
    rows += [(2000 + i, f"http://one.org/{i}", "<p>alone</p>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == plain_text(rows)
    assert got[3].startswith("Say 3 once.\n") and got[3].endswith("See more 3") and "Host head." not in got[3] and "Foot" not in got[3]


def test_op4_given_pages_against_one_wrapper(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert got == plain_text([tuple(r) for r in pages.collect()])
