"""Lines of N-Quads: what each part is, and one match for a line."""

from quadspan.model import inline
from quadspan.sources import ntriples

X = "http://www.w3.org/2001/XMLSchema#string"
GOOD = [
    ("<a> <p> <b> .", ("a", 0, "p", "b", 0, None, None, None)),
    ("_:a<p>_:b.# said", ("_:a", 1, "p", "_:b", 1, None, None, None)),
    ('<a> <p> "x \\"y\\" \\\\" <g> .', ("a", 0, "p", 'x "y" \\', 2, X, None, "g")),
    ('<a> <p> ""@en-GB _:g .', ("a", 0, "p", "", 2, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en-GB", "_:g")),
    ('<a> <p> "1"^^<t"^^<u> <> .', ("a", 0, "p", "1", 2, 't"^^<u', None, "")),
    ('<a> <p> "$1 \\t@en\\"^^<v>" .', ("a", 0, "p", '$1 \t@en"^^<v>', 2, X, None, None)),
    ("<> <> <> <> .", ("", 0, "", "", 0, None, None, "")),
    ('<a> <p> "1"^^<> .', ("a", 0, "p", "1", 2, X, None, None)),
    ('<a> <p> "' + "long \\\\ " * 20_000 + '" .', ("a", 0, "p", "long \\ " * 20_000, 2, X, None, None)),
]
BAD = ["", "# nothing", "<a> <p> .", '<a> <p> "x .', '<a> "p" <b> .', "<a> <p> <b> <g>", "<a> _:p <b> ."]


def test_parts_of_lines(spark):
    lines = inline(spark, [(x,) for x in [line for line, _ in GOOD] + BAD], "value string")
    got = [tuple(r) for r in ntriples.parse_lines(lines).collect()]
    assert got == [parts for _, parts in GOOD]


def test_a_line_is_matched_once(spark, tmp_path):
    (tmp_path / "a.nq").write_text("\n".join(line for line, _ in GOOD))
    plan = ntriples.read_quads(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan
    assert sorted(r["seq"] for r in ntriples.read_quads(spark, str(tmp_path)).collect()) == list(range(len(GOOD)))
    places = {(r["doc"], r["seq"]) for r in ntriples.read_places(spark, str(tmp_path)).collect()}
    assert places == {(r["doc"], r["seq"]) for r in ntriples.read_quads(spark, str(tmp_path)).collect()}
