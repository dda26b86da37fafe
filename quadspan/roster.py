"""The named queries of the graph engine, and the SQL of each.

Queries run over the tables as a graph (``sources.rdfview``); their SQL runs over the same triples as a view T."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab as v
from .functions import terms as fn
from .model import TRIPLE, Graph, inline, term_key, union
from .operators import closure as paths
from .operators import construct as build
from .plans import checks as k
from .plans import oracle, passes, reasoner, repairs, shapes, triplify
from .sources import rdfview
from .sources.rdfview import EX, TableGraph, sql_view
from .storage import stored

c, lit = F.col, F.lit
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TY = oracle.TY


def add(name: str, run: Callable[[TableGraph], DataFrame], sql: str | None = None, ctes: str = "") -> None:
    """A query over the graph; its SQL may use T and further CTEs."""
    QUERIES[name] = lambda spark, sf_dir: run(TableGraph(spark, sf_dir))
    if sql:
        ORACLE[name] = f"WITH RECURSIVE {sql_view()}{', ' + ctes if ctes else ''} {sql}"


def _named(run, id: str):
    return lambda g: run(g).withColumns({"check_id": lit(id), "severity": lit(k.CHECKS[id].severity)})


def _wrapped(id: str, body: str) -> str:
    return f"SELECT DISTINCT focus_node, CAST(path AS VARCHAR) AS path, coalesce(CAST(value AS VARCHAR), focus_node) AS value, '{id}' AS check_id, '{k.CHECKS[id].severity}' AS severity FROM ({body})"


# --- checks and shapes -------------------------------------------------------------------------------------------

oracle.BODIES |= {
    "MDL-001": ("", f"SELECT s AS focus_node, NULL AS path, o AS value FROM T WHERE p = '{v.INVERSE}' AND sk = 0 AND ok = 0 AND s IN {oracle.typed(v.OBJ_PROP, v.DATA_PROP)}"),
    "MDL-002": ("", f"SELECT s AS focus_node, NULL AS path, o AS value FROM T WHERE p = '{v.EQUIV_CLASS}' AND sk = 0 AND ok = 0 AND s IN {oracle.typed(v.CLASS)}"),
    "MDL-003": ("", f"SELECT s AS focus_node, NULL AS path, NULL AS value FROM {oracle.typed(v.CLASS)} WHERE NOT starts_with(s, '_:') AND s NOT IN (SELECT s FROM T WHERE p NOT IN ({', '.join(map(repr, (v.TYPE, v.LABEL, v.PREF_LABEL, v.COMMENT, v.DEFINITION, v.SEE_ALSO, v.DEFINED_BY, v.VERSION_INFO)))}) AND NOT (p = '{v.EQUIV_CLASS}' AND ok = 0))"),
    "VOC-001": (
        f"u AS (SELECT s, p, p AS t FROM T WHERE p <> {TY} AND sk = 0 UNION SELECT s, p, o FROM T WHERE sk = 0 AND ok = 0 AND p IN ({', '.join(map(repr, passes.TERM_PREDICATES))})), voc AS (SELECT DISTINCT regexp_replace(s, '[^#/]*$', '') AS ns FROM {oracle.typed()} WHERE NOT starts_with(s, '_:'))",
        f"SELECT s AS focus_node, p AS path, t AS value FROM u WHERE regexp_replace(t, '[^#/]*$', '') IN (SELECT ns FROM voc) AND t NOT IN {oracle.typed()}",
    ),
}
for _id, _check in list(k.CHECKS.items()):
    add("check_" + _id.lower().replace("-", "_"), _named(_check.run, _id), _wrapped(_id, oracle.BODIES[_id][1]), oracle.BODIES[_id][0])
_targets = {"EFF-001": (v.CLASS,), "QUA-002": (v.ONTOLOGY,), "STY-001": (v.CLASS,), "LOG-001": (v.CLASS,), "LOG-003": (v.CLASS,), "STY-002-obj": (v.OBJ_PROP,), "STY-002-data": (v.DATA_PROP,)}
for _shape in shapes.SHAPES.values():
    _more, _body = oracle.BODIES[_shape.check_id]
    if _shape.id in _targets:
        _body = f"SELECT * FROM ({_body}) WHERE focus_node IN {oracle.typed(*_targets[_shape.id])}"
    add("shacl_" + _shape.id.lower().replace("-", "_"), _named(_shape.run, _shape.check_id), _wrapped(_shape.check_id, _body), _more)


def _headless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-005 where no ontology is declared: over the tables alone."""
    return _named(k.qua_005, "QUA-005")(TableGraph(spark, sf_dir, [t for t in rdfview.ontology() if t[2] != v.ONTOLOGY]))


QUERIES["check_qua_005_headless"] = _headless
ORACLE["check_qua_005_headless"] = f"WITH {sql_view()} SELECT '{v.GRAPH}' AS focus_node, CAST(NULL AS VARCHAR) AS path, '{v.GRAPH}' AS value, 'QUA-005' AS check_id, 'Warning' AS severity FROM T WHERE p = {TY} AND o = '{v.ONTOLOGY}' AND NOT starts_with(s, 'http') HAVING count(*) = 0"

_LITERAL = f"SELECT s AS focus_node, p AS path, o AS value FROM T WHERE ok = 2 AND dt IN ('{v.XSD}date', '{v.XSD}dateTime') AND regexp_matches(o, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(substr(o, 1, 10) AS DATE) IS NULL"
add("literal_typing", lambda g: passes.literal_typing(g).select("s", "p", "o"), f"SELECT DISTINCT focus_node AS s, path AS p, value AS o FROM ({_LITERAL})")
RULES = [(EX + "Order", [v.LABEL, EX + "placedBy"]), (EX + "Customer", [EX + "hasOrder"])]
_PRJ = " UNION ALL ".join(f"SELECT s AS focus_node, '{p}' AS path, '{cls}' AS value FROM {oracle.typed(cls)} WHERE s NOT IN {oracle.having(p)}" for cls, ps in RULES for p in ps)
add("prj_required", lambda g: passes.required(g, RULES), f"SELECT DISTINCT focus_node, path, value FROM ({_PRJ})")


def _merged(g: Graph) -> DataFrame:
    return passes.run_checks(stored(g), rules=RULES).select("check_id", "severity", "focus_node", "path", "value", F.array_join("sources", "|").alias("sources"))


def _one(id: str, sev: str, source: str, more: str, body: str) -> str:
    inner = f"WITH RECURSIVE {more} {body}" if more else body
    return f"SELECT DISTINCT '{id}' AS check_id, '{sev}' AS severity, focus_node, CAST(path AS VARCHAR) AS path, coalesce(CAST(value AS VARCHAR), focus_node) AS value, '{source}' AS source FROM ({inner})"


_all = [_one(i, k.CHECKS[i].severity, {"MDL": "guidance", "VOC": "vocabulary"}.get(i[:3], "sparql"), *oracle.BODIES[i]) for i in k.CHECKS]
_all += [_one("DAT-001", "Violation", "literal", "", _LITERAL), _one("PRJ-REQUIRED", "Violation", "rules", "", _PRJ)]
_merge_sql = "SELECT check_id, max(severity) AS severity, focus_node, path, value, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM F GROUP BY check_id, focus_node, path, value"
add("findings_merged", _merged, _merge_sql, f"F AS ({' UNION ALL '.join(_all)})")
add("findings_by_severity", lambda g: _merged(g).groupBy("check_id", "severity").agg(F.count("*").alias("n")), f"SELECT check_id, severity, count(*) AS n FROM ({_merge_sql}) GROUP BY check_id, severity", f"F AS ({' UNION ALL '.join(_all)})")

# --- algebra -------------------------------------------------------------------------------------------------------

so = lambda t, s="s", o="o": t.select(c("s").alias(s), c("o").alias(o))
add("algebra_pattern_scan", lambda g: so(g.scan(EX + "inRegion")), f"SELECT s, o FROM T WHERE p = '{EX}inRegion'")
add("algebra_bgp_join", lambda g: so(g.scan(EX + "placedBy"), "order", "customer").join(so(g.scan(EX + "inNation"), "customer", "nation"), "customer"), f"SELECT a.s AS \"order\", a.o AS customer, b.o AS nation FROM T a JOIN T b ON a.o = b.s AND b.p = '{EX}inNation' WHERE a.p = '{EX}placedBy'")
add("algebra_self_join", lambda g: so(g.scan(EX + "inRegion"), "a", "r").join(so(g.scan(EX + "inRegion"), "b", "r"), "r").filter("a < b"), f"SELECT a.s AS a, b.s AS b, a.o AS r FROM T a JOIN T b ON a.o = b.o AND b.p = a.p AND a.s < b.s WHERE a.p = '{EX}inRegion'")
add("algebra_variable_predicate", lambda g: g.scan_of(g.scan(v.RANGE).filter(c("o") == v.XSD + "decimal").select(c("s").alias("p"))).groupBy("p").agg(F.count("*").alias("n")), f"SELECT p, count(*) AS n FROM T WHERE p IN (SELECT s FROM T WHERE p = '{v.RANGE}' AND o = '{v.XSD}decimal') GROUP BY p")
add("algebra_repeated_variable", lambda g: g.scan().filter("s = o and ok <> 2").select("s", "p"), "SELECT s, p FROM T WHERE s = o AND ok <> 2")
add("algebra_theta_join", lambda g: so(g.scan(v.LABEL).filter("lang = 'en'"), "s", "a").join(so(g.scan(v.LABEL).filter("lang is null"), "s", "b"), "s").filter("a >= b"), f"SELECT a.s, a.o AS a, b.o AS b FROM T a JOIN T b ON a.s = b.s AND b.p = a.p AND a.o >= b.o WHERE a.p = '{v.LABEL}' AND a.lang = 'en' AND b.lang IS NULL")
add("algebra_semi_join", lambda g: k.within(g.typed(EX + "Customer"), g.having(EX + "hasOrder"), "s"), f"SELECT s FROM {oracle.typed(EX + 'Customer')} WHERE s IN {oracle.having(EX + 'hasOrder')}")
add("algebra_anti_join", lambda g: k.without(g.typed(EX + "Part"), g.having(EX + "relatedPart"), "s"), f"SELECT s FROM {oracle.typed(EX + 'Part')} WHERE s NOT IN {oracle.having(EX + 'relatedPart')}")


def _exists_or(g: Graph) -> DataFrame:
    marks = lambda d, name: d.withColumn(name, lit(True))
    t = g.typed(EX + "Part").join(marks(g.having(EX + "relatedPart"), "a"), "s", "left").join(marks(g.having(EX + "selfRef"), "b"), "s", "left")
    return t.filter("(a is not null and b is null) or (a is null and b is not null)").select("s")


_r, _f = oracle.having(EX + "relatedPart"), oracle.having(EX + "selfRef")
add("algebra_exists_or", _exists_or, f"SELECT s FROM {oracle.typed(EX + 'Part')} WHERE (s IN {_r} AND s NOT IN {_f}) OR (s NOT IN {_r} AND s IN {_f})")
add("algebra_optional", lambda g: g.typed(EX + "Part").join(so(g.scan(EX + "relatedPart"), "s", "other"), "s", "left"), f"SELECT a.s, b.o AS other FROM {oracle.typed(EX + 'Part')} a LEFT JOIN T b ON a.s = b.s AND b.p = '{EX}relatedPart'")
add("algebra_minus", lambda g: build.minus(g.typed(EX + "Nation"), g.having(EX + "regionPeer")), f"SELECT s FROM {oracle.typed(EX + 'Nation')} WHERE s NOT IN {oracle.having(EX + 'regionPeer')}")


def _values(g: Graph) -> DataFrame:
    given = inline(g.spark, [(EX + "nation-1", "one"), (None, "any"), (EX + "nation-x", "none")], "s string, tag string")
    return build.compatible_join(so(g.scan(EX + "inRegion"), "s", "region"), given, ["s"])


def _values_two(g: Graph) -> DataFrame:
    """Inline rows with any of two variables unbound, against solutions of an OPTIONAL with one unbound."""
    given = inline(g.spark, [(EX + "part-50", None, "a"), (None, EX + "part-1000000100", "b"), (None, None, "c"), (EX + "part-1", EX + "part-2", "d")], "s string, other string, tag string")
    solutions = g.typed(EX + "Part").join(so(g.scan(EX + "relatedPart"), "s", "other"), "s", "left")
    return build.compatible_join(solutions, given, ["s", "other"])


add("algebra_values_undef", _values, f"SELECT t.s, t.o AS region, x.tag FROM T t JOIN (VALUES ('{EX}nation-1', 'one'), (NULL, 'any'), ('{EX}nation-x', 'none')) x(s, tag) ON x.s IS NULL OR x.s = t.s WHERE t.p = '{EX}inRegion'")
add("algebra_values_two", _values_two, f"SELECT a.s, coalesce(b.o, x.other) AS other, x.tag FROM {oracle.typed(EX + 'Part')} a LEFT JOIN T b ON a.s = b.s AND b.p = '{EX}relatedPart' JOIN (VALUES ('{EX}part-50', NULL, 'a'), (NULL, '{EX}part-1000000100', 'b'), (NULL, NULL, 'c'), ('{EX}part-1', '{EX}part-2', 'd')) x(s, other, tag) ON (x.s IS NULL OR x.s = a.s) AND (x.other IS NULL OR b.o IS NULL OR x.other = b.o)")
add("algebra_union", lambda g: g.scan(v.TYPE).filter(c("o").isin(v.OBJ_PROP)).select("s").unionByName(g.scan(v.TYPE).filter(c("o").isin(v.DATA_PROP)).select("s")), f"SELECT s FROM T WHERE p = {TY} AND o = '{v.OBJ_PROP}' UNION ALL SELECT s FROM T WHERE p = {TY} AND o = '{v.DATA_PROP}'")
add("algebra_except", lambda g: g.typed(EX + "Event_error").exceptAll(g.typed(EX + "Event_click")), f"SELECT s FROM {oracle.typed(EX + 'Event_error')} EXCEPT SELECT s FROM {oracle.typed(EX + 'Event_click')}")
add("algebra_intersect", lambda g: g.typed(EX + "Event_error").intersect(g.typed(EX + "Event_click")), f"SELECT s FROM {oracle.typed(EX + 'Event_error')} INTERSECT SELECT s FROM {oracle.typed(EX + 'Event_click')}")
add("algebra_distinct", lambda g: g.scan().select("p").distinct(), "SELECT DISTINCT p FROM T")
add("algebra_subselect", lambda g: g.scan(EX + "placedBy").groupBy(c("o").alias("s")).agg(F.count("*").alias("n")).join(so(g.scan(EX + "segment"), "s", "segment"), "s").groupBy("segment").agg(F.max("n").alias("most")), f"SELECT b.o AS segment, max(n) AS most FROM (SELECT o AS s, count(*) AS n FROM T WHERE p = '{EX}placedBy' GROUP BY o) a JOIN T b ON a.s = b.s AND b.p = '{EX}segment' GROUP BY b.o")
add("algebra_group_having", lambda g: g.scan(EX + "soldBy").groupBy("o").agg(F.count("*").alias("n")).filter("n > 50"), f"SELECT o, count(*) AS n FROM T WHERE p = '{EX}soldBy' GROUP BY o HAVING count(*) > 50")
add("algebra_global_agg", lambda g: g.scan().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(c("ok") == 1, 1).otherwise(0)), lit(0)).alias("blank")), "SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN ok = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS blank FROM T")
add("algebra_count_distinct", lambda g: g.scan(EX + "segment").agg(F.count_distinct("o").alias("n")), f"SELECT count(DISTINCT o) AS n FROM T WHERE p = '{EX}segment'")
add("algebra_group_concat", lambda g: so(g.scan(EX + "inRegion"), "nation", "region").groupBy("region").agg(F.array_join(F.array_sort(F.collect_set("nation")), "|").alias("nations")), f"SELECT o AS region, string_agg(DISTINCT s, '|' ORDER BY s) AS nations FROM T WHERE p = '{EX}inRegion' GROUP BY o")
_paid = lambda g: so(g.scan(EX + "accountBalance"), "s", "paid").join(so(g.scan(EX + "inNation"), "s", "nation"), "s").withColumn("paid", c("paid").cast("decimal(18,2)"))
# the mean in whole cents, rounded down: both engines agree
_mean = lambda: F.expr("CAST(floor(CAST(sum(paid) * 100 AS bigint) / CAST(count(paid) AS decimal(18,0))) AS bigint)")
# SAMPLE may be any value; ours is the least, so that runs agree
add("algebra_min_max_sample", lambda g: _paid(g).groupBy("nation").agg(F.min("paid").alias("lo"), F.max("paid").alias("hi"), _mean().alias("mean"), F.min("s").alias("sample"), F.count("*").alias("n")), f"SELECT b.o AS nation, min(x) AS lo, max(x) AS hi, (CAST(sum(x) * 100 AS BIGINT) + 100000000 * count(x)) // count(x) - 100000000 AS mean, min(a.s) AS sample, count(*) AS n FROM (SELECT s, CAST(o AS DECIMAL(18,2)) AS x FROM T WHERE p = '{EX}accountBalance') a JOIN T b ON a.s = b.s AND b.p = '{EX}inNation' GROUP BY b.o")
add("algebra_order_limit", lambda g: so(g.scan(EX + "brand")).orderBy("o", "s").offset(5).limit(20), f"SELECT s, o FROM T WHERE p = '{EX}brand' ORDER BY o, s LIMIT 20 OFFSET 5")


def _contains(g: Graph) -> DataFrame:
    """Containment edges: customer, nation, region, with the schema's planted cycle."""
    return paths.edges(g.scan(EX + "inNation", EX + "inRegion", v.SUBCLASS))


_edge = f"e AS (SELECT DISTINCT s AS x, o AS y FROM T WHERE p IN ('{EX}inNation', '{EX}inRegion', '{v.SUBCLASS}') AND ok <> 2), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)"
add("algebra_path_plus", lambda g: paths.closure(_contains(g)).select("x", "y"), "SELECT x, y FROM r", _edge)
add("algebra_path_star", lambda g: paths.reflexive(paths.closure(_contains(g)), _contains(g).select("x").union(_contains(g).select("y")).distinct()), "SELECT x, y FROM r UNION SELECT x, x FROM e UNION SELECT y, y FROM e", _edge)
add("algebra_path_alternative", lambda g: paths.alternative(paths.edges(g.scan(EX + "inNation")), paths.edges(g.scan(EX + "inRegion"))), f"SELECT s AS x, o AS y FROM T WHERE p IN ('{EX}inNation', '{EX}inRegion')")
add("algebra_path_inverse", lambda g: paths.inverse(paths.edges(g.scan(EX + "placedBy"))), f"SELECT o AS x, s AS y FROM T WHERE p = '{EX}placedBy'")
add("algebra_path_sequence", lambda g: paths.sequence(paths.edges(g.scan(EX + "inNation")), paths.edges(g.scan(EX + "inRegion"))), f"SELECT a.s AS x, b.o AS y FROM T a JOIN T b ON a.o = b.s AND b.p = '{EX}inRegion' WHERE a.p = '{EX}inNation'")
add("algebra_path_optional", lambda g: paths.optional(paths.edges(g.scan(EX + "regionPeer")), g.typed(EX + "Nation").select(c("s").alias("x"))), f"SELECT s AS x, o AS y FROM T WHERE p = '{EX}regionPeer' UNION SELECT s, s FROM {oracle.typed(EX + 'Nation')}")
add("algebra_path_negated", lambda g: paths.negated(g.scan(EX + "inNation", EX + "inRegion", EX + "regionPeer"), [EX + "inNation"]), f"SELECT s AS x, o AS y FROM T WHERE p IN ('{EX}inRegion', '{EX}regionPeer')")
add("algebra_describe", lambda g: build.describe(g.scan(), inline(g.spark, [(EX + "supplier-3",)], "s string")), f"SELECT DISTINCT * FROM T WHERE s = '{EX}supplier-3' OR s IN (SELECT o FROM T WHERE s = '{EX}supplier-3' AND ok = 1)")
add("algebra_ask", lambda g: build.ask(k.without(g.typed(EX + "Order"), g.having(EX + "placedBy"), "s")), f"SELECT count(*) > 0 AS answer FROM {oracle.typed(EX + 'Order')} WHERE s NOT IN {oracle.having(EX + 'placedBy')}")
add("competency_ask", lambda g: build.competency(k.without(g.typed(EX + "Order"), g.having(v.LABEL), "s"), expect=False), f"SELECT (count(*) > 0) = false AS passed FROM {oracle.typed(EX + 'Order')} WHERE s NOT IN {oracle.having(v.LABEL)}")
add("competency_min_rows", lambda g: build.competency(g.typed(EX + "Nation"), min_rows=20), f"SELECT count(*) >= 20 AS passed FROM {oracle.typed(EX + 'Nation')}")


def _construct(g: Graph) -> DataFrame:
    s = so(g.scan(EX + "placedBy"), "order", "customer").join(so(g.scan(EX + "orderDay"), "order", "day"), "order", "left")
    return build.construct(s, [(c("customer"), EX + "ordered", fn.iri(c("order"))), (c("order"), EX + "on", fn.strdt(c("day"), v.XSD + "date"))])


add("algebra_construct", _construct, f"SELECT o AS s, 0 AS sk, '{EX}ordered' AS p, s AS o, 0 AS ok, CAST(NULL AS VARCHAR) AS dt, CAST(NULL AS VARCHAR) AS lang FROM T WHERE p = '{EX}placedBy' UNION SELECT b.s, 0, '{EX}on', b.o, 2, '{v.XSD}date', NULL FROM T a JOIN T b ON a.s = b.s AND b.p = '{EX}orderDay' WHERE a.p = '{EX}placedBy'")


def _update(g: Graph) -> DataFrame:
    part = Graph(g.scan(EX + "inRegion", v.LABEL), distinct=True)
    gone = part.scan(v.LABEL).filter("lang is null")
    return repairs.update(part, gone, gone.withColumns({"dt": lit(v.RDF + "langString"), "lang": lit("en")}))


add("algebra_update", _update, f"SELECT s, sk, p, o, ok, CASE WHEN p = '{v.LABEL}' THEN '{v.RDF}langString' ELSE dt END AS dt, CASE WHEN p = '{v.LABEL}' AND lang IS NULL THEN 'en' ELSE lang END AS lang FROM T WHERE p IN ('{EX}inRegion', '{v.LABEL}') GROUP BY ALL")

# --- functions -----------------------------------------------------------------------------------------------------

#: Functions are applied to literals with and without a language, numbers, dates, IRIs and blank nodes.
_SAID = (v.LABEL, EX + "inNation", EX + "supplies", EX + "accountBalance", EX + "orderDay")
_number = lambda: F.expr("try_cast(o AS decimal(18,2))")
_part = lambda f: F.when(c("dt") == v.XSD + "date", f(F.expr("try_cast(o AS date)")))
_date = lambda f: f"CASE WHEN dt = '{v.XSD}date' THEN CAST({f}(try_cast(o AS DATE)) AS INTEGER) END"
_whole = lambda x: F.concat_ws("|", x["o"], x["ok"].cast("string"), F.coalesce(x["dt"], lit("-")), F.coalesce(x["lang"], lit("-")))
for _name, _col, _sql in (
    ("str", lambda: fn.str_(), "o"),
    ("concat", lambda: F.concat(c("o"), lit("@"), c("lang")), "CASE WHEN lang IS NULL THEN NULL ELSE o || '@' || lang END"),
    ("strstarts", lambda: c("o").startswith("C"), "starts_with(o, 'C')"),
    ("strends", lambda: c("o").endswith("1"), "ends_with(o, '1')"),
    ("regex", lambda: c("o").rlike("^[A-Z]+$"), "regexp_matches(o, '^[A-Z]+$')"),
    ("replace", lambda: F.regexp_replace("s", "^(.*[/#])[^/#]*$", "$1"), "regexp_replace(s, '^(.*[/#])[^/#]*$', '\\1')"),
    ("lcase", lambda: F.lower("o"), "lower(o)"),
    ("lang", lambda: fn.lang(), "CASE WHEN ok = 2 THEN coalesce(lang, '') END"),
    ("datatype", lambda: fn.datatype(), "CASE WHEN ok = 2 THEN dt END"),
    ("iskind", lambda: F.concat_ws("", fn.is_iri().cast("int"), fn.is_blank().cast("int"), fn.is_literal().cast("int")), "CASE ok WHEN 0 THEN '100' WHEN 1 THEN '010' ELSE '001' END"),
    ("bound", lambda: c("lang").isNotNull(), "lang IS NOT NULL"),
    ("if", lambda: F.when(c("lang") == "en", "yes").otherwise("no"), "CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' END"),
    ("in", lambda: c("lang").isin("en", "de"), "lang IN ('en', 'de')"),
    ("round", lambda: F.round(F.length("o").cast("decimal(18,3)") / 7, 1).cast("decimal(18,1)").cast("string"), "CAST(CAST(round(CAST(length(o) AS DECIMAL(18,3)) / 7, 1) AS DECIMAL(18,1)) AS VARCHAR)"),
    ("iri", lambda: _whole(fn.iri(c("o"))), "o || '|0|-|-'"),
    ("strdt", lambda: _whole(fn.strdt(c("o"), v.XSD + "token")), f"o || '|2|{v.XSD}token|-'"),
    ("strlang", lambda: _whole(fn.strlang(c("o"), "fr")), f"o || '|2|{v.RDF}langString|fr'"),
    ("ucase", lambda: F.upper("o"), "upper(o)"),
    ("strlen", lambda: F.char_length("o"), "CAST(length(o) AS INTEGER)"),
    ("substr", lambda: F.substring("o", 2, 3), "substr(o, 2, 3)"),
    ("contains", lambda: c("o").contains("er"), "contains(o, 'er')"),
    ("strbefore", lambda: F.when(c("o").contains("-"), F.substring_index("o", "-", 1)).otherwise(""), "CASE WHEN contains(o, '-') THEN split_part(o, '-', 1) ELSE '' END"),
    ("strafter", lambda: F.regexp_extract("o", "^[^-]*-(.*)$", 1), "regexp_extract(o, '^[^-]*-(.*)$', 1)"),
    ("coalesce", lambda: F.coalesce("lang", "dt", lit("none")), "coalesce(lang, dt, 'none')"),
    ("md5", lambda: F.md5(c("o").cast("binary")), "md5(o)"),
    ("sha256", lambda: F.sha2(c("o").cast("binary"), 256), "sha256(o)"),
    ("abs", lambda: F.abs(_number()), "abs(try_cast(o AS DECIMAL(18,2)))"),
    ("ceil", lambda: F.ceil(_number()).cast("long"), "CAST(ceil(try_cast(o AS DECIMAL(18,2))) AS BIGINT)"),
    ("floor", lambda: F.floor(_number()).cast("long"), "CAST(floor(try_cast(o AS DECIMAL(18,2))) AS BIGINT)"),
    ("year", lambda: _part(F.year), _date("year")),
    ("month", lambda: _part(F.month), _date("month")),
    ("day", lambda: _part(F.dayofmonth), _date("day")),
    ("term_key", lambda: F.replace(term_key(), lit("\u0000"), lit("|")), "concat_ws('|', ok, o, coalesce(dt, ''), coalesce(lang, ''))"),
    ("encode_for_uri", lambda: fn.encode_for_uri(F.concat(c("o"), lit(" *~é/"))), "url_encode(o || ' *~é/')"),
    ("shrink", lambda: fn.shrink(c("s"), {"ex": EX, "e": "http://example.org/"}), f"CASE WHEN starts_with(s, '{EX}') AND length(s) > {len(EX)} THEN 'ex:' || substr(s, {len(EX) + 1}) WHEN starts_with(s, 'http://example.org/') THEN 'e:' || substr(s, 20) ELSE s END"),
    ("local_name", lambda: fn.local_name(c("s")), "regexp_replace(s, '^.*[#/]', '')"),
):
    add(f"fn_{_name}", lambda g, col=_col: g.scan(*_SAID).select("s", c("o").alias("said"), col().alias("result")), f"SELECT s, o AS said, {_sql} AS result FROM T WHERE p IN ({', '.join(map(repr, _SAID))})")

# --- passes --------------------------------------------------------------------------------------------------------


def _quads(g: TableGraph) -> DataFrame:
    """The whole graph with positions, for the order-dependent term model: the schema as written, then the tables' triples,
    which have no order of their own, by subject and term."""
    places = [(k_, *r[:3]) for k_, r in enumerate(rdfview.ontology())]  # a fixed few hundred, in the program
    at = inline(g.spark, [(*x[1:], x[0]) for x in places], "s string, p string, o string, seq long").groupBy("s", "p", "o").agg(F.min("seq").alias("seq"))
    schema = g.schema.join(F.broadcast(at), ["s", "p", "o"])
    # blank nodes are no terms; they have subjects of their own, so the others' places are the same without them
    rest = g.distinct().filter("sk = 0").join(F.broadcast(g.schema.select("s").distinct()), "s", "left_anti")
    place = F.row_number().over(Window.partitionBy("s").orderBy("p", "o", "ok", "dt", "lang")) + len(places)
    return schema.select("seq", *TRIPLE).unionByName(rest.withColumn("seq", place.cast("long")).select("seq", *TRIPLE))


def _terms(g: TableGraph, strict: bool = True) -> DataFrame:
    m = passes.term_model(_quads(g), strict_order=strict)
    return m.select("iri", "label", *(F.array_join(x, "|").alias(x) for x in ("kinds", "domain", "range", "sub_class_of", "inverse_of")), "has_own_structure")


_seq = ", ".join(f"({k_}, {row})" for k_, row in enumerate(f"'{r[0]}', '{r[1]}', '{r[2].replace(chr(39), chr(39) * 2)}'" for r in rdfview.ontology()))
_ordered = f"""sq AS (SELECT s, p, o, min(seq) AS seq FROM (VALUES {_seq}) x(seq, s, p, o) GROUP BY s, p, o),
qs AS (SELECT DISTINCT T.*, CASE WHEN sq.seq IS NOT NULL THEN sq.seq END AS seq FROM T JOIN sq USING (s, p, o) UNION ALL SELECT *, {len(rdfview.ontology())} + row_number() OVER (PARTITION BY s ORDER BY p NULLS FIRST, o NULLS FIRST, ok NULLS FIRST, dt NULLS FIRST, lang NULLS FIRST) FROM (SELECT DISTINCT * FROM T WHERE s NOT IN (SELECT s FROM sq))),
q1 AS (SELECT *, min(seq) FILTER (p = {TY}) OVER (PARTITION BY s) AS first FROM qs WHERE sk = 0)"""
_kind_sql = f"CASE WHEN p = {TY} AND o <> '{v.ONTOLOGY}' THEN CASE " + " ".join(f"WHEN o = '{k_}' THEN '{n_}'" for k_, n_ in passes.KINDS.items()) + " ELSE 'individual' END END"
_plain = ", ".join(map(repr, (v.TYPE, v.LABEL, v.PREF_LABEL, v.COMMENT, v.DEFINITION, v.DOMAIN, v.RANGE, v.INVERSE, v.SEE_ALSO, v.DEFINED_BY, v.VERSION_INFO)))
_said = lambda p: f"coalesce(string_agg(o, '|' ORDER BY o) FILTER (p = '{p}' AND ok = 0), '')"


def _terms_sql(strict: bool) -> str:
    return f"""SELECT s AS iri, coalesce(arg_max(o, seq) FILTER (p = '{v.LABEL}'), arg_max(o, seq) FILTER (p = '{v.PREF_LABEL}')) AS label, coalesce(string_agg({_kind_sql}, '|' ORDER BY {_kind_sql}), '') AS kinds,
{_said(v.DOMAIN)} AS domain, {_said(v.RANGE)} AS range, {_said(v.SUBCLASS)} AS sub_class_of, {_said(v.INVERSE)} AS inverse_of,
coalesce(bool_or((p IN ('{v.SUBCLASS}', '{v.EQUIV_CLASS}') AND ok = 1) OR p NOT IN ({_plain}, '{v.SUBCLASS}', '{v.SUBPROP}', '{v.EQUIV_CLASS}')), false) AS has_own_structure FROM q1 WHERE first IS NOT NULL {f"AND (p = {TY} OR seq > first)" if strict else ""} GROUP BY s"""


add("term_model", _terms, _terms_sql(True), _ordered)
add("term_model_unordered", lambda g: _terms(g, False), _terms_sql(False), _ordered)
_named_types = f"k AS (SELECT DISTINCT s, CASE o WHEN '{v.CLASS}' THEN 'c' WHEN '{v.OBJ_PROP}' THEN 'o' WHEN '{v.DATA_PROP}' THEN 'd' WHEN '{v.ANN_PROP}' THEN 'a' WHEN '{v.ONTOLOGY}' THEN '-' ELSE 'i' END AS k FROM T WHERE p = {TY} AND sk = 0 AND ok = 0)"
_longest = f"e AS (SELECT DISTINCT s AS x, o AS y FROM T WHERE p = '{v.SUBCLASS}' AND sk = 0 AND ok = 0 AND s <> o), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), a AS (SELECT x, y FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.x = e.y AND r.y = e.x)), d AS (SELECT x, y, CAST(1 AS BIGINT) AS n FROM a UNION SELECT d.x, a.y, d.n + 1 FROM d JOIN a ON d.y = a.x)"
_metrics_sql = f"""SELECT *, round(CASE WHEN classes > 0 THEN edges / classes ELSE 0 END, 2) AS inheritance, round(CASE WHEN object_properties + edges > 0 THEN object_properties / (object_properties + edges) ELSE 0 END, 2) AS relationship, round(CASE WHEN classes > 0 THEN datatype_properties / classes ELSE 0 END, 2) AS attribute
FROM (SELECT count(*) FILTER (k = 'c') AS classes, count(*) FILTER (k = 'o') AS object_properties, count(*) FILTER (k = 'd') AS datatype_properties, count(*) FILTER (k = 'a') AS annotation_properties, count(*) FILTER (k = 'i') AS individuals,
count(*) FILTER (k = 'c' AND s NOT IN {oracle.having(v.LABEL, v.PREF_LABEL)}) AS missing_label, count(*) FILTER (k = 'c' AND s NOT IN {oracle.having(v.COMMENT, v.DEFINITION)}) AS missing_definition,
(SELECT count(*) FROM T WHERE p = '{v.SUBCLASS}' AND ok = 0) AS edges, (SELECT count(*) FROM T) AS axioms, (SELECT coalesce(max(n), 0) FROM d) AS max_depth FROM k)"""
add("metrics", passes.metrics, _metrics_sql, f"{_named_types}, {_longest}")
add("metrics_counts", lambda g: passes.metrics(g).select("classes", "object_properties", "datatype_properties", "missing_label", "edges", "axioms"), f"SELECT classes, object_properties, datatype_properties, missing_label, edges, axioms FROM ({_metrics_sql})", f"{_named_types}, {_longest}")
_o = lambda *names: f"coalesce(bool_or(p IN ({', '.join(repr(v.OWL + n) for n in names)})), false)"
_t = lambda *names: f"coalesce(bool_or(p = {TY} AND ok = 0 AND o IN ({', '.join(repr(v.OWL + n) for n in names)})), false)"
_constructs = f"""x AS (SELECT {_o("unionOf", "complementOf")} AS class_operations, {_o("someValuesFrom")} AS existential, {_o("allValuesFrom")} AS universal, {_o("minCardinality", "maxCardinality", "cardinality")} AS cardinality, {_o("qualifiedCardinality", "minQualifiedCardinality", "maxQualifiedCardinality")} AS qualified, {_o("oneOf", "hasValue")} AS nominals, {_o("inverseOf")} AS inverse,
coalesce(bool_or(p = '{v.SUBPROP}'), false) AS role_hierarchy, {_t("TransitiveProperty")} AS transitive, ({_o("propertyChainAxiom")} OR {_t("ReflexiveProperty", "IrreflexiveProperty", "AsymmetricProperty")}) AS complex_roles, {_t("FunctionalProperty", "InverseFunctionalProperty")} AS functional, coalesce(bool_or(p = '{v.RANGE}' AND ok = 0 AND starts_with(o, '{v.XSD}')), false) AS datatypes FROM T),
y AS (SELECT *, (CASE WHEN class_operations OR existential AND universal THEN CASE WHEN transitive THEN 'S' ELSE 'ALC' END WHEN transitive THEN 'AL+' ELSE 'AL' END) || (CASE WHEN role_hierarchy THEN 'H' ELSE '' END) || (CASE WHEN nominals THEN 'O' ELSE '' END) || (CASE WHEN inverse THEN 'I' ELSE '' END) || (CASE WHEN qualified THEN 'Q' WHEN cardinality THEN 'N' ELSE '' END) || (CASE WHEN complex_roles THEN 'R' WHEN functional THEN 'F' ELSE '' END) || (CASE WHEN datatypes THEN '(D)' ELSE '' END) AS logic,
NOT (class_operations OR universal OR cardinality OR qualified OR inverse OR functional) AS el, NOT (class_operations OR cardinality OR qualified OR transitive OR existential AND universal) AS ql, NOT (class_operations OR cardinality OR qualified) AS rl FROM x)"""
add("expressivity", passes.expressivity, "SELECT * FROM y", _constructs)
add("profiles", lambda g: passes.expressivity(g).select("logic", "el", "ql", "rl"), "SELECT logic, el, ql, rl FROM y", _constructs)
_broken = {"class_operations": "class_operations", "universal": "universal", "counting": "cardinality OR qualified", "inverse": "inverse", "functional": "functional", "transitive": "transitive", "existential and universal": "existential AND universal"}
add("profile_violations", passes.profile_violations, " UNION ALL ".join(f"SELECT '{k_}' AS profile, '{f_}' AS construct FROM x WHERE {_broken[f_]}" for k_, fs_ in passes.PROFILES.items() for f_ in fs_), _constructs)
add("max_depth", passes.max_depth, "SELECT coalesce(max(n), 0) AS max_depth FROM d", _longest)
_tree = f"k AS (SELECT DISTINCT s FROM {oracle.typed(v.CLASS)}), up AS (SELECT DISTINCT s AS x, o AS y FROM T WHERE p = '{v.SUBCLASS}' AND s <> o AND s IN (SELECT s FROM k) AND o IN (SELECT s FROM k))"
add("hierarchy_children", lambda g: passes.hierarchy(g).filter("parent is not null"), "SELECT y AS parent, string_agg(x, '|' ORDER BY x) AS children FROM up GROUP BY y", _tree)
add("hierarchy_roots", lambda g: passes.hierarchy(g).filter("parent is null").select("children"), "SELECT string_agg(s, '|' ORDER BY s) AS children FROM k WHERE s NOT IN (SELECT x FROM up)", _tree)
add("neighbourhood", lambda g: passes.neighbourhood(Graph(g.scan(EX + "inRegion", EX + "inNation", EX + "regionPeer"), distinct=True), inline(g.spark, [(EX + "region-1",)], "node string"), 2), "SELECT node, min(hops) AS hops FROM b GROUP BY node", f"l AS (SELECT s AS x, o AS y FROM T WHERE p IN ('{EX}inRegion', '{EX}inNation', '{EX}regionPeer') UNION SELECT o, s FROM T WHERE p IN ('{EX}inRegion', '{EX}inNation', '{EX}regionPeer')), b AS (SELECT '{EX}region-1' AS node, 0 AS hops UNION SELECT y, hops + 1 FROM b JOIN l ON node = x WHERE hops < 2)")
add("undeclared_terms", lambda g: passes.undeclared_terms(g.scan().select("p", "o", "ok"), g), f"SELECT DISTINCT term, use FROM (SELECT o AS term, 'class' AS use FROM T WHERE p = {TY} AND ok = 0 UNION SELECT p, 'property' FROM T WHERE p <> {TY}) WHERE NOT starts_with(term, '{v.W3C}') AND term NOT IN {oracle.typed()}")


def _prefixes(g: Graph) -> DataFrame:
    a = inline(g.spark, [("ex", EX), ("e", "http://example.org/"), ("x", "http://x/"), ("y", "http://y/")], "prefix string, ns string")
    b = inline(g.spark, [("ex", EX), ("e", "http://example.org/other/"), ("z", "http://x/")], "prefix string, ns string")
    return passes.prefix_alignment(a, b)


add("prefix_alignment", _prefixes, """SELECT * FROM (SELECT a.prefix, a.ns, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.prefix = a.prefix AND b.ns = a.ns) THEN NULL WHEN EXISTS (SELECT 1 FROM b WHERE b.prefix = a.prefix) THEN 'namespace_mismatch' WHEN EXISTS (SELECT 1 FROM b WHERE b.ns = a.ns) THEN 'prefix_name_mismatch' ELSE 'undeclared_namespace' END AS problem FROM a) WHERE problem IS NOT NULL""", f"a AS (SELECT * FROM (VALUES ('ex', '{EX}'), ('e', 'http://example.org/'), ('x', 'http://x/'), ('y', 'http://y/')) x(prefix, ns)), b AS (SELECT * FROM (VALUES ('ex', '{EX}'), ('e', 'http://example.org/other/'), ('z', 'http://x/')) x(prefix, ns))")


def _imports(g: Graph) -> DataFrame:
    """Nations as documents that import their successor, by customers' nations."""
    pairs = paths.sequence(paths.inverse(paths.edges(g.scan(EX + "inRegion"))), paths.edges(g.scan(EX + "regionPeer")))
    imports = pairs.select(c("x").alias("doc"), c("y").alias("iri"))
    return passes.import_closure(inline(g.spark, [(EX + "region-0",)], "doc string"), imports.union(so(g.scan(EX + "regionPeer"), "doc", "iri")), g.scan(v.TYPE).select(c("s").alias("iri"), c("s").alias("doc")).distinct())


add("import_closure", _imports, "SELECT doc, min(hops) AS hops FROM b GROUP BY doc", f"i AS (SELECT a.o AS x, b.o AS y FROM T a JOIN T b ON a.s = b.s AND b.p = '{EX}regionPeer' WHERE a.p = '{EX}inRegion' UNION SELECT s, o FROM T WHERE p = '{EX}regionPeer'), b AS (SELECT '{EX}region-0' AS doc, 0 AS hops UNION SELECT y, hops + 1 FROM b JOIN i ON doc = x WHERE hops < 30)")

# --- reasoner, repairs, triplify -------------------------------------------------------------------------------------


# all rules over all triples; rea_disjoint is the part of it that asserted types and subclasses give
_closed = f"""sp AS (SELECT s AS p, o AS q FROM T WHERE p IN ('{v.SUBPROP}', '{v.EQUIV_PROP}') AND ok <> 2 UNION SELECT o, s FROM T WHERE p = '{v.EQUIV_PROP}' AND ok <> 2),
spc AS (SELECT p, q FROM sp UNION SELECT spc.p, sp.q FROM spc JOIN sp ON spc.q = sp.p), f AS (SELECT s, p, o, ok FROM T UNION SELECT T.s, spc.q, T.o, T.ok FROM T JOIN spc ON T.p = spc.p),
sc AS (SELECT s AS x, o AS y FROM f WHERE p IN ('{v.SUBCLASS}', '{v.EQUIV_CLASS}') AND ok <> 2 UNION SELECT o, s FROM f WHERE p = '{v.EQUIV_CLASS}' AND ok <> 2),
sa AS (SELECT s AS x, o AS y FROM f WHERE p = '{v.SAME}' AND ok <> 2 UNION SELECT o, s FROM f WHERE p = '{v.SAME}' AND ok <> 2), up AS (SELECT 'c' AS k, x, y FROM sc UNION ALL SELECT 'i', x, y FROM sa),
m0 AS (SELECT s AS i, o AS t FROM f WHERE p = {TY} AND ok <> 2 UNION SELECT f.s, d.o FROM f JOIN f d ON d.p = '{v.DOMAIN}' AND d.s = f.p UNION SELECT f.o, d.o FROM f JOIN f d ON d.p = '{v.RANGE}' AND d.s = f.p WHERE f.ok <> 2),
m AS (SELECT i, t FROM m0 UNION SELECT CASE WHEN k = 'i' THEN y ELSE i END, CASE WHEN k = 'c' THEN y ELSE t END FROM m JOIN up ON x = CASE WHEN k = 'c' THEN t ELSE i END)"""
_kind_of = lambda x: f"CASE WHEN starts_with({x}, '_:') THEN 1 ELSE 0 END"
_derived = lambda s, p, o: f"SELECT {s}, {_kind_of(s)}, {p}, {o}, {_kind_of(o)}, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)"
_closure_sql = f"""{_closed}, ct AS (SELECT s AS x, o AS y FROM f WHERE p = '{v.SUBCLASS}' AND ok <> 2 UNION SELECT ct.x, f.o FROM ct JOIN f ON f.s = ct.y AND f.p = '{v.SUBCLASS}' AND f.ok <> 2),
pt AS (SELECT s AS x, o AS y FROM f WHERE p = '{v.SUBPROP}' AND ok <> 2 UNION SELECT pt.x, f.o FROM pt JOIN f ON f.s = pt.y AND f.p = '{v.SUBPROP}' AND f.ok <> 2),
it AS (SELECT x, y FROM sa UNION SELECT it.x, sa.y FROM it JOIN sa ON it.y = sa.x),
A(s, sk, p, o, ok, dt, lang) AS (SELECT s, sk, p, o, ok, dt, lang FROM T UNION SELECT T.s, T.sk, spc.q, T.o, T.ok, T.dt, T.lang FROM T JOIN spc ON T.p = spc.p
UNION {_derived("x", f"'{v.SUBCLASS}'", "y")} FROM ct UNION {_derived("x", f"'{v.SUBPROP}'", "y")} FROM pt UNION {_derived("x", f"'{v.SAME}'", "y")} FROM it UNION {_derived("i", TY, "t")} FROM m UNION {_derived("o", "p", "s")} FROM f WHERE p IN ('{v.EQUIV_CLASS}', '{v.EQUIV_PROP}') AND ok <> 2)"""
add("rdfs_closure", lambda g: reasoner.reason(g).counts(), "SELECT p, count(*) AS n, min(s) AS least, max(o) AS most FROM A GROUP BY p", _closure_sql)
add("rdfs_closure_types", lambda g: reasoner.reason(g).scan(v.TYPE).groupBy(c("o").alias("class")).agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("s").alias("most")), f"SELECT o AS class, count(*) AS n, min(s) AS least, max(s) AS most FROM A WHERE p = {TY} GROUP BY o", _closure_sql)
add("rdfs_closure_schema", lambda g: reasoner.reason(g).scan(v.SUBCLASS, v.SUBPROP, v.EQUIV_CLASS, v.EQUIV_PROP, v.SAME).select("s", "p", "o"), f"SELECT s, p, o FROM A WHERE p IN ('{v.SUBCLASS}', '{v.SUBPROP}', '{v.EQUIV_CLASS}', '{v.EQUIV_PROP}', '{v.SAME}')", _closure_sql)
add("inferred_only", reasoner.inferred_counts, "SELECT p, count(*) AS n FROM (SELECT * FROM A EXCEPT SELECT s, sk, p, o, ok, dt, lang FROM T) GROUP BY p", _closure_sql)
add("same_classes", lambda g: reasoner.reason(Graph(g.scan(v.SAME), distinct=True)).members.select("node", "rep"), "SELECT x AS node, min(y) AS rep FROM it GROUP BY x", _closure_sql)
add("rea_disjoint_closure", reasoner.disjoint_types, f"SELECT DISTINCT a.i AS focus_node, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS value FROM m a JOIN m b ON a.i = b.i JOIN f d ON d.p = '{v.DISJOINT}' AND d.s = a.t AND d.o = b.t", _closed)
add("rea_disjoint", lambda g: reasoner.disjoint_members(reasoner.reason(Graph(g.scan(v.TYPE, v.SUBCLASS, v.DISJOINT), distinct=True))), f"SELECT DISTINCT a.i AS focus_node, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS value FROM m a JOIN m b ON a.i = b.i JOIN T d ON d.p = '{v.DISJOINT}' AND d.s = a.t AND d.o = b.t", f"m AS (SELECT s AS i, o AS t FROM T WHERE p = {TY} UNION SELECT m.i, T.o FROM m JOIN T ON T.p = '{v.SUBCLASS}' AND T.s = m.t)")
add("rea_samediff", lambda g: reasoner.same_and_different(reasoner.reason(Graph(g.scan(v.SAME, v.DIFFERENT), distinct=True))), f"SELECT DISTINCT a.s AS focus_node, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS value FROM T a JOIN T b ON b.p = '{v.SAME}' AND ((a.s = b.s AND a.o = b.o) OR (a.s = b.o AND a.o = b.s)) WHERE a.p = '{v.DIFFERENT}'")


def repaired(g: Graph, id: str, settings: dict[str, str] | None = None) -> DataFrame:
    """The changes that a check's repair makes."""
    check = {"PRJ-REQUIRED": lambda x: passes.required(x, [(v.CLASS, [v.LABEL])])}.get(id) or k.CHECKS[id].run
    added, removed = repairs.changes(g, id, check(g), settings)
    return added.withColumn("change", lit("added")).unionByName(removed.withColumn("change", lit("removed")))


def repair_sql(id: str, alternative: bool = False) -> tuple[str, str]:
    """The changes of a repair as SQL: its body, and the CTEs of findings, insertions and deletions."""
    said = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '^.*[#/]', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'))"
    iri = lambda s, p, o, where="fnd": f"SELECT {s} AS s, 0 AS sk, {p} AS p, {o} AS o, 0 AS ok, CAST(NULL AS VARCHAR) AS dt, CAST(NULL AS VARCHAR) AS lang FROM {where}"
    text = lambda s, p, o, lang, where="fnd": f"SELECT {s} AS s, 0 AS sk, {p} AS p, {o} AS o, 2 AS ok, '{v.RDF + 'langString' if lang else v.XSD + 'string'}' AS dt, {f"'{lang}'" if lang else 'CAST(NULL AS VARCHAR)'} AS lang FROM {where}"
    named = lambda x: f"fnd WHERE {x} IS NOT NULL AND NOT starts_with({x}, '_:')"
    q = lambda x: f"'{x}'"
    gone = lambda p: f"SELECT T.s, T.sk, T.p, T.o, T.ok, T.dt, T.lang FROM T JOIN fnd ON T.s = focus_node AND T.o = value WHERE T.p = '{p}' AND T.ok = 0"
    nothing = "SELECT s, sk, p, o, ok, dt, lang FROM T WHERE false"
    inserts, deletes = {i: iri("value", q(v.TYPE), q(v.CLASS), named("value")) for i in ("STR-001", "STR-005", "STR-008")}, {}
    inserts |= {
        "STR-002": iri("path", q(v.TYPE), q(v.RDF_PROP), named("path")),
        "STR-007": iri("focus_node", q(v.TYPE), q(v.RDF_PROP), named("focus_node")),
        "QUA-001": text("focus_node", q(v.LABEL), said.format("focus_node"), "en", named("focus_node")),
        "QUA-004": text("focus_node", q(v.PREF_LABEL), said.format("focus_node"), "en", named("focus_node")),
        "PRJ-REQUIRED": text("focus_node", "path", said.format("focus_node"), "en", named("focus_node")),
        "QUA-002": text("focus_node", q(v.VERSION_INFO), "'1.0.0'", None, named("focus_node")),
        "QUA-005": iri("'http://example.org/ontology'", q(v.TYPE), q(v.ONTOLOGY)),
        "QUA-007": iri("focus_node", q(v.VERSION_IRI), "focus_node || '/1.0.0'", named("focus_node")),
        "MDL-002": iri("s", q(v.CLOSE_MATCH if alternative else v.SUBCLASS), "o", "del"),
        "MDL-003": iri("s", q(v.TYPE), q(v.SKOS + "Concept"), "del"),
        "STY-003": text("s", q(v.LABEL), "o", "en", "del"),
    }
    deletes = {
        "LOG-003": gone(v.EQUIV_CLASS if alternative else v.SUBCLASS),
        "MDL-001": gone(v.INVERSE),
        "MDL-002": gone(v.EQUIV_CLASS),
        "MDL-003": f"SELECT s, sk, p, o, ok, dt, lang FROM T WHERE p = {TY} AND o = '{v.CLASS}' AND s IN (SELECT focus_node FROM fnd)",
        "STY-003": f"SELECT s, sk, p, o, ok, dt, lang FROM T WHERE p = '{v.LABEL}' AND ok = 2 AND coalesce(lang, '') = '' AND s IN (SELECT focus_node FROM fnd)",
    }
    more, body = ("", f"SELECT s AS focus_node, '{v.LABEL}' AS path, '{v.CLASS}' AS value FROM {oracle.typed(v.CLASS)} WHERE s NOT IN {oracle.having(v.LABEL)}") if id == "PRJ-REQUIRED" else oracle.BODIES[id]
    ctes = [more, f"fnd AS (SELECT DISTINCT focus_node, CAST(path AS VARCHAR) AS path, coalesce(CAST(value AS VARCHAR), focus_node) AS value FROM ({body}))", f"del AS (SELECT DISTINCT * FROM ({deletes.get(id, nothing)}))", f"ins AS (SELECT DISTINCT * FROM ({inserts.get(id, nothing)}))"]
    same = "x.s = y.s AND x.p = y.p AND x.o = y.o AND x.ok = y.ok AND x.dt IS NOT DISTINCT FROM y.dt AND x.lang IS NOT DISTINCT FROM y.lang"
    return f"SELECT *, 'added' AS change FROM ins x WHERE NOT EXISTS (SELECT 1 FROM T y WHERE {same}) UNION ALL SELECT *, 'removed' AS change FROM del x WHERE NOT EXISTS (SELECT 1 FROM ins y WHERE {same})", ", ".join(c_ for c_ in ctes if c_)


for _id in repairs.templates():
    add("repair_" + _id.lower().replace("-", "_"), lambda g, id=_id: repaired(g, id), *repair_sql(_id))
# the other templates of two repairs
for _id, _setting in (("LOG-003", {"equivalence": "keepSubClassOf"}), ("MDL-002", {"mdl_002": "closeMatch"})):
    add("repair_" + _id.lower().replace("-", "_") + "_other", lambda g, id=_id, x=_setting: repaired(g, id, x), *repair_sql(_id, True))


def _headless_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-005's repair where no ontology is declared: over the tables without the schema's ontologies."""
    return repaired(TableGraph(spark, sf_dir, [t for t in rdfview.ontology() if t[2] != v.ONTOLOGY]), "QUA-005")


QUERIES["repair_qua_005_headless"] = _headless_repair
ORACLE["repair_qua_005_headless"] = f"WITH {sql_view()} SELECT 'http://example.org/ontology' AS s, 0 AS sk, {TY} AS p, '{v.ONTOLOGY}' AS o, 0 AS ok, CAST(NULL AS VARCHAR) AS dt, CAST(NULL AS VARCHAR) AS lang, 'added' AS change FROM T WHERE p = {TY} AND o = '{v.ONTOLOGY}' AND NOT starts_with(s, 'http') HAVING count(*) = 0"
PREFIXES = {"ex": EX, "e": "http://example.org/", "rdfs": v.RDFS, "rdf": v.RDF, "owl": v.OWL, "skos": v.SKOS}


def _preview(g: Graph) -> DataFrame:
    """What all repairs would change, eight lines of each side."""
    g = stored(g)
    whole = union([repaired(g, id).withColumn("check_id", lit(id)) for id in repairs.templates()])
    return repairs.preview(whole, PREFIXES)


_shrunk = lambda x: "CASE " + " ".join(f"WHEN starts_with({x}, '{ns}') AND length({x}) > {len(ns)} THEN '{p}:' || substr({x}, {len(ns) + 1})" for p, ns in sorted(PREFIXES.items(), key=lambda i: -len(i[1]))) + f" ELSE {x} END"
_spoken = f"CASE WHEN ok = 2 THEN '\"' || o || '\"' || coalesce('@' || lang, '') ELSE {_shrunk('o')} END"
_changed = " UNION ALL ".join(f"SELECT *, '{id}' AS check_id FROM (WITH {repair_sql(id)[1]} {repair_sql(id)[0]})" for id in repairs.templates())
add(
    "repair_preview",
    _preview,
    """SELECT check_id, side, CAST(place AS INTEGER) AS place, line FROM ranked WHERE place <= 8 UNION ALL
SELECT check_id, 'rest', 9, 'and ' || CAST(sum(greatest(n - 8, 0)) AS BIGINT) || ' more' FROM (SELECT check_id, side, count(*) AS n FROM ranked GROUP BY ALL) GROUP BY check_id HAVING sum(greatest(n - 8, 0)) > 0""",
    f"changed AS ({_changed}), ranked AS (SELECT *, row_number() OVER (PARTITION BY check_id, side ORDER BY line) AS place FROM (SELECT check_id, change AS side, CASE WHEN change = 'added' THEN '+ ' ELSE '- ' END || {_shrunk('s')} || ' ' || {_shrunk('p')} || ' ' || {_spoken} AS line FROM changed))",
)


def _triplify(g: TableGraph) -> DataFrame:
    orders = g.spark.read.parquet(f"{g.dir}/orders.parquet")
    row = F.concat(lit(EX + "o-"), fn.encode_for_uri(c("o_orderkey").cast("string")))
    day = fn.strdt(F.date_format("o_orderdate", "yyyy-MM-dd"), v.XSD + "date")
    return build.construct(orders, [(row, v.TYPE, fn.iri(lit(EX + "Order"))), (row, EX + "day", day), (row, EX + "priority", fn.iri(F.concat(lit(EX + "priority-"), fn.encode_for_uri(c("o_orderpriority"))))), (row, v.LABEL, fn.strlang(c("o_orderstatus"), "en"))])


_nul = "CAST(NULL AS VARCHAR)"
add("triplify_orders", _triplify, f"""SELECT '{EX}o-' || o_orderkey AS s, 0 AS sk, {TY} AS p, '{EX}Order' AS o, 0 AS ok, {_nul} AS dt, {_nul} AS lang FROM orders UNION SELECT '{EX}o-' || o_orderkey, 0, '{EX}day', strftime(o_orderdate, '%Y-%m-%d'), 2, '{v.XSD}date', NULL FROM orders
UNION SELECT '{EX}o-' || o_orderkey, 0, '{EX}priority', '{EX}priority-' || url_encode(o_orderpriority), 0, NULL, NULL FROM orders UNION SELECT '{EX}o-' || o_orderkey, 0, '{v.LABEL}', o_orderstatus, 2, '{v.RDF}langString', 'en' FROM orders""")


def _profile(g: TableGraph) -> DataFrame:
    return triplify.profile(g.spark.read.parquet(f"{g.dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", c("p_size").cast("string").alias("p_size")))


_cells = " UNION ALL ".join(f"SELECT '{x}' AS \"column\", CAST({x} AS VARCHAR) AS cell FROM part" for x in ("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
_is = " ".join(f"WHEN bool_and(regexp_matches(cell, '{p}')) THEN '{n}'" for n, p in triplify._KINDS)
add("csv_profile", _profile, f"""SELECT "column", CASE WHEN count(DISTINCT cell) <= 12 AND count(DISTINCT cell) < count(*) AND count(*) > 1 THEN 'enum' {_is} ELSE 'string' END AS kind, count(*) AS filled, count(DISTINCT cell) AS different, regexp_matches("column", '{triplify.KEY_HEADERS[0]}') OR regexp_matches("column", '{triplify.KEY_HEADERS[1]}') OR (count(DISTINCT cell) = count(*) AND count(*) > 1) AS may_be_key,
array_to_string(list_sort(list_distinct(list(cell)))[1:12], '|') AS samples FROM cells WHERE cell <> '' GROUP BY "column\"""", f"cells AS ({_cells})")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.run_checks(stored(TableGraph(spark, sf_dir)), rules=RULES)
