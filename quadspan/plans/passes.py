"""Analysis passes over a graph (2.6): literal typing, guidance, vocabulary, project rules, term model, metrics,
expressivity, hierarchy, neighbourhood, prefixes, imports, and the merge of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..model import FINDING, Graph, small, union
from ..operators.closure import edges
from ..operators.contract import longest, reach
from ..storage import cut
from .checks import CHECKS, Check, findings, lacking, register_check, rows, within, without
from .nodes import CLASSED, has, named, nodes

c, lit = F.col, F.lit


# --- F2 literal value space ------------------------------------------------------------------------------------


def literal_typing(g: Graph) -> DataFrame:
    """Well-formed literals whose value doesn't exist: dates off the calendar, times out of range, months, days.
    24:00:00 and :60 pass; malformed forms are the lexical check's.  s, p, o, dt, each once."""
    o = c("o")
    year, month, day = (F.regexp_extract(o, "^-?(\\d{4,})-(\\d{2})-(\\d{2})", k).cast("int") for k in (1, 2, 3))
    days = F.when(month == 2, F.when(((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    off = ~month.between(1, 12) | (day < 1) | (day > days)
    date = o.rlike("^-?\\d{4,}-\\d{2}-\\d{2}(Z|[+-]\\d{2}:\\d{2})?$") & off
    hour, minute, second = (F.regexp_extract(o, "T(\\d{2}):(\\d{2}):(\\d{2})", k).cast("int") for k in (1, 2, 3))
    stamp = o.rlike("^-?\\d{4,}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})?$") & (off | (hour > 24) | (minute > 59) | (second > 60))
    of_month = o.rlike("^--\\d{2}(Z|[+-]\\d{2}:\\d{2})?$") & ~F.regexp_extract(o, "^--(\\d{2})", 1).cast("int").between(1, 12)
    of_day = o.rlike("^---\\d{2}(Z|[+-]\\d{2}:\\d{2})?$") & ~F.regexp_extract(o, "^---(\\d{2})", 1).cast("int").between(1, 31)
    bad = F.when(c("dt") == v.XSD + "date", date).when(c("dt") == v.XSD + "dateTime", stamp).when(c("dt") == v.XSD + "gMonth", of_month).when(c("dt") == v.XSD + "gDay", of_day).otherwise(False)
    return g.scan().filter(c("ok") == 2).filter(c("dt").isin(*(v.XSD + n for n in ("date", "dateTime", "gMonth", "gDay")))).filter(bad).select("s", "p", "o", "dt").distinct()


def literal_findings(g: Graph) -> DataFrame:
    return rows(literal_typing(g), "s", "p", "o")


# --- F1 term model ---------------------------------------------------------------------------------------------

KINDS = {v.CLASS: "class", v.RDFS_CLASS: "class", v.OBJ_PROP: "objectProperty", v.DATA_PROP: "datatypeProperty", v.ANN_PROP: "annotationProperty", v.RDF_PROP: "property"}


def term_model(quads: DataFrame, strict_order: bool = True) -> DataFrame:
    """One row for each named, typed subject.  With strict_order only properties behind its first type triple (by seq)
    count; labels are the last ones said."""
    q = quads.filter("sk = 0")
    first = F.min(F.when(c("p") == v.TYPE, c("seq"))).over(Window.partitionBy("s"))
    q = q.withColumn("_first", first).filter("_first is not null")
    if strict_order:
        q = q.filter((c("p") == v.TYPE) | (c("seq") > c("_first")))
    kind = F.when(c("p") == v.TYPE, F.when(c("o") == v.ONTOLOGY, F.lit(None)).otherwise(F.coalesce(F.create_map(*[x for k, n in KINDS.items() for x in (lit(k), lit(n))])[c("o")], lit("individual"))))
    last = lambda p: F.max_by(F.when(c("p") == p, c("o")), F.when(c("p") == p, c("seq")))
    named = lambda p: F.array_sort(F.collect_list(F.when((c("p") == p) & (c("ok") == 0), c("o"))))
    plain = [v.TYPE, v.LABEL, v.PREF_LABEL, v.COMMENT, v.DEFINITION, v.DOMAIN, v.RANGE, v.INVERSE, v.SEE_ALSO, v.DEFINED_BY, v.VERSION_INFO]
    own = (c("p").isin(v.SUBCLASS, v.EQUIV_CLASS) & (c("ok") == 1)) | ~c("p").isin(*plain, v.SUBCLASS, v.SUBPROP, v.EQUIV_CLASS)
    return q.groupBy(c("s").alias("iri")).agg(
        F.array_sort(F.collect_list(kind)).alias("kinds"), F.coalesce(last(v.LABEL), last(v.PREF_LABEL)).alias("label"), last(v.COMMENT).alias("comment"), last(v.DEFINITION).alias("definition"), named(v.DOMAIN).alias("domain"), named(v.RANGE).alias("range"), named(v.SUBCLASS).alias("sub_class_of"),
        named(v.SUBPROP).alias("sub_property_of"), named(v.EQUIV_CLASS).alias("equivalent_class"), named(v.INVERSE).alias("inverse_of"), F.coalesce(F.bool_or(own), lit(False)).alias("has_own_structure"),
    )


# --- F5-F7 guidance, F8 vocabulary, F9 project rules -------------------------------------------------------------


def mdl_001(g: Graph) -> DataFrame:
    said = g.scan(v.INVERSE).filter("sk = 0 and ok = 0").select("s", "o")
    return rows(within(said, g.typed(v.OBJ_PROP, v.DATA_PROP), "s"), "s", None, "o")


def mdl_002(g: Graph) -> DataFrame:
    said = g.scan(v.EQUIV_CLASS).filter("sk = 0 and ok = 0").select("s", "o")
    return rows(within(said, g.typed(v.CLASS), "s"), "s", None, "o")


def mdl_003(g: Graph) -> DataFrame:
    """Classes that say nothing of themselves: no named superclass and no structure."""
    classes = g.typed(v.CLASS).filter("not startswith(s, '_:')")
    plain = [v.TYPE, v.LABEL, v.PREF_LABEL, v.COMMENT, v.DEFINITION, v.SEE_ALSO, v.DEFINED_BY, v.VERSION_INFO]
    said = g.scan().filter(~c("p").isin(plain) & ~((c("p") == v.EQUIV_CLASS) & (c("ok") == 0)))
    return rows(lacking(classes, said.select("s"), "s"), "s")


# Predicates whose objects are terms.
TERM_PREDICATES = [
    v.TYPE,
    v.SUBCLASS,
    v.SUBPROP,
    v.DOMAIN,
    v.RANGE,
    v.EQUIV_CLASS,
    v.DISJOINT,
    v.INVERSE,
    v.OWL + "onProperty",
    v.OWL + "onClass",
    v.OWL + "someValuesFrom",
    v.OWL + "allValuesFrom",
    v.SH + "targetClass",
    v.SH + "class",
    v.SH + "path",
]


def voc_001(g: Graph) -> DataFrame:
    """Terms that named subjects use and nothing declares, in a namespace of some declared term: all typed named subjects
    are declared.  The few undeclared terms are found first, then their uses."""
    ns = lambda x: F.when(c(x).rlike("[#/]"), F.regexp_replace(x, "[^#/]*$", "")).otherwise(c(x))
    of_predicates = g.scan().filter("sk = 0").filter(c("p") != v.TYPE).select("s", "p", c("p").alias("t"))
    of_objects = g.scan(*TERM_PREDICATES).filter("sk = 0 and ok = 0").select("s", "p", c("o").alias("t"))
    declared = nodes(g).filter(named() & has(CLASSED)).select(c("node").alias("s"))
    terms = of_predicates.select("t").distinct().union(of_objects.select("t").distinct()).distinct()
    near = terms.withColumn("ns", ns("t")).join(small(declared.select(ns("s").alias("ns")).distinct()), "ns", "left_semi")
    open_ = cut(lacking(near, declared, "t").select("t"))
    used = g.scan_of(open_.select(c("t").alias("p"))).filter("sk = 0").filter(c("p") != v.TYPE).select("s", "p", c("p").alias("t"))
    return rows(used.unionByName(of_objects.join(small(open_), "t", "left_semi").select("s", "p", "t")), "s", "p", "t")


def required(g: Graph, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """PRJ-REQUIRED: instances of a class that lack a predicate.  rules: (class, predicates), a parameter."""
    out = []
    for cls, predicates in rules:
        for p in predicates:
            out.append(rows(without(g.typed(cls), g.having(p), "s"), "s", lit(p), lit(cls)))
    return union(out)


for _check in (
    Check("MDL-001", "Hint", "A property names its inverse", "State one direction only", mdl_001),
    Check("MDL-002", "Hint", "A class names an equivalent class", "Use subclass or close match", mdl_002),
    Check("MDL-003", "Hint", "A class says nothing of itself", "Add a superclass or an axiom", mdl_003),
    Check("VOC-001", "Warning", "An undeclared term of a declared vocabulary", "Declare it, or correct its spelling", voc_001),
):
    register_check(_check)

#: Checks whose findings are each given once.
BUILT_IN = frozenset(CHECKS)

# --- F4 merge ----------------------------------------------------------------------------------------------------

RANKS = {"sparql": 0, "literal": 1, "shacl": 2, "reasoning": 3, "guidance": 4, "vocabulary": 5, "rules": 6}


def merge(found: DataFrame) -> DataFrame:
    """One row for each (check, focus, path, value); the first engine's wording, all sources."""
    rank = F.create_map(*[x for k, n in RANKS.items() for x in (lit(k), lit(n))])[F.array_min("sources")]
    key = [F.coalesce(k, lit("")).alias(f"_{k}") for k in ("check_id", "focus_node", "path", "value")]
    said = [n for n in FINDING if n != "sources"]
    best = F.min_by(F.struct(*said), F.struct(F.coalesce(rank, lit(9)), "message")).alias("m")
    out = found.groupBy(*key).agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return out.select("m.*", "sources")


def ordered(found: DataFrame) -> DataFrame:
    """Findings as reports list them."""
    return found.orderBy(F.when(c("severity") == "Violation", 0).when(c("severity") == "Warning", 1).otherwise(2), "category", "check_id", "focus_node", "path", "value")


def run_checks(g: Graph, only: list[str] | None = None, literal: bool = True, rules: list[tuple[str, list[str]]] | None = None, isolate: bool = False) -> DataFrame:
    """All checks, merged.  The findings of each family of checks are written on their own, so no plan holds them all.
    With isolate each check runs by itself and one that fails is left out.  Findings of a check with one engine are each
    there once already, and aren't merged."""
    families: dict[tuple[str, bool], list[DataFrame]] = {}
    for id, check in CHECKS.items():
        if only is not None and id not in only:
            continue
        source = {"MDL": "guidance", "VOC": "vocabulary"}.get(id[:3], "sparql")
        try:
            one = findings(check, check.run(g), source)
            families.setdefault((id[:3], id in BUILT_IN and not (literal and id == "DAT-001")), []).append(cut(one) if isolate else one)
        except Exception:
            if not isolate:
                raise
    if literal and (only is None or "DAT-001" in only):
        families.setdefault(("DAT", False), []).append(findings(CHECKS["DAT-001"], literal_findings(g), "literal"))
    if rules:
        required_check = Check("PRJ-REQUIRED", "Violation", "A required property is missing", "Add it", lambda g: None)
        families.setdefault(("PRJ", False), []).append(findings(required_check, required(g, rules), "rules"))
    written = [(alone, cut(union(frames))) for (_, alone), frames in families.items()]
    again, once = ([found for alone, found in written if alone == kind] for kind in (False, True))
    return union([*([merge(union(again))] if again else []), *(found.select(*FINDING) for found in once)])


# --- F11-F17 metrics, expressivity, hierarchy ---------------------------------------------------------------------


def max_depth(g: Graph) -> DataFrame:
    """The longest chain of subclass edges over named classes, cycles left out (edges within one are ignored)."""
    depth = longest(edges(g.scan(v.SUBCLASS).filter("sk = 0 and ok = 0")))
    return g.spark.range(1).select(lit(depth).cast("long").alias("max_depth"))


def metrics(g: Graph) -> DataFrame:
    """Counts and ratios of the schema (axioms: all triples; individuals: named subjects with a type that is no kind of
    term), one row."""
    term = {v.CLASS: "c", v.OBJ_PROP: "o", v.DATA_PROP: "d", v.ANN_PROP: "a", v.ONTOLOGY: "-"}
    kind = F.coalesce(F.create_map(*(lit(x) for pair in term.items() for x in pair))[c("o")], lit("i"))
    kinds = g.scan(v.TYPE).filter("sk = 0 and ok = 0").select("s", kind.alias("k")).distinct()
    counts = kinds.agg(*(F.count_if(c("k") == k).alias(n) for k, n in (("c", "classes"), ("o", "object_properties"), ("d", "datatype_properties"), ("a", "annotation_properties"), ("i", "individuals"))))
    classes = kinds.filter("k = 'c'").select("s")
    bare = without(classes, g.having(v.LABEL, v.PREF_LABEL), "s").agg(F.count("*").alias("missing_label"))
    blunt = without(classes, g.having(v.COMMENT, v.DEFINITION), "s").agg(F.count("*").alias("missing_definition"))
    sub = g.scan(v.SUBCLASS).filter("ok = 0").agg(F.count("*").alias("edges"))
    axioms = g.scan().agg(F.count("*").alias("axioms"))
    out = counts.crossJoin(bare).crossJoin(blunt).crossJoin(sub).crossJoin(axioms).crossJoin(max_depth(g))  # one row each
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 2)
    return out.withColumns({"inheritance": ratio(c("edges"), c("classes")), "relationship": ratio(c("object_properties"), c("object_properties") + c("edges")), "attribute": ratio(c("datatype_properties"), c("classes"))})


#: Columns of the metrics with their titles in reports.
METRIC_TITLES = {
    "classes": "Classes",
    "object_properties": "Object properties",
    "datatype_properties": "Datatype properties",
    "annotation_properties": "Annotation properties",
    "individuals": "Individuals",
    "axioms": "Triples",
    "edges": "Subclass edges",
    "max_depth": "Deepest class",
    "missing_label": "Classes without a label",
    "missing_definition": "Classes without a definition",
}


def expressivity(g: Graph) -> DataFrame:
    """Which constructs occur, the name of the logic, and membership in the profiles: one pass."""
    some = lambda x: F.coalesce(F.bool_or(x), lit(False))
    p = lambda *names: some(c("p").isin(*(v.OWL + n for n in names)))
    t = lambda *names: some((c("p") == v.TYPE) & (c("ok") == 0) & c("o").isin(*(v.OWL + n for n in names)))
    f = g.scan().agg(
        p("unionOf", "complementOf").alias("class_operations"),
        p("someValuesFrom").alias("existential"),
        p("allValuesFrom").alias("universal"),
        p("minCardinality", "maxCardinality", "cardinality").alias("cardinality"),
        p("qualifiedCardinality", "minQualifiedCardinality", "maxQualifiedCardinality").alias("qualified"),
        p("oneOf", "hasValue").alias("nominals"),
        p("inverseOf").alias("inverse"),
        some(c("p") == v.SUBPROP).alias("role_hierarchy"),
        t("TransitiveProperty").alias("transitive"),
        (p("propertyChainAxiom") | t("ReflexiveProperty", "IrreflexiveProperty", "AsymmetricProperty")).alias("complex_roles"),
        t("FunctionalProperty", "InverseFunctionalProperty").alias("functional"),
        some((c("p") == v.RANGE) & (c("ok") == 0) & c("o").startswith(v.XSD)).alias("datatypes"),
    )
    full = c("class_operations") | (c("existential") & c("universal"))
    letter = lambda flag, x: F.when(c(flag), x).otherwise("")
    base = F.when(full & c("transitive"), "S").when(full, "ALC").when(c("transitive"), "AL+").otherwise("AL")
    count = F.when(c("qualified"), "Q").when(c("cardinality"), "N").otherwise("")
    roles = F.when(c("complex_roles"), "R").when(c("functional"), "F").otherwise("")
    name = F.concat(base, letter("role_hierarchy", "H"), letter("nominals", "O"), letter("inverse", "I"), count, roles, letter("datatypes", "(D)"))
    breaks = {k: [F.expr(PROFILE_RULES.get(f, f)) for f in fs] for k, fs in PROFILES.items()}
    return f.withColumn("logic", name).withColumns({k: ~reduce(lambda a, b: a | b, fs) for k, fs in breaks.items()})


#: Constructs that take an ontology out of a profile.
PROFILE_RULES = {"counting": "cardinality or qualified", "existential and universal": "existential and universal"}
PROFILES = {
    "el": ["class_operations", "universal", "counting", "inverse", "functional"],
    "ql": ["class_operations", "counting", "transitive", "existential and universal"],
    "rl": ["class_operations", "counting"],
}


def profile_violations(g: Graph) -> DataFrame:
    """profile, construct: what takes the ontology out of each profile."""
    found = [F.when(F.expr(PROFILE_RULES.get(f, f)), F.struct(lit(k).alias("profile"), lit(f).alias("construct"))) for k, fs in PROFILES.items() for f in fs]
    return expressivity(g).select(F.explode(F.array(*found)).alias("x")).filter("x is not null").select("x.*")


def hierarchy(g: Graph, kind: str = v.CLASS, link: str = v.SUBCLASS) -> DataFrame:
    """parent, children (sorted); parent is null for the roots."""
    terms = g.typed(kind).filter("not startswith(s, '_:')")
    up = within(within(edges(g.scan(link)).filter("x <> y"), terms, "x"), terms, "y").distinct()
    roots = without(terms, up.select("x"), "s").select(lit(None).cast("string").alias("parent"), c("s").alias("child"))
    return roots.unionByName(up.select(c("y").alias("parent"), c("x").alias("child"))).groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("child")), "|").alias("children"))


def hierarchy_rows(g: Graph, kind: str = v.CLASS, link: str = v.SUBCLASS) -> DataFrame:
    """parent, child, place: each named term of a kind below its parents of that kind, in the order of labels; parent is
    null for the roots."""
    terms = g.typed(kind).filter("not startswith(s, '_:')")
    up = within(within(edges(g.scan(link)).filter("x <> y"), terms, "x"), terms, "y").distinct()
    named = within(g.scan(v.LABEL), terms, "s").groupBy("s").agg(F.max("o").alias("name"))
    out = terms.join(up.withColumnRenamed("x", "s"), "s", "left").join(named, "s", "left").select(c("y").alias("parent"), c("s").alias("child"), F.coalesce("name", "s").alias("name"))
    return out.select("parent", "child", F.row_number().over(Window.partitionBy("parent").orderBy("name", "child")).alias("place"))


def neighbourhood(g: Graph, seeds: DataFrame, depth: int = 3, hidden: tuple[str, ...] = (v.TYPE, v.LABEL, v.COMMENT, v.DEFINED_BY)) -> DataFrame:
    """node, hops: nodes within ``depth`` links (either way) of the seeds (column node)."""
    e = edges(g.scan().filter(~c("p").isin(*hidden)))
    e = cut(e.unionByName(e.select(c("y").alias("x"), c("x").alias("y"))).distinct())
    known = cut(seeds.select("node", lit(0).alias("hops")).distinct())
    front = known
    for k in range(1, depth + 1):
        near = front.join(e, c("node") == c("x")).select(c("y").alias("node")).distinct()
        front = cut(near.join(known, "node", "left_anti").select("node", lit(k).alias("hops")))
        known = known.unionByName(front)
    return known


# --- F10, F28, F29 imports and prefixes ----------------------------------------------------------------------------


def import_closure(entry: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    """doc, hops: documents that the entries (column doc) import, step by step.  imports: doc, iri; names: iri, doc,
    an ontology's own or version IRI.  Unmatched IRIs have no row: see ``unresolved``."""
    step = imports.join(names.select("iri", c("doc").alias("to")), "iri").select(c("doc").alias("x"), c("to").alias("y")).distinct()
    found = reach(step, entry.select(c("doc").alias("x"))).select(c("y").alias("doc"), c("hops").cast("int").alias("hops"))
    return entry.select("doc", lit(0).alias("hops")).unionByName(found).groupBy("doc").agg(F.min("hops").alias("hops"))


def unresolved(imports: DataFrame, names: DataFrame) -> DataFrame:
    return imports.join(names.select("iri"), "iri", "left_anti").select("iri").distinct()


def prefix_alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """prefix, ns, problem: how a query's prefixes (prefix, ns) differ from an ontology's."""
    skip = [v.RDF, v.RDFS, v.OWL, v.XSD, "http://www.w3.org/XML/1998/namespace"]
    a, b = a.filter(~c("ns").isin(skip)), b.filter(~c("ns").isin(skip))
    by_name, by_ns = b.select("prefix", c("ns").alias("other")), b.select("ns", c("prefix").alias("named"))
    j = a.join(by_name, "prefix", "left").join(by_ns, "ns", "left")
    problem = F.when(c("other").isNotNull() & (c("other") != c("ns")), "namespace_mismatch").when(c("named").isNull(), "undeclared_namespace").when(c("named") != c("prefix"), "prefix_name_mismatch")
    return j.select("prefix", "ns", problem.alias("problem")).filter("problem is not null").distinct()


def undeclared_terms(used: DataFrame, g: Graph) -> DataFrame:
    """p, o of a query's template that the ontology doesn't declare: term, use (class or property)."""
    terms = used.filter((c("p") == v.TYPE) & (c("ok") == 0)).select(c("o").alias("term"), lit("class").alias("use")).union(used.filter(c("p") != v.TYPE).select("p", lit("property")))
    return without(terms.distinct(), g.typed(), "term").filter(~c("term").startswith(v.W3C))
