"""Declarative repairs (2.8): DELETE and INSERT templates over findings, for one finding or all of a check at once.

A repair's result is the graph without the deletions and with the insertions, as a set; a missing target is a no-op."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions.terms import shrink
from ..model import TRIPLE, TRIPLE_SCHEMA, Graph, inline
from ..storage import Scratch

c, lit = F.col, F.lit
DEFAULTS = {"language": "en", "version": "1.0.0", "category_class": v.SKOS + "Concept", "ontology": "http://example.org/ontology", "equivalence": "keepEquivalentClass", "mdl_002": "subClassOf"}


def _humanised(iri):
    """A label from a local name: words split at case changes and separators."""
    local = F.regexp_replace(iri, "^.*[#/]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(local, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))


def _iri(s, p, o) -> list:
    return [s.alias("s"), lit(0).alias("sk"), p.alias("p"), o.alias("o"), lit(0).alias("ok"), lit(None).cast("string").alias("dt"), lit(None).cast("string").alias("lang")]


def _text(s, p, o, lang: str | None) -> list:
    return [s.alias("s"), lit(0).alias("sk"), p.alias("p"), o.alias("o"), lit(2).alias("ok"), lit(v.RDF + "langString" if lang else v.XSD + "string").alias("dt"), lit(lang).cast("string").alias("lang")]


def _same():
    """A triple equals an underscored one."""
    return (c("s") == c("_s")) & (c("p") == c("_p")) & (c("o") == c("_o")) & (c("ok") == c("_ok")) & c("dt").eqNullSafe(c("_dt")) & c("lang").eqNullSafe(c("_lang"))


def _underscored(t: DataFrame) -> DataFrame:
    return t.select(*(c(x).alias(f"_{x}") for x in TRIPLE)).distinct()


def update(g: Graph, deletes: DataFrame | None, inserts: DataFrame | None) -> DataFrame:
    """DELETE and INSERT of triples."""
    out = g.scan().select(*TRIPLE).distinct()
    if deletes is not None:
        out = out.join(_underscored(deletes), _same(), "left_anti")
    if inserts is not None:
        out = out.unionByName(inserts.select(*TRIPLE)).distinct()
    return out


def _existing(g: Graph, found: DataFrame, p: str, value: bool = True) -> DataFrame:
    """Triples of predicate p at the findings' focus nodes, with their values if asked."""
    t = g.scan(p)
    keys = found.select(c("focus_node").alias("_f"), c("value").alias("_v")).distinct()
    on = (c("s") == c("_f")) & ((c("o") == c("_v")) if value else lit(True))
    return t.join(keys, on, "left_semi").filter("ok = 0" if value else "true").select(*TRIPLE)


def templates(settings: dict[str, str] | None = None) -> dict[str, Callable[[Graph, DataFrame], tuple[DataFrame | None, DataFrame | None]]]:
    """check id: (graph, findings) -> (deletes, inserts)"""
    d = DEFAULTS | (settings or {})
    f, val, path = (lambda n=n: c(n) for n in ("focus_node", "value", "path"))
    named = lambda x, col: x.filter(~c(col).startswith("_:") & c(col).isNotNull())

    def replaced(g, found, old, new):
        gone = _existing(g, found, old)
        return gone, gone.select(*_iri(c("s"), lit(new), c("o")))

    def tagged(g, found):
        gone = _existing(g, found, v.LABEL, value=False).filter("ok = 2 and coalesce(lang, '') = ''")
        return gone, gone.select(*_text(c("s"), lit(v.LABEL), c("o"), d["language"]))

    def recategorised(g, found):
        gone = g.scan(v.TYPE).filter(c("o") == v.CLASS).join(found.select(f().alias("_f")).distinct(), c("s") == c("_f"), "left_semi").select(*TRIPLE)
        return gone, gone.select(*_iri(c("s"), lit(v.TYPE), lit(d["category_class"])))

    out = {i: (lambda g, x: (None, named(x, "value").select(*_iri(val(), lit(v.TYPE), lit(v.CLASS))))) for i in ("STR-001", "STR-005", "STR-008")}
    out |= {
        "STR-002": lambda g, x: (None, named(x, "path").select(*_iri(path(), lit(v.TYPE), lit(v.RDF_PROP)))),
        "STR-007": lambda g, x: (None, named(x, "focus_node").select(*_iri(f(), lit(v.TYPE), lit(v.RDF_PROP)))),
        "QUA-001": lambda g, x: (None, named(x, "focus_node").select(*_text(f(), lit(v.LABEL), _humanised(f()), d["language"]))),
        "QUA-004": lambda g, x: (None, named(x, "focus_node").select(*_text(f(), lit(v.PREF_LABEL), _humanised(f()), d["language"]))),
        "PRJ-REQUIRED": lambda g, x: (None, named(x, "focus_node").filter(path().isin(v.LABEL, v.PREF_LABEL)).select(*_text(f(), path(), _humanised(f()), d["language"]))),
        "QUA-002": lambda g, x: (None, named(x, "focus_node").select(*_text(f(), lit(v.VERSION_INFO), lit(d["version"]), None))),
        "QUA-005": lambda g, x: (None, x.select(*_iri(lit(d["ontology"]), lit(v.TYPE), lit(v.ONTOLOGY)))),
        "QUA-007": lambda g, x: (None, named(x, "focus_node").select(*_iri(f(), lit(v.VERSION_IRI), F.concat(f(), lit("/"), lit(d["version"]))))),
        "LOG-003": lambda g, x: (_existing(g, x, v.SUBCLASS if d["equivalence"] == "keepEquivalentClass" else v.EQUIV_CLASS), None),
        "MDL-001": lambda g, x: (_existing(g, x, v.INVERSE), None),
        "MDL-002": lambda g, x: replaced(g, x, v.EQUIV_CLASS, v.SUBCLASS if d["mdl_002"] == "subClassOf" else v.CLOSE_MATCH),
        "MDL-003": recategorised,
        "STY-003": tagged,
    }
    return out


def changes(g: Graph, check_id: str, found: DataFrame, settings: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """added and removed triples.  The findings are worked out once, and what a template makes of them is compared with
    the triples of its own predicates only, by key."""
    tables = Scratch(g.spark)
    deletes, inserts = templates(settings)[check_id](g, tables.put(found, "findings"))
    none = inline(g.spark, [], TRIPLE_SCHEMA)
    gone, new = (none if x is None else tables.put(x.select(*TRIPLE).distinct(), "changes") for x in (deletes, inserts))
    before = g.scan_of(new.select("p")).select(*TRIPLE).join(new.select("s").distinct(), "s", "left_semi") if inserts is not None else none
    added = new.join(_underscored(before), _same(), "left_anti")
    # what a template deletes comes from the graph itself
    removed = gone.join(_underscored(new), _same(), "left_anti") if deletes is not None else none
    return added, removed


def repair(g: Graph, check_id: str, found: DataFrame, settings: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """added, removed and resulting triples."""
    added, removed = changes(g, check_id, found, settings)
    return added, removed, update(g, removed, added)


def preview(changed: DataFrame, prefixes: dict[str, str], first: int = 8) -> DataFrame:
    """side, place, line: the first removed and added triples of each key, as text, and a line with the number of the rest
    (F49).  changed: a triple, change (added or removed) and any other columns, which are the key.

    Ranks are limited before the shuffle, so a task sends ``first`` rows of a side at most."""
    key = [n for n in changed.columns if n not in (*TRIPLE, "change")]
    said = F.when(c("ok") == 2, F.concat(lit('"'), c("o"), lit('"'), F.coalesce(F.concat(lit("@"), c("lang")), lit("")))).otherwise(shrink(c("o"), prefixes))
    text = F.concat_ws(" ", F.when(c("change") == "added", "+").otherwise("-"), shrink(c("s"), prefixes), shrink(c("p"), prefixes), said)
    lines = changed.select(*key, c("change").alias("side"), text.alias("line"))
    counts = lines.groupBy(*key, "side").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*key, "side").orderBy("line"))
    shown = lines.withColumn("place", place).filter(c("place") <= first).select(*key, "side", "place", "line")
    rest = counts.groupBy(*key).agg(F.sum(F.greatest(c("n") - first, lit(0))).alias("rest")).filter("rest > 0")
    return shown.unionByName(rest.select(*key, lit("rest").alias("side"), lit(first + 1).alias("place"), F.concat(lit("and "), c("rest").cast("string"), lit(" more")).alias("line")))
