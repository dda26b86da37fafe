"""The 41 graph checks (2.4), each a plan over a graph that gives focus_node, path, value.

Most are anti joins on single columns.  Patterns with constant predicates go through ``Graph.scan``, so a graph over
tables or stored by predicate reads only those.  Messages and remediations are our own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..model import FEW, PUSHED, Graph, inline, small, union
from ..operators.closure import edges, reflexive
from ..storage import Scratch
from .nodes import BOUND, LABELLED, OF_SEE, OF_TYPE, OF_VERSION, OTHER, SUBJECT, TYPED, USED, has, meeting, named, nodes

c, lit = F.col, F.lit
#: Bits of a word of flags, and triples of one predicate and object that aren't dealt by it.
WORD, HOT = 62, 100_000


def null() -> Column:
    return lit(None).cast("string")


def rows(df: DataFrame, focus: Column | str, path: Column | str | None = None, value: Column | str | None = None) -> DataFrame:
    """Findings: a missing value is the focus node."""
    as_col = lambda x: x if isinstance(x, Column) else c(x)
    focus = as_col(focus)
    return df.select(focus.alias("focus_node"), (null() if path is None else as_col(path)).alias("path"), (focus if value is None else as_col(value)).alias("value")).distinct()


def joined(*parts: Column) -> Column:
    """Several values of one slot: sorted, distinct, with commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.array(*parts))), ", ")


def without(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """NOT EXISTS: rows whose column isn't among the keys (first column)."""
    k = keys.select(c(keys.columns[0]).alias("_k")).distinct()
    return df.join(k, df[column] == k["_k"], "left_anti")


def within(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """EXISTS"""
    k = keys.select(c(keys.columns[0]).alias("_k")).distinct()
    return df.join(k, df[column] == k["_k"], "left_semi")


def lacking(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """NOT EXISTS for a vocabulary's rows: the keys are met with the rows' few values where they are scanned."""
    k = keys.columns[0]
    return without(df, keys.join(small(df.select(c(column).alias(k)).distinct()), k, "left_semi"), column)


def external(column: str) -> Column:
    return c(column).startswith(v.W3C)


def local(column: str) -> Column:
    return F.regexp_replace(column, "^.*[#/]", "")


def _includes(g: Graph, kind: str, name: str) -> DataFrame:
    """p, d: the declared domains or ranges of properties, by rdfs or by a predicate that ends so."""
    declared = g.scan(kind).filter("ok <> 2").select(c("s").alias("p"), c("o").alias("d"))
    named_so = None if g.names() is None else [p for p in g.names() if p.endswith(name)]
    if named_so == []:
        return declared.distinct()
    others = g.scan() if named_so is None else g.scan(*named_so)
    return declared.unionByName(others.filter(c("p").endswith(name)).select(c("s").alias("p"), c("o").alias("d"))).distinct()


def _up(g: Graph, types: DataFrame) -> DataFrame:
    """x, y: zero or more subclass steps from each of the types (column x)."""
    return reflexive(g.closed(v.SUBCLASS), types)


def _judged(g: Graph, sides: str) -> tuple[DataFrame, list[str]] | None:
    """node, and for each side (d: as a subject, by domains; r: as an object, by ranges) the predicates, as bits of words
    d0.. and r0.., that a typed node has there though none of its types may; also the names of the bits.  None where the
    predicates are many.

    A property is a bit, so a node is one row: what is said of it, what points to it, and what its types allow.  A stored
    graph serves several plans, so both sides are worked out at once."""
    sides = "dr" if g.near is not None else sides
    known = g.__dict__.setdefault("_judged", {})
    if sides not in known:
        tables = Scratch(g.spark)
        ends = [_includes(g, *{"d": (v.DOMAIN, "domainIncludes"), "r": (v.RANGE, "rangeIncludes")}[side]).withColumn("side", lit(side)) for side in sides]
        ends = tables.put(union(ends), "ends")
        pairs = [tuple(r) for r in ends.select("side", "p").distinct().limit(2 * PUSHED + 1).collect()]
        names = sorted({p for _, p in pairs})
        known[sides] = ((_unfit(g, sides, ends, pairs, names) if names else ends), names) if len(names) <= PUSHED else None
    return known[sides]


def _unfit(g: Graph, sides: str, ends: DataFrame, pairs: list[tuple], names: list[str]) -> DataFrame:
    tables, words, none = Scratch(g.spark), range(-(-len(names) // WORD)), lit(0).cast("long")
    at = lambda p, w: 1 << names.index(p) % WORD if names.index(p) // WORD == w else 0
    cells = [(x, w) for x in sides for w in words]
    numbered = inline(g.spark, [(p, *(at(p, w) if (x, p) in pairs else 0 for x, w in cells), *(at(p, w) for w in words)) for p in names], ", ".join(["p string", *(f"{x}{w} long" for x, w in cells), *(f"b{w} long" for w in words)]))
    up = _up(g, g.scan(v.TYPE).filter("ok <> 2").select(c("o").alias("x")).distinct())
    allowed = ends.join(up, c("d") == c("y")).select("side", "p", "x").distinct().join(F.broadcast(numbered.select("p", *(f"b{w}" for w in words))), "p")
    # (class, property) pairs are schema-sized
    fits = tables.put(allowed.groupBy(c("x").alias("_x")).agg(*(F.coalesce(F.bit_or(F.when(c("side") == x, c(f"b{w}"))), none).alias(f"{x}m{w}") for x, w in cells)), "fits")
    typed = (c("p") == v.TYPE) & (c("ok") != 2)
    t = (g.near or g).scan(*{v.TYPE, *names}).select("s", "p", "o", "ok").join(F.broadcast(numbered.drop(*(f"b{w}" for w in words))), "p", "left").join(small(fits), typed & (c("o") == c("_x")), "left")
    has = lambda side, of: [(F.coalesce(c(f"{x}{w}"), none) if x == side else none).alias(f"{x}{w}") for x, w in cells] + [(F.coalesce(c(f"{x}m{w}"), none) if of else none).alias(f"{x}m{w}") for x, w in cells]
    own = F.struct(c("s").alias("node"), F.when(typed, 1).otherwise(0).alias("typed"), *has("d", True))
    subject = own if "d" in sides else F.when(typed, own)
    objects = [F.when((c("ok") == 0) & c("p").isin(*(p for x, p in pairs if x == "r")), F.struct(c("o").alias("node"), lit(0).alias("typed"), *has("r", False)))] if "r" in sides else []
    said = t.select(F.explode(F.array(subject, *objects)).alias("x")).filter("x is not null")
    columns = [f"{x}{m}{w}" for m in ("", "m") for x, w in cells]
    found = said.groupBy("x.node").agg(F.max("x.typed").alias("typed"), *(F.bit_or(f"x.{n}").alias(n) for n in columns)).filter("typed = 1")
    left = [c(f"{x}{w}").bitwiseAND(F.bitwise_not(f"{x}m{w}")).alias(f"{x}{w}") for x, w in cells]
    return tables.put(found.select("node", *left).filter(" or ".join(f"{x}{w} <> 0" for x, w in cells)), "judged")


def _broken(judged: DataFrame, side: str, names: list[str]) -> DataFrame:
    """node, p of one side of the judged."""
    if not names:
        return judged.select(c("p").alias("node"), "p").filter("false")
    flags = F.array(*(F.when(c(f"{side}{k // WORD}").bitwiseAND(lit(1 << k % WORD).cast("long")) != 0, lit(p)) for k, p in enumerate(names)))
    return judged.select("node", F.explode(F.filter(flags, lambda p: p.isNotNull())).alias("p"))


def cnf_003(g: Graph) -> DataFrame:
    judged = _judged(g, "d")
    if judged is not None:
        return _broken(judged[0], "d", judged[1]).select(c("node").alias("focus_node"), c("p").alias("path"), c("node").alias("value"))
    tables = Scratch(g.spark)
    domains = tables.put(_includes(g, v.DOMAIN, "domainIncludes"), "domains")
    types = g.scan(v.TYPE).filter("ok <> 2").select("s", c("o").alias("x"))
    up = _up(g, types.select("x").distinct())
    # (class, property) pairs are schema-sized; instances are only ever joined on their classes
    allowed = tables.put(domains.join(up, c("d") == c("y")).select(c("p").alias("_p"), c("x").alias("_x")).distinct(), "allowed")
    used = within(g.scan_of(domains.select("p")).select("s", "p").distinct(), types, "s")
    fine = used.join(types, "s").join(allowed, (c("p") == c("_p")) & (c("x") == c("_x"))).select("s", "p").distinct()
    return rows(used.join(fine, ["s", "p"], "left_anti"), "s", "p")


def cnf_004(g: Graph) -> DataFrame:
    ranges = Scratch(g.spark).put(_includes(g, v.RANGE, "rangeIncludes"), "ranges")
    plain = small(ranges.select(c("p").alias("_p"), c("d").alias("_d")))
    judged = _judged(g, "r")
    if judged is None:
        bad, groups = _bad_pairs(g, ranges), [g.scan_of(ranges.select("p"))]
    else:
        bad = _broken(judged[0], "r", judged[1])
        names = {r[0] for r in ranges.select("p").distinct().collect()}  # no more than are pushed
        # where triples are a set, those that are alike are found once
        groups = [g.distinct(*some) for some in (names & g.alike, names - g.alike) if some]
    bad = Scratch(g.spark).put(bad.select(c("p").alias("_b"), c("node").alias("_o")), "bad")
    few, out = bad.count() <= FEW, []
    for n, used in enumerate(groups):
        said = used.select("s", "p", "o", "ok", "dt").join(plain, (c("p") == c("_p")) & (c("dt") == c("_d")), "left")
        if few:
            found = said.join(F.broadcast(bad), (c("ok") == 0) & (c("p") == c("_b")) & (c("o") == c("_o")), "left").filter("(ok = 2 and _d is null) or _o is not null").select("s", "p", "o")
        else:
            found = said.filter("ok = 2 and _d is null").select("s", "p", "o").unionByName(_with_pairs(used.filter("ok = 0").select("s", "p", "o"), bad))
        found = found.select(c("s").alias("focus_node"), c("p").alias("path"), c("o").alias("value"))
        out.append(found if judged is not None and names & g.alike and n == 0 else found.distinct())
    return union(out) if out else rows(g.scan("").filter("false"), "s", "p", "o")


def _bad_pairs(g: Graph, ranges: DataFrame) -> DataFrame:
    """p, node of the objects that fit no range of a predicate, where predicates are many.  A predicate and object is judged
    once, however many subjects share it; objects without a type are left alone."""
    types = g.scan(v.TYPE).filter("ok <> 2").select(c("s").alias("_s"), c("o").alias("x"))
    up = _up(g, types.select("x").distinct())
    allowed = ranges.join(up, ranges["d"] == up["y"]).select(c("p").alias("_p"), c("x").alias("_x")).distinct()
    pairs = g.scan_of(ranges.select("p")).filter("ok = 0").select("p", "o").distinct()
    fits = pairs.join(types, c("o") == c("_s")).join(small(allowed.withColumn("fit", lit(1))), (c("p") == c("_p")) & (c("x") == c("_x")), "left")
    return fits.groupBy("p", c("o").alias("node")).agg(F.max("fit").alias("fit")).filter("fit is null")


def _with_pairs(used: DataFrame, bad: DataFrame) -> DataFrame:
    """s, p, o whose pair (p, o) is one of many (_b, _o).  Frequent pairs are few, and are broadcast: their triples aren't
    dealt by them."""
    hot = used.groupBy("p", "o").agg(F.count("*").alias("n")).filter(c("n") > HOT).select("p", "o")
    pairs = bad.select(c("_b").alias("p"), c("_o").alias("o"))
    often = F.broadcast(hot)
    rare = used.join(often, ["p", "o"], "left_anti").join(pairs, ["p", "o"], "left_semi")
    return used.join(F.broadcast(hot.join(pairs, ["p", "o"], "left_semi")), ["p", "o"], "left_semi").unionByName(rare)


def dat_001(g: Graph) -> DataFrame:
    bad = ((c("dt") == v.XSD + "date") & ~c("o").rlike("^-?[0-9]{4}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$")) | ((c("dt") == v.XSD + "integer") & ~c("o").rlike("^[+-]?[0-9]+$")) | ((c("dt") == v.XSD + "boolean") & ~c("o").rlike("^(true|false|1|0)$"))
    return rows(g.scan(datatypes=[v.XSD + n for n in ("date", "integer", "boolean")]).filter(bad), "s", "p", "o")


def dat_002(g: Graph) -> DataFrame:
    found = nodes(g).filter(named() & ~external("node") & has(USED) & ~has(SUBJECT, OF_TYPE, OF_VERSION)).select("node")
    found = without(found, g.scan(v.TYPE, v.VERSION_IRI).filter("ok = 2").select("o"), "node")  # said as texts
    return rows(meeting(g.scan().filter(c("ok") == 0).filter(~c("p").isin(v.TYPE, v.SEE_ALSO)), found, "o"), "s", "p", "o")


def dat_003(g: Graph) -> DataFrame:
    said = g.scan()
    if g.once and g.alike:  # equal texts of one datatype and language are one triple
        said = said.filter(~c("p").isin(*g.alike))
    return rows(said.filter("ok = 2").groupBy("s", "p", "o").count().filter("count > 1"), "s", "p")


def eff_001(g: Graph) -> DataFrame:
    sub = edges(g.scan(v.SUBCLASS))
    chain = sub.select(c("x").alias("c0"), c("y").alias("c1")).filter("c0 <> c1")
    for k in range(2, 7):
        step = sub.select(c("x").alias(f"c{k - 1}"), c("y").alias(f"c{k}"))
        # only the ends matter further on
        chain = chain.join(step, f"c{k - 1}").filter(f"c{k - 1} <> c{k} and c0 <> c{k}").select("c0", f"c{k}").distinct()
    return rows(chain, "c0", None, "c6")


def eff_002(g: Graph) -> DataFrame:
    share = nodes(g).agg(F.count("*").alias("total"), F.count_if(~named()).alias("blank")).filter("total > 0 and blank * 10 > total * 2")
    return rows(share, lit(v.GRAPH))


def eff_003(g: Graph) -> DataFrame:
    often = meeting(g.scan().filter(c("p") != v.TYPE).select("s", "p"), nodes(g).filter("n > 50"), "s")
    return rows(often.groupBy("s", "p").count().filter("count > 50"), "s", "p")


def log_001(g: Graph) -> DataFrame:
    apart = g.scan(v.DISJOINT).select(c("s").alias("x"), c("o").alias("y"))
    return rows(g.closed(v.SUBCLASS).join(apart, ["x", "y"]), "x", lit(f"({v.SUBCLASS})+"), "y")


def log_002(g: Graph) -> DataFrame:
    functional = g.typed(v.OWL + "FunctionalProperty").select(c("s").alias("p"))
    # two values that differ as strings: no self join
    return rows(g.scan_of(functional).groupBy("s", "p").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo < hi"), "s", "p")


def log_003(g: Graph) -> DataFrame:
    same = g.scan(v.EQUIV_CLASS).select("s", "o")
    return rows(same.join(g.scan(v.SUBCLASS).select("s", "o"), ["s", "o"]).filter("s <> o"), "s", lit(v.EQUIV_CLASS), "o")


def log_004(g: Graph) -> DataFrame:
    said = g.scan(v.INVERSE).filter("ok <> 2")
    pairs = said.select(c("s").alias("f"), c("o").alias("i"), c("ok").alias("k")).union(said.select("o", "s", "sk")).filter("k = 0").select("f", "i").distinct()
    other = pairs.select("f", c("i").alias("j"))
    return rows(pairs.join(other, "f").filter("i < j"), "f", lit(v.INVERSE), joined(c("i"), c("j")))


def log_005(g: Graph) -> DataFrame:
    return rows(g.scan(v.INVERSE).filter("s = o"), "s", lit(v.INVERSE), "o")


def _ends_differ(g: Graph, kind: str) -> DataFrame:
    d, r = g.scan(v.DOMAIN).select("s", c("o").alias("d")), g.scan(v.RANGE).select("s", c("o").alias("r"))
    return rows(g.typed(kind).join(d, "s").join(r, "s").filter("d <> r"), "s", joined(lit(v.DOMAIN), lit(v.RANGE)), joined(c("d"), c("r")))


def log_006(g: Graph) -> DataFrame:
    return _ends_differ(g, v.OWL + "SymmetricProperty")


def log_007(g: Graph) -> DataFrame:
    return _ends_differ(g, v.OWL + "TransitiveProperty")


def qua_001(g: Graph) -> DataFrame:
    return rows(without(g.typed(v.CLASS, v.OBJ_PROP, v.DATA_PROP).filter("not startswith(s, '_:')"), g.having(v.LABEL, v.PREF_LABEL), "s"), "s")


def qua_002(g: Graph) -> DataFrame:
    return rows(without(g.typed(v.ONTOLOGY), g.having(v.VERSION_INFO, v.TITLE, v.LABEL, v.PREF_LABEL), "s"), "s")


def qua_003(g: Graph) -> DataFrame:
    old = g.scan(v.DEPRECATED).filter((c("ok") == 2) & (c("o") == "true") & (c("dt") == v.XSD + "boolean")).select(c("s").alias("term"))
    typed = g.scan(v.TYPE).filter("ok <> 2").select("s", c("o").alias("term")).join(small(old.distinct()), "term", "left_semi")
    uses = g.scan_of(old).select("s", c("p").alias("term")).union(typed.select("s", "term"))
    return rows(uses, "s", None, "term")


def qua_004(g: Graph) -> DataFrame:
    known = nodes(g)
    bare = known.filter(named() & ~external("node") & ~has(LABELLED, OF_VERSION, OF_SEE)).select("node")
    predicates = Scratch(g.spark).put(g.scan().select(c("p").alias("node")).distinct().filter(~external("node")), "predicates")
    found = bare.unionByName(lacking(predicates, known.select("node"), "node"))
    found = without(found, g.scan(v.VERSION_IRI, v.SEE_ALSO).filter("ok = 2").select("o"), "node")  # said as texts
    # each once already
    return found.select(c("node").alias("focus_node"), lit(v.PREF_LABEL).alias("path"), c("node").alias("value"))


def qua_005(g: Graph) -> DataFrame:
    return rows(g.typed(v.ONTOLOGY).agg(F.count("*").alias("n")).filter("n = 0"), lit(v.GRAPH))


def qua_006(g: Graph) -> DataFrame:
    concepts = g.typed(v.CLASS, v.OBJ_PROP, v.DATA_PROP, v.ANN_PROP, v.RDF_PROP).filter("not startswith(s, '_:')").select(c("s").alias("x"), F.regexp_replace("s", "^(.*[/#])[^/#]*$", "$1").alias("ns"))
    heads = g.typed(v.ONTOLOGY)
    return rows(heads.join(concepts, heads["s"] == concepts["ns"]), "s", None, "x")


def qua_007(g: Graph) -> DataFrame:
    return rows(without(g.typed(v.ONTOLOGY), g.having(v.VERSION_IRI), "s"), "s")


def qua_008(g: Graph) -> DataFrame:
    heads = g.typed(v.ONTOLOGY)
    ids = heads.select("s", c("s").alias("id")).union(heads.join(g.scan(v.VERSION_IRI).select("s", c("o").alias("id")), "s"))
    return rows(ids.filter(~c("id").startswith("https://")), "s", None, "id")


def rea_001(g: Graph) -> DataFrame:
    apart = g.scan(v.DISJOINT).select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).filter("a < b").distinct()
    apart = small(apart)  # axioms: types are never dealt by class
    classes = apart.select(c("a").alias("t")).union(apart.select("b")).distinct()
    types = g.scan(v.TYPE).filter("ok <> 2").select("s", c("o").alias("t")).join(small(classes), "t", "left_semi")
    a, b = types.select("s", c("t").alias("a")), types.select("s", c("t").alias("b"))
    return rows(a.join(apart, "a").join(b, ["s", "b"]), "s", None, joined(c("a"), c("b")))


def rea_002(g: Graph) -> DataFrame:
    one_way = g.typed(v.OWL + "AsymmetricProperty").select(c("s").alias("p"))
    t = g.scan_of(one_way).filter("ok <> 2 and s <> o").select("s", "p", "o")
    back = t.select(c("o").alias("s"), "p", c("s").alias("o"))
    return rows(t.join(back, ["s", "p", "o"]), "s", "p", "o")


def rea_003(g: Graph) -> DataFrame:
    never = g.typed(v.OWL + "IrreflexiveProperty").select(c("s").alias("p"))
    return rows(g.scan_of(never).filter("s = o and ok <> 2"), "s", "p")


def rea_004(g: Graph) -> DataFrame:
    return rows(g.typed(v.NOTHING), "s")


def _unknown(g: Graph, when: Column, known: DataFrame) -> DataFrame:
    """p of the predicates that aren't among the known nodes (column s).  Predicates are a vocabulary, so their triples are
    read by name and never dealt by predicate."""
    named = Scratch(g.spark).put(g.scan().filter(when).select("p").distinct(), "predicates")
    met = known.join(small(named.select(c("p").alias("s"))), "s", "left_semi")
    return without(named, met, "p")


def str_001(g: Graph) -> DataFrame:
    used = g.scan(v.TYPE).filter((c("ok") == 0) & ~c("o").isin(v.BUILTIN_TYPES)).select("s", "o")
    unknown = without(used.select("o").distinct(), g.typed(v.CLASS, v.RDFS_CLASS, v.RESTRICTION), "o")
    return rows(used.join(small(unknown), "o", "left_semi"), "s", None, "o")


def str_002(g: Graph) -> DataFrame:
    unknown = _unknown(g, (c("p") != v.TYPE) & ~external("p"), g.typed(v.RDF_PROP, v.OBJ_PROP, v.DATA_PROP, v.ANN_PROP))
    return rows(g.scan_of(unknown), "s", "p")


def str_003(g: Graph) -> DataFrame:
    ends = g.scan().filter(c("p").isin(v.DOMAIN, v.RANGE) | c("p").endswith("domainIncludes") | c("p").endswith("rangeIncludes")).select("s")
    return rows(without(g.typed(v.OBJ_PROP, v.DATA_PROP), ends, "s"), "s")


def str_004(g: Graph) -> DataFrame:
    classes = g.typed(v.CLASS).filter(~c("s").startswith("_:") & ~external("s"))
    defined = g.having(v.EQUIV_CLASS, v.OWL + "intersectionOf", v.SUBCLASS, v.OWL + "unionOf", v.OWL + "oneOf", v.DISJOINT).union(g.scan(v.DISJOINT).select("o"))
    return rows(without(classes, defined, "s"), "s")


def str_005(g: Graph) -> DataFrame:
    return rows(lacking(g.scan(v.DOMAIN).select("s", "o"), g.scan(v.TYPE).select("s"), "o"), "s", lit(v.DOMAIN), "o")


def str_006(g: Graph) -> DataFrame:
    used = g.scan().filter(c("ok") == 0).filter(~c("p").isin(v.IMPORTS, v.VERSION_IRI, v.TYPE) & ~external("p")).select("s", "p", "o")
    return rows(meeting(used, nodes(g).filter(named() & ~external("node") & has(BOUND) & ~has(TYPED)), "o"), "s", "p", "o")


def str_007(g: Graph) -> DataFrame:
    return rows(g.scan_of(_unknown(g, ~external("p"), g.scan(v.TYPE).select("s"))), "p", None, joined(c("s"), c("o")))


def str_008(g: Graph) -> DataFrame:
    ranges = within(g.scan(v.RANGE).select("s", "o"), g.typed(v.OBJ_PROP), "s")
    return rows(lacking(ranges, g.scan(v.TYPE).select("s"), "o"), "s", lit(v.RANGE), "o")


def str_009(g: Graph) -> DataFrame:
    used = g.scan().filter((c("p") != v.TYPE) & (c("sk") == 0)).select("s", "p", "o")
    return rows(meeting(used, nodes(g).filter(named() & ~external("node") & has(OTHER) & ~has(TYPED)), "s"), "s", "p", "o")


def sty_001(g: Graph) -> DataFrame:
    return rows(g.typed(v.CLASS).filter(~c("s").startswith("_:") & ~local("s").rlike("^[A-Z][A-Za-z0-9]*$")), "s")


def sty_002(g: Graph) -> DataFrame:
    return rows(g.typed(v.OBJ_PROP, v.DATA_PROP).filter(~c("s").startswith("_:") & ~local("s").rlike("^[a-z][A-Za-z0-9]*$")), "s")


def sty_003(g: Graph) -> DataFrame:
    return rows(g.scan(v.LABEL).filter("ok = 2 and coalesce(lang, '') = ''"), "s", None, "o")


def sty_004(g: Graph) -> DataFrame:
    terms = g.typed(v.CLASS, v.DATA_PROP, v.OBJ_PROP, v.ANN_PROP).filter(~external("s"))
    flat = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    said = terms.join(g.scan(v.PREF_LABEL).select("s", "o"), "s")
    return rows(said.filter(flat(local("s")) != flat(c("o"))), "s", lit(v.PREF_LABEL), "o")


def sty_005(g: Graph) -> DataFrame:
    sign = F.regexp_replace(local("s"), "[a-zA-Z0-9]+([^a-zA-Z0-9:#/ ])[a-zA-Z0-9]+.*", "$1")
    found = g.typed(v.CLASS, v.DATA_PROP, v.OBJ_PROP).select(sign.alias("sign")).filter(c("sign").rlike("[^a-zA-Z0-9:#/ ]"))
    return rows(found.agg(F.array_sort(F.collect_set("sign")).alias("signs")).filter("size(signs) > 1"), lit(v.GRAPH), None, F.array_join("signs", "|"))


@dataclass(frozen=True)
class Check:
    id: str
    severity: str
    title: str
    advice: str
    run: Callable[[Graph], DataFrame]

    @property
    def category(self) -> str:
        return CATEGORIES[self.id.split("-")[0]]


CATEGORIES = {"CNF": "conformance", "DAT": "data", "EFF": "efficiency", "LOG": "logical", "QUA": "quality", "REA": "reasoning", "STR": "structural", "STY": "style", "MDL": "modelling", "VOC": "vocabulary", "PRJ": "project"}
_LIST = """
CNF-003 V The subject's types reach no declared domain|Type the subject, or widen the domain
CNF-004 V The value fits no declared range|Correct the value, or widen the range
DAT-001 V A literal isn't written as its datatype asks|Correct the literal or its datatype
DAT-002 W A referenced node is described nowhere|Describe the node, or drop the reference
DAT-003 I A value is repeated under several datatypes or languages|Keep one of them
EFF-001 W A chain of six subclass steps|Flatten the hierarchy
EFF-002 W Over a fifth of all nodes are blank|Give nodes IRIs
EFF-003 I Over fifty values of one property|Consider a collection
LOG-001 V A class is disjoint with its own ancestor|Drop one of the two axioms
LOG-002 V Several values of a functional property|Keep one value
LOG-003 W Equivalent to and subclass of the same class|Keep one of the two axioms
LOG-004 V Two different inverses of one property|Keep one inverse
LOG-005 V A property is its own inverse|Declare it symmetric
LOG-006 V A symmetric property's domain and range differ|Make them equal
LOG-007 V A transitive property's domain and range differ|Make them equal
QUA-001 W A class or property without a label|Add a label
QUA-002 I An ontology without version or title|Add a version
QUA-003 W A deprecated term is in use|Use its successor
QUA-004 W A resource without a label|Add a preferred label
QUA-005 W No ontology is declared|Declare one
QUA-006 W The ontology's IRI is the namespace of its terms|Use different IRIs
QUA-007 I An ontology without a version IRI|Add one
QUA-008 W An ontology or version IRI isn't https|Use https
REA-001 V An individual of two disjoint classes|Drop one type
REA-002 V An asymmetric property holds both ways|Drop one direction
REA-003 V An irreflexive property holds on itself|Drop the loop
REA-004 V An individual of the empty class|Correct its types
STR-001 V A type that is no declared class|Declare the class
STR-002 V A predicate that is no declared property|Declare the property
STR-003 W A property without domain and range|Declare them
STR-004 W A class without a definition|Add an axiom
STR-005 V A domain without a type|Declare the class
STR-006 V An object without a type|Type the object
STR-007 V A predicate without a type|Declare the property
STR-008 V A range without a type|Declare the class
STR-009 V A subject without a type|Type the subject
STY-001 W A class name isn't UpperCamelCase|Rename it
STY-002 W A property name isn't lowerCamelCase|Rename it
STY-003 I A label without a language|Add a language
STY-004 W A preferred label differs from the local name|Align them
STY-005 W Local names use several separators|Use one
"""
SEVERITY = {"V": "Violation", "W": "Warning", "I": "Info"}
CHECKS: dict[str, Check] = {}
for _line in _LIST.strip().splitlines():
    _id, _sev, _text = _line.split(" ", 2)
    CHECKS[_id] = Check(_id, SEVERITY[_sev], *_text.split("|"), globals()[_id.lower().replace("-", "_")])


def register_check(check: Check) -> None:
    """Adds a check of one's own (2.10)."""
    CHECKS[check.id] = check


def findings(check: Check, found: DataFrame, source: str = "sparql") -> DataFrame:
    """The full findings schema for one check's rows."""
    said = F.concat(lit(check.title + ": "), c("focus_node"))
    return found.select(lit(check.id).alias("check_id"), lit(check.category).alias("category"), lit(check.title).alias("title"), lit(check.severity).alias("severity"), "focus_node", "path", "value", said.alias("message"), lit(check.advice).alias("remediation"), F.array(lit(source)).alias("sources"))
