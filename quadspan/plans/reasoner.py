"""Forward closure of sixteen RDFS and OWL rules (2.7), contradictions, and the inferred overlay.

The schema is closed first: superclasses, superproperties, and for each property the classes of its subjects and objects.
These maps are broadcast where they are counted to be small, and facts run through them once.  Identities become
classes: a node has a representative, types are shared through it, and pairs are made only where someone scans for them.
Only where the schema speaks of the vocabulary itself (a subproperty of rdfs:subClassOf, a domain of rdf:type) can a fact
make a schema triple; then the pass is repeated until nothing is new.  The range rule skips literals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..model import LITERAL, PUSHED, TRIPLE, Graph, inline, narrowed, small, union
from ..operators.closure import closure
from ..operators.contract import components
from ..storage import Scratch
from .checks import WORD, rows

c, lit = F.col, F.lit
#: Predicates whose triples the rules read as schema.
META = (v.TYPE, v.SUBCLASS, v.SUBPROP, v.EQUIV_CLASS, v.EQUIV_PROP, v.SAME, v.DOMAIN, v.RANGE)


class Closed(Graph):
    """A closure: triples without derived identities, and the members (node, rep) of identity classes.

    A scan that asks for owl:sameAs makes the pairs of each class."""

    def __init__(self, triples: DataFrame, members: DataFrame, reached: list[str] | None = None):
        super().__init__(triples, distinct=True)
        self.members = members
        #: Predicates but owl:sameAs that may have inferred triples, where they are few.
        self.reached = reached

    def scan(self, *predicates: str, objects: Sequence[str] | None = None, datatypes: Sequence[str] | None = None) -> DataFrame:
        found = super().scan(*predicates)
        if not predicates or v.SAME in predicates:
            found = found.filter((c("p") != v.SAME) | (c("ok") == LITERAL)).unionByName(self.same())
        return narrowed(found, objects, datatypes)

    def same(self) -> DataFrame:
        """All pairs of identities, each node with itself included."""
        other = self.members.select("rep", c("node").alias("other"))
        return self.members.join(other, "rep").select(*_node(c("node"), lit(v.SAME), c("other")))

    def counts(self) -> DataFrame:
        """p, n, least (subject), most (object) of the closure; identities are counted from their classes, without making
        pairs."""
        found = self.triples.filter((c("p") != v.SAME) | (c("ok") == LITERAL))
        by_p = found.groupBy("p").agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("o").alias("most"))
        sizes = self.members.groupBy("rep").agg(F.count("*").alias("k"), F.min("node").alias("least"), F.max("node").alias("most"))
        same = sizes.agg(F.sum(c("k") * c("k")).alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).filter("n is not null")
        return by_p.unionByName(same.select(lit(v.SAME).alias("p"), "n", "least", "most"))


def _kind(x: Column) -> Column:
    return F.when(x.startswith("_:"), 1).otherwise(0)


def _node(s: Column, p: Column, o: Column) -> list[Column]:
    none = lit(None).cast("string")
    return [s.alias("s"), _kind(s).alias("sk"), p.alias("p"), o.alias("o"), _kind(o).alias("ok"), none.alias("dt"), none.alias("lang")]


def _pairs(t: DataFrame, *predicates: str, both: bool = False) -> DataFrame:
    out = t.filter(c("p").isin(*predicates) & (c("ok") != LITERAL)).select(c("s").alias("x"), c("o").alias("y"))
    return out.unionByName(out.select(c("y").alias("x"), c("x").alias("y"))) if both else out


def _schema_maps(schema: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """kind, x, y of what follows from the schema alone, for each of four closures; for each property its superproperties
    and the classes of its subjects and objects; for each class its superclasses."""
    # one closure of all four kinds: nodes are marked by kind
    kinds = {
        "c": _pairs(schema, v.SUBCLASS),
        "q": _pairs(schema, v.SUBPROP),
        "C": _pairs(schema, v.SUBCLASS).unionByName(_pairs(schema, v.EQUIV_CLASS, both=True)),
        "Q": _pairs(schema, v.SUBPROP).unionByName(_pairs(schema, v.EQUIV_PROP, both=True)),
    }
    marked = union([e.select(F.concat(lit(k), "x").alias("x"), F.concat(lit(k), "y").alias("y")) for k, e in kinds.items()])
    rest = lambda x: F.substring(x, 2, 1 << 30)
    above = tables.put(closure(marked).select(F.substring("x", 1, 1).alias("kind"), rest("x").alias("x"), rest("y").alias("y")), "above")
    classes, properties = (above.filter(c("kind") == k).select("x", "y") for k in "CQ")
    per_property = [properties.select(c("x").alias("p"), lit("up").alias("role"), "y")]
    for role, predicate in (("dom", v.DOMAIN), ("ran", v.RANGE)):
        said = _pairs(schema, predicate)
        # what a superproperty says of its ends holds for the property, and so do the superclasses
        own = said.select(c("x").alias("p"), "y").unionByName(properties.select(c("x").alias("p"), c("y").alias("x")).join(said, "x").select("p", "y"))
        wider = own.join(classes.select(c("x").alias("y"), c("y").alias("z")), "y").select("p", c("z").alias("y"))
        per_property.append(own.unionByName(wider).select("p", lit(role).alias("role"), "y"))
    of = lambda role: F.collect_set(F.when(c("role") == role, c("y"))).alias(role)
    ends = tables.put(union(per_property).groupBy("p").agg(of("up"), of("dom"), of("ran")), "properties")
    ups = tables.put(classes.groupBy(c("x").alias("o")).agg(F.collect_set("y").alias("supers")), "classes")
    return above, ends, ups


def _once(facts: DataFrame, tables: Scratch) -> Closed:
    """One pass of all rules."""
    schema = tables.put(facts.filter(c("p").isin(*META[1:])), "schema")
    above, ends, ups = _schema_maps(schema, tables)
    members = components(_pairs(schema, v.SAME)).select("node", c("root").alias("rep"))
    triple = lambda s, sk, p, o, ok, dt, lang: F.struct(s.alias("s"), sk.alias("sk"), p.alias("p"), o.alias("o"), ok.alias("ok"), dt.alias("dt"), lang.alias("lang"))
    none, kind = lit(None).cast("string"), lit(v.TYPE)
    moved = F.transform("up", lambda q: triple(c("s"), c("sk"), q, c("o"), c("ok"), c("dt"), c("lang")))
    of_subject = F.transform("dom", lambda d: triple(c("s"), c("sk"), kind, d, _kind(d), none, none))
    of_object = F.when(c("ok") != LITERAL, F.transform("ran", lambda d: triple(c("o"), c("ok"), kind, d, _kind(d), none, none))).otherwise(F.array().cast("array<struct<s:string,sk:int,p:string,o:string,ok:int,dt:string,lang:string>>"))
    made = facts.join(small(ends), "p").select(F.explode(F.concat(moved, of_subject, of_object)).alias("t")).select("t.*")
    typed = facts.filter((c("p") == v.TYPE) & (c("ok") != LITERAL)).join(small(ups), "o").select("s", "sk", "p", F.explode("supers").alias("o")).select("s", "sk", "p", "o", _kind(c("o")).alias("ok"), none.alias("dt"), none.alias("lang"))
    closed = above.filter("kind in ('c', 'q')").select(*_node(c("x"), F.when(c("kind") == "c", v.SUBCLASS).otherwise(v.SUBPROP), c("y")))
    turned = schema.filter(c("p").isin(v.EQUIV_CLASS, v.EQUIV_PROP) & (c("ok") != LITERAL)).select(*_node(c("o"), c("p"), c("s")))
    # facts are a set; only predicates that the rules conclude can say something again
    raised = [r[0] for r in ends.select(F.explode("up").alias("p")).distinct().limit(PUSHED + 1).collect()]
    reached = sorted({v.TYPE, v.SUBCLASS, v.SUBPROP, v.EQUIV_CLASS, v.EQUIV_PROP, *raised}) if len(raised) <= PUSHED else None
    again, rest = (facts, None) if reached is None else (facts.filter(c("p").isin(reached)), facts.filter(~c("p").isin(reached)))
    said = tables.put(union([again, made, typed, closed, turned]).distinct(), "closed")
    known = said if rest is None else said.unionByName(rest)
    # types of one are types of all members of its class
    types = tables.put(said.filter((c("p") == v.TYPE) & (c("ok") != LITERAL)).join(small(members), c("s") == c("node")).select(*TRIPLE, "node", "rep"), "types")
    shared = types.select("rep", "o").distinct().join(members, "rep").select(*_node(c("node"), kind, c("o")))
    fresh = shared.join(types.select("s", "p", "o", "ok"), ["s", "p", "o", "ok"], "left_anti").select(*TRIPLE)
    return Closed(known.unionByName(tables.put(fresh, "shared")), members, reached)


def _links(facts: DataFrame) -> DataFrame:
    """What the schema says of the vocabulary itself."""
    return facts.filter(c("p").isin(v.SUBPROP, v.EQUIV_PROP, v.DOMAIN, v.RANGE) & (c("s").isin(*META) | (c("p").isin(v.SUBPROP, v.EQUIV_PROP) & c("o").isin(*META))))


def reason(g: Graph) -> Closed:
    """The deductive closure, asserted triples included."""
    tables = Scratch(g.spark)
    facts = tables.put(g.distinct(), "facts")
    links = _links(facts)
    found = _once(facts, tables)
    while not links.isEmpty():  # the schema speaks of the vocabulary: its triples may follow from facts
        # identities that facts have made are in the triples, and not yet in the classes
        whole = tables.put(found.triples.unionByName(found.same()).select(*TRIPLE).distinct(), "facts")
        if whole.count() == facts.count():
            break
        facts = whole
        found = _once(facts, tables)
    return found


def inferred(g: Graph, closed: Closed) -> DataFrame:
    """Closure without what was asserted."""
    some = (*closed.reached, v.SAME) if closed.reached is not None else ()
    return closed.scan(*some).exceptAll(g.distinct(*some))


def disjoint_members(closed: Graph) -> DataFrame:
    """REA-DISJOINT: individuals of two disjoint classes."""
    apart = _pairs(closed.scan(v.DISJOINT), v.DISJOINT).select(c("x").alias("a"), c("y").alias("b"))
    apart = small(Scratch(apart.sparkSession).put(apart.distinct(), "apart"))  # axioms: individuals are never dealt by class
    named = apart.select(c("a").alias("o")).union(apart.select("b")).distinct()
    types = _pairs(closed.scan(v.TYPE).join(small(named), "o", "left_semi"), v.TYPE).select(c("x").alias("i"), c("y").alias("a"))
    return rows(types.join(apart, "a").join(types.select("i", c("a").alias("b")), ["i", "b"]), "i", None, lit(None).cast("string"))


class Types:
    """The types that the closure gives to nodes, without the closure: a row for each node, classes as bits.

    One pass of the rules gives all types, so each triple's types are looked up (by its predicate, or its class) and combined by
    node where it is scanned; only predicates that give a type are read.  ``fits`` is false where the schema speaks of the
    vocabulary, or where predicates or classes are many: then ``reason`` is needed."""

    def __init__(self, g: Graph, classes: list[str] | None = None):
        """classes: those that are asked for; all where none is given."""
        self.g, self.tables, self.asked = g, Scratch(g.spark), classes is not None
        self.schema = self.tables.put(g.distinct(*META[1:]), "schema")
        self.fits = _links(self.schema).isEmpty()
        if not self.fits:
            return
        self.above, self.ends, self.ups = _schema_maps(self.schema, self.tables)
        raised = [tuple(r) for r in self.ends.select("p", F.explode("up").alias("q")).limit(PUSHED + 1).collect()]
        self.raised = sorted(set(raised))
        self.fits = len(raised) <= PUSHED
        if classes is None and self.fits:
            own = g.scan(v.TYPE).filter(c("ok") != LITERAL).select("o").distinct()
            wide = union([self.ends.select(F.explode(F.array_union("dom", "ran")).alias("o")), self.ups.select(F.explode("supers").alias("o")), own]).distinct()
            classes = [r[0] for r in wide.limit(PUSHED + 1).collect()]
        self.classes = sorted(classes or [])
        self.fits = self.fits and len(self.classes) <= PUSHED
        self.words = range(-(-len(self.classes) // WORD))

    def _masks(self, pairs: DataFrame, key: str, name: str) -> DataFrame:
        """key, name0..: the classes (column y) of each key as bits."""
        at = lambda k, w: 1 << k % WORD if k // WORD == w else 0
        bits = inline(self.g.spark, [(x, *(at(k, w) for w in self.words)) for k, x in enumerate(self.classes)], ", ".join(["y string", *(f"b{w} long" for w in self.words)]))
        return pairs.join(F.broadcast(bits), "y").groupBy(key).agg(*(F.bit_or(f"b{w}").alias(f"{name}{w}") for w in self.words))

    def table(self) -> DataFrame:
        """node, t0.. (its types), a0.. (those that are asserted)."""
        g, words, none = self.g, self.words, lit(0).cast("long")
        dom, ran = (self._masks(self.ends.select("p", F.explode(role).alias("y")), "p", role) for role in ("dom", "ran"))
        giving = self.tables.put(dom.join(ran, "p", "full"), "giving")
        own = inline(g.spark, [(x, x) for x in self.classes], "x string, y string")
        wider = self._masks(own.unionByName(self.ups.select(c("o").alias("x"), F.explode("supers").alias("y"))).distinct(), "x", "sup")
        mine = self._masks(own.select(c("x").alias("_x"), "y"), "_x", "own")
        by_class = self.tables.put(wider.join(mine, c("x") == c("_x"), "left").drop("_x"), "supers")
        names = [r[0] for r in giving.select("p").limit(PUSHED + 1).collect()]
        subs = [r[0] for r in by_class.select("x").limit(PUSHED + 1).collect()] if self.asked else []
        if self.asked and max(len(subs), len(names)) <= PUSHED:  # instances of other classes aren't read
            t = union([*([g.scan(v.TYPE, objects=subs)] if subs else []), *([g.scan(*names)] if names else []), g.scan("").filter("false")])
        else:
            t = g.scan(*{v.TYPE, *names}) if len(names) <= PUSHED else g.scan()
        typed = (c("p") == v.TYPE) & (c("ok") != LITERAL)
        t = t.select("s", "p", "o", "ok").join(small(giving), "p", "left").join(small(by_class), typed & (c("o") == c("x")), "left")
        word = lambda n: F.coalesce(c(n), none)
        some = lambda n: reduce(lambda a, b: a | b, [word(f"{n}{w}") != 0 for w in words])
        row = lambda node, t_, a: F.struct(c(node).alias("node"), *(t_(w).alias(f"t{w}") for w in words), *(a(w).alias(f"a{w}") for w in words))
        of_subject = F.when(some("dom") | some("sup"), row("s", lambda w: word(f"dom{w}").bitwiseOR(word(f"sup{w}")), lambda w: word(f"own{w}")))
        of_object = F.when((c("ok") != LITERAL) & some("ran"), row("o", lambda w: word(f"ran{w}"), lambda w: none))
        said = t.select(F.explode(F.array(of_subject, of_object)).alias("x")).filter("x is not null")
        bits = lambda p: [F.bit_or(f"{p}{n}").alias(n) for n in (f"{x}{w}" for x in "ta" for w in words)]
        found = self.tables.put(said.groupBy("x.node").agg(*bits("x.")), "types")
        # types of one are types of all members of its class
        members = small(self.members())
        classes = found.join(members, "node").groupBy("rep").agg(*(F.bit_or(f"t{w}").alias(f"t{w}") for w in words))
        shared = members.join(classes, "rep").select("node", *(f"t{w}" for w in words), *(none.alias(f"a{w}") for w in words))
        both = found.join(members.select("node"), "node", "left_semi").unionByName(shared).groupBy("node").agg(*bits(""))
        return found.join(members.select("node"), "node", "left_anti").unionByName(both)

    def members(self) -> DataFrame:
        """node, rep of the identity classes."""
        if "_members" not in self.__dict__:
            self._members = components(_pairs(self.schema, v.SAME)).select("node", c("root").alias("rep"))
        return self._members


def inferred_counts(g: Graph) -> DataFrame:
    """p, n: how many triples of each predicate are inferred."""
    types = Types(g)
    if not types.fits or not types.classes:
        return inferred(g, reason(g)).groupBy("p").agg(F.count("*").alias("n"))
    new = reduce(lambda a, b: a + b, [F.bit_count(c(f"t{w}").bitwiseAND(F.bitwise_not(f"a{w}"))) for w in types.words])
    of_types = types.table().agg(F.sum(new.cast("long")).alias("n")).select(lit(v.TYPE).alias("p"), "n")
    schema = types.schema
    # the schema's own, and facts of predicates with wider ones
    above = types.above.filter("kind in ('c', 'q')").select(*_node(c("x"), F.when(c("kind") == "c", v.SUBCLASS).otherwise(v.SUBPROP), c("y")))
    turned = schema.filter(c("p").isin(v.EQUIV_CLASS, v.EQUIV_PROP) & (c("ok") != LITERAL)).select(*_node(c("o"), c("p"), c("s")))
    made = [above, turned, *(g.scan(p).select("s", "sk", lit(q).alias("p"), "o", "ok", "dt", "lang") for p, q in types.raised)]
    made = union([x.select(*TRIPLE) for x in made]).distinct()
    known = g.distinct(*{v.SUBCLASS, v.SUBPROP, v.EQUIV_CLASS, v.EQUIV_PROP, *(q for _, q in types.raised)})
    of_rest = made.exceptAll(known).groupBy("p").agg(F.count("*").alias("n"))
    # identities are counted from their classes; what was asserted is among them
    said = _pairs(schema, v.SAME).agg(F.count("*").alias("k"))
    pairs = types.members().groupBy("rep").agg(F.count("*").alias("k")).agg(F.sum(c("k") * c("k")).alias("n"))
    of_same = pairs.crossJoin(said).select(lit(v.SAME).alias("p"), (c("n") - c("k")).alias("n"))  # one row each
    return union([of_types, of_rest, of_same]).filter("n > 0")


def disjoint_types(g: Graph) -> DataFrame:
    """REA-DISJOINT over the closure, of which only the types that some axiom names are made."""
    types = Types(g, [])
    if not types.fits:
        return disjoint_members(reason(g))
    names = sorted({p for p, q in types.raised if q == v.DISJOINT})
    found = _pairs(g.scan(v.DISJOINT, *names), v.DISJOINT, *names).distinct().limit(PUSHED // 2 + 1).collect()
    if len(found) > PUSHED // 2:
        return disjoint_members(reason(g))
    if not found:
        return rows(g.scan("").filter("false"), "s", None, lit(None).cast("string"))
    types.classes = sorted({x for r in found for x in r})
    types.words = range(-(-len(types.classes) // WORD))
    at = {x: k for k, x in enumerate(types.classes)}
    bit = lambda x: c(f"t{at[x] // WORD}").bitwiseAND(lit(1 << at[x] % WORD).cast("long")) != 0
    both = reduce(lambda a, b: a | b, [bit(a) & bit(b) for a, b in found])
    # a row for each node already
    none = lit(None).cast("string")
    return types.table().filter(both).select(c("node").alias("focus_node"), none.alias("path"), none.alias("value"))


def same_and_different(closed: Closed) -> DataFrame:
    """REA-SAMEDIFF: nodes said to differ, of one identity class."""
    other = closed.scan(v.DIFFERENT).filter("ok <> 2").select("s", "o")
    of = lambda x, name: closed.members.select(c("node").alias(x), c("rep").alias(name))
    return rows(other.join(of("s", "_a"), "s").join(of("o", "_b"), "o").filter("_a = _b"), "s", None, lit(None).cast("string"))
