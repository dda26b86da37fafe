"""The relational tables as a graph: a direct mapping of rows, and an inline ontology with planted defects.

A mapping is a list of rules (table, condition, subject, predicate, object, kind, datatype, language) in SQL expressions
that Spark and DuckDB both read.  ``TableGraph.scan(p)`` builds only the branches of the wanted predicates, so a pattern
with a constant predicate reads the columns of one table and nothing else; a full scan reads each table once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as v
from ..model import BNODE, IRI, LITERAL, TRIPLE, Dataset, Graph, from_tuples, narrowed, union

EX = "http://example.org/shop#"
#: Names of the tables' graphs.
GRAPHS = "http://example.org/graph/"
_X = lambda name: v.XSD + name
_iri = lambda kind, key: f"concat('{EX}{kind}-', CAST({key} AS STRING))"
_dec = lambda c: f"CAST(CAST({c} AS DECIMAL(18,2)) AS STRING)"
_LINE = "concat('_:li-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST({day} AS STRING))"
_STR, _LANG = v.XSD + "string", v.RDF + "langString"


def _days(spark: bool) -> str:
    """Seconds since 1970 of the ship date."""
    return "unix_seconds(CAST(l_shipdate AS TIMESTAMP))" if spark else "epoch(l_shipdate)::BIGINT"


def rules(spark: bool = True) -> list[tuple]:
    """(table, condition, s, sk, p, o, ok, dt, lang)"""
    line = _LINE.replace("{day}", _days(spark))
    stamp = "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")" if spark else "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"
    day = "date_format(o_orderdate, 'yyyy-MM-dd')" if spark else "strftime(o_orderdate, '%Y-%m-%d')"
    year = "date_format(o_orderdate, 'yyyy')" if spark else "strftime(o_orderdate, '%Y')"
    region, nation, customer, supplier, part, order, event, document = (_iri(k, c) for k, c in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("order", "o_orderkey"), ("event", "event_id"), ("document", "doc_id")))
    of = lambda name: f"'{EX}{name}'"
    node = lambda t, s, p, o, where="true", sk=IRI, ok=IRI: (t, where, s, sk, p, o, ok, None, None)
    text = lambda t, s, p, o, where="true", dt=_STR, sk=IRI: (t, where, s, sk, p, o, LITERAL, dt, None)
    said = lambda t, s, p, o, lang="'en'": (t, "true", s, IRI, p, o, LITERAL, _LANG, lang)
    return [
        node("region", region, v.TYPE, of("Region"), "r_regionkey <> 3"), node("region", region, v.TYPE, f"'{v.NOTHING}'", "r_regionkey = 0"), text("region", region, v.LABEL, "r_name"),
        node("nation", nation, v.TYPE, of("Nation")), text("nation", nation, v.LABEL, "n_name"), said("nation", nation, v.LABEL, "n_name"), node("nation", nation, EX + "inRegion", _iri("region", "n_regionkey")),
        node("nation", nation, EX + "regionPeer", _iri("nation", "n_nationkey + 1"), "n_nationkey % 5 = 0 and n_nationkey < 24"), node("nation", nation, EX + "regionPeer", _iri("nation", "n_nationkey - 1"), "n_nationkey % 5 = 1"),
        node("customer", customer, v.TYPE, of("Customer"), "c_custkey % 97 <> 0"), said("customer", customer, v.LABEL, "c_name"), text("customer", customer, EX + "accountBalance", _dec("c_acctbal"), dt=_X("decimal")), text("customer", customer, EX + "segment", "c_mktsegment"),
        node("customer", customer, EX + "inNation", _iri("nation", "c_nationkey")), node("customer", customer, v.SAME, _iri("customer", "c_custkey + 1"), "c_custkey % 200 = 0"), node("customer", customer, v.DIFFERENT, _iri("customer", "c_custkey + 1"), "c_custkey % 200 = 0"),
        node("supplier", supplier, v.TYPE, of("Supplier")), said("supplier", supplier, v.LABEL, "s_name"), text("supplier", supplier, EX + "accountBalance", _dec("s_acctbal"), dt=_X("decimal")), node("supplier", supplier, EX + "inNation", _iri("nation", "s_nationkey")),
        node("part", part, v.TYPE, of("Part")), said("part", part, v.LABEL, "p_name"), text("part", part, EX + "price", _dec("p_retailprice"), dt=_X("decimal")), text("part", part, EX + "brand", "p_brand"),
        node("part", part, EX + "relatedPart", _iri("part", "p_partkey + 1000000000"), "p_partkey % 50 = 0"), node("part", part, EX + "selfRef", part, "p_partkey % 100 = 0"),
        node("orders", order, v.TYPE, of("Order"), "o_orderkey % 501 <> 0"), node("orders", order, v.TYPE, of("Ordr"), "o_orderkey % 501 = 0"), text("orders", order, EX + "orderStatus", "o_orderstatus", dt=_X("boolean")), text("orders", order, EX + "orderedAt", stamp, dt=_X("dateTime")),
        text("orders", order, EX + "orderDay", day, "o_orderkey % 300 <> 0", _X("date")), text("orders", order, EX + "orderDay", f"concat({year}, '-02-30')", "o_orderkey % 300 = 0", _X("date")), text("orders", order, EX + "total", _dec("o_totalprice"), dt=_X("decimal")),
        node("orders", order, EX + "placedBy", _iri("customer", "o_custkey")), text("orders", order, EX + "legacyPriority", "o_orderpriority", "o_orderpriority = '1-URGENT'"), node("orders", _iri("customer", "o_custkey"), EX + "hasOrder", order),
        node("lineitem", line, v.TYPE, of("LineItem"), sk=BNODE), node("lineitem", line, EX + "ofOrder", _iri("order", "l_orderkey"), sk=BNODE), node("lineitem", line, EX + "soldBy", _iri("supplier", "l_suppkey"), sk=BNODE),
        text("lineitem", line, EX + "quantity", _dec("l_quantity"), dt=_X("decimal"), sk=BNODE), node("lineitem", _iri("supplier", "l_suppkey"), EX + "supplies", line, ok=BNODE),
        node("events", event, v.TYPE, f"concat('{EX}Event_', event_type)"), node("events", event, v.TYPE, of("Event_click"), "event_id % 500 = 0 and event_type <> 'click'"), node("events", event, v.TYPE, of("Event_error"), "event_id % 500 = 0 and event_type <> 'error'"),
        node("events", event, v.TYPE, of("Event_timeout"), "event_id % 700 = 0"), node("events", event, v.TYPE, of("Event_click"), "event_id % 700 = 0 and event_id % 500 <> 0 and event_type <> 'click'"),
        node("events", event, EX + "byUser", _iri("customer", "user_id")), text("events", event, EX + "eventValue", _dec("value"), dt=_X("decimal")), text("events", event, EX + "props", "props", dt=_X("integer")),
        node("documents", document, v.TYPE, of("Document")), said("documents", document, v.LABEL, "source", "lang"),
    ]


def _declared(name: str, kind: str, domain: str | None = None, range_: str | None = None) -> list[tuple]:
    label = [] if name == "legacyPriority" else [(EX + name, v.LABEL, name, None, "en")]
    return [(EX + name, v.TYPE, kind), *label, *([(EX + name, v.DOMAIN, domain)] if domain else []), *([(EX + name, v.RANGE, range_)] if range_ else [])]


def ontology() -> list[tuple]:
    """The schema, with a planted defect for each check that the tables don't already trip."""
    out = [("http://example.org/shop", v.TYPE, v.ONTOLOGY), (EX, v.TYPE, v.ONTOLOGY), ("https://example.org/good", v.TYPE, v.ONTOLOGY), ("https://example.org/good", v.VERSION_INFO, "1.0", None, None), ("https://example.org/good", v.VERSION_IRI, "http://example.org/good/1.0")]
    for c in ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "LineItem", "Document", "Party", "Place", "Event", "Event_signup", "Event_error", "Event_click", "Event_timeout", "Store"):
        out += [(EX + c, v.TYPE, v.CLASS), (EX + c, v.LABEL, c, None, "en")]
    out += [(EX + a, v.SUBCLASS, EX + b) for a, b in (("Customer", "Party"), ("Supplier", "Party"), ("Region", "Place"), ("Nation", "Place"), ("Event_signup", "Event"), ("Event_error", "Event"), ("Event_click", "Event"), ("Event_timeout", "Event_error"))]
    for name, kind, domain, range_ in (
        ("inRegion", v.OBJ_PROP, EX + "Nation", EX + "Region"), ("inNation", v.OBJ_PROP, EX + "Party", EX + "Nation"), ("regionPeer", v.OBJ_PROP, EX + "Nation", EX + "Nation"), ("accountBalance", v.DATA_PROP, EX + "Customer", v.XSD + "decimal"), ("segment", v.DATA_PROP, EX + "Customer", v.XSD + "string"),
        ("price", v.DATA_PROP, EX + "Part", v.XSD + "decimal"), ("brand", v.DATA_PROP, EX + "Part", v.XSD + "string"), ("relatedPart", v.OBJ_PROP, EX + "Part", EX + "Part"), ("selfRef", v.OBJ_PROP, EX + "Part", EX + "Part"), ("orderStatus", v.DATA_PROP, EX + "Order", v.XSD + "boolean"),
        ("orderedAt", v.DATA_PROP, EX + "Order", v.XSD + "dateTime"), ("orderDay", v.DATA_PROP, EX + "Order", v.XSD + "date"), ("total", v.DATA_PROP, EX + "Order", v.XSD + "decimal"), ("placedBy", v.OBJ_PROP, EX + "Order", EX + "Customer"), ("hasOrder", v.OBJ_PROP, EX + "Customer", EX + "Order"),
        ("legacyPriority", v.DATA_PROP, EX + "Order", v.XSD + "string"), ("ofOrder", v.OBJ_PROP, EX + "LineItem", EX + "Order"), ("soldBy", v.OBJ_PROP, EX + "LineItem", EX + "Store"), ("quantity", v.DATA_PROP, EX + "LineItem", v.XSD + "integer"), ("supplies", v.OBJ_PROP, EX + "Supplier", EX + "LineItem"),
        ("byUser", v.OBJ_PROP, EX + "Event", EX + "Customer"), ("props", v.DATA_PROP, EX + "Event", v.XSD + "string"), ("bareProperty", v.OBJ_PROP, None, None), ("strayDomain", v.OBJ_PROP, EX + "NoSuchClass", EX + "NoSuchRange"), ("knows", v.OBJ_PROP, EX + "Customer", EX + "Supplier"), ("partOf", v.OBJ_PROP, EX + "Nation", EX + "Region"),
        ("Upper_Property", v.DATA_PROP, EX + "Part", v.XSD + "string"), ("inverseA", v.OBJ_PROP, EX + "Part", EX + "Part"), ("inverseB", v.OBJ_PROP, EX + "Part", EX + "Part"), ("inverseC", v.OBJ_PROP, EX + "Part", EX + "Part"), ("buys", v.OBJ_PROP, EX + "Customer", EX + "Part"), ("Odd_Link", v.OBJ_PROP, EX + "Part", EX + "Part"),
    ):
        out += _declared(name, kind, domain, range_)
    out += [(EX + p, v.TYPE, v.OWL + k) for p, k in (("knows", "SymmetricProperty"), ("partOf", "TransitiveProperty"), ("hasOrder", "FunctionalProperty"), ("regionPeer", "AsymmetricProperty"), ("selfRef", "IrreflexiveProperty"))]
    out += [(EX + "inverseA", v.INVERSE, EX + "inverseB"), (EX + "inverseA", v.INVERSE, EX + "inverseC"), (EX + "partOf", v.INVERSE, EX + "partOf"), (EX + "legacyPriority", v.DEPRECATED, "true", v.XSD + "boolean", None), (EX + "buys", v.SUBPROP, EX + "knows")]
    out += [(EX + "Event_error", v.DISJOINT, EX + "Event_click"), (EX + "Customer", v.DISJOINT, EX + "Supplier")]
    # a chain of eight, a cycle of three, a class disjoint with its ancestor, a redundant equivalence
    out += [t for k in range(8) for t in ((EX + f"Chain{k}", v.TYPE, v.CLASS), (EX + f"Chain{k}", v.LABEL, f"Chain{k}", None, None))] + [(EX + f"Chain{k}", v.SUBCLASS, EX + f"Chain{k + 1}") for k in range(7)]
    out += [t for k in range(3) for t in ((EX + f"Cycle{k}", v.TYPE, v.CLASS), (EX + f"Cycle{k}", v.SUBCLASS, EX + f"Cycle{(k + 1) % 3}"))]
    out += [(EX + "Chain0", v.DISJOINT, EX + "Chain3"), (EX + "Chain1", v.EQUIV_CLASS, EX + "Chain2"), (EX + "lower-class", v.TYPE, v.CLASS), (EX + "snake_class", v.TYPE, v.CLASS), (EX + "snake_class", v.PREF_LABEL, "something else", None, "en"), (EX + "Part", v.PREF_LABEL, "part", None, "en")]
    return out


def literal_rows(rows: list[tuple]) -> str:
    """Inline triples as SQL values, for both engines."""
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    full = [(r[0], r[1], r[2], None, None, 0) if len(r) == 3 else (r[0], r[1], r[2], r[3] or (_LANG if r[4] else _STR), r[4], 2) for r in rows]
    return ", ".join(f"({q(s)}, 0, {q(p)}, {q(o)}, {k}, {q(dt)}, {q(lang)})" for s, p, o, dt, lang, k in full)


#: What tells the rows of a table apart.  Each rule has its subject or its object from it, in the same place for all rules
#: of one predicate, and no two tables give one predicate to subjects of one kind: where keys occur once, so do triples.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _days(True)], "events": ["event_id"], "documents": ["doc_id"]}
#: How the tables' subjects begin.
KINDS = (*(f"{EX}{kind}-" for kind in ("region", "nation", "customer", "supplier", "part", "order", "event", "document")), "_:li-")


class TableGraph(Graph):
    def __init__(self, spark: SparkSession, sf_dir: str, schema: list[tuple] | None = None):
        self.spark, self.dir = spark, sf_dir
        said = ontology() if schema is None else schema
        self.schema = from_tuples(spark, said)
        #: Whether a triple may be the schema's and a table's.
        self.mixed = any(t[0].startswith(KINDS) for t in said)
        self._unique: dict[str, bool] = {}
        self.rules = rules()
        forms = [(r[4], r[6], r[7], r[8]) for r in self.rules] + [(t[1], IRI, None, None) if len(t) == 3 else (t[1], LITERAL, t[3] or (_LANG if t[4] else _STR), t[4]) for t in said]
        self._names = sorted({f[0] for f in forms})
        one = {p: {f[1:] for f in forms if f[0] == p} for p in self._names}
        #: Nodes tell their kinds by themselves; a language may be a column.
        self.alike = frozenset(p for p, fs in one.items() if all(f[0] != LITERAL for f in fs) or (len(fs) == 1 and all(f[2] is None for f in fs)))
        self._tables: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def _frames(self, predicates: Sequence[str], objects: Sequence[str] | None = None, datatypes: Sequence[str] | None = None, graphs: Sequence[str] | None = None, once: bool = False) -> dict[str, DataFrame]:
        """The triples of each graph (a table, or the schema) that may have some; each once for a graph if asked."""
        wanted = lambda name: graphs is None or GRAPHS + name in graphs
        frames = {"schema": self.schema.filter(F.col("p").isin(*predicates)) if predicates else self.schema} if wanted("schema") else {}
        chosen = [r for r in self.rules if (not predicates or r[4] in predicates) and wanted(r[0])]
        if datatypes is not None:
            chosen = [r for r in chosen if r[7] in datatypes]
        if objects is not None:  # an object that is the same for every row
            chosen = [r for r in chosen if r[6] != LITERAL and (r[5][1:-1] in objects if re.fullmatch("'[^']*'", r[5]) else True)]
        for table in dict.fromkeys(r[0] for r in chosen):
            parts = []
            for _, where, s, sk, p, o, ok, dt, lang in (r for r in chosen if r[0] == table):
                row = f"named_struct('s', {s}, 'sk', {sk}, 'p', '{p}', 'o', {o}, 'ok', {ok}, 'dt', {f"'{dt}'" if dt else 'CAST(NULL AS STRING)'}, 'lang', {lang or 'CAST(NULL AS STRING)'})"
                parts.append(row if where == "true" else f"IF({where}, {row}, NULL)")
            one = self._table(table)
            if len(parts) == 1:
                found = one.select(F.expr(parts[0]).alias("t"))
            else:
                # rules of one predicate may say the same of a row
                several = once and len({r[4] for r in chosen if r[0] == table}) < len(parts)
                row = f"array({', '.join(parts)})"
                found = one.select(F.explode(F.expr(f"array_distinct({row})" if several else row)).alias("t"))
            frames[table] = found.filter("t is not null").select("t.*").filter("s is not null and o is not null")
        if once:
            frames = {name: t if name != "schema" and self._has_keys(name) else t.dropDuplicates(TRIPLE) for name, t in frames.items()}
        return frames

    def _has_keys(self, table: str) -> bool:
        """Whether no two rows share a key: as few bytes as tell so are dealt, hashes first, and the keys where two hashes
        are equal."""
        if table not in self._unique:
            keys = self._table(table).select(*(F.expr(k).alias(f"k{n}") for n, k in enumerate(KEYS[table]))).dropna()
            whole = all(t in ("tinyint", "smallint", "int", "bigint") for _, t in keys.dtypes)  # their text tells them apart
            twice = lambda df: not df.groupBy(*df.columns).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()
            self._unique[table] = whole and not (twice(keys.select(F.xxhash64(*keys.columns).alias("h"))) and twice(keys))
        return self._unique[table]

    def distinct(self, *predicates: str) -> DataFrame:
        if self.mixed:
            return super().distinct(*predicates)
        return union(list(self._frames(predicates, once=True).values()))

    def scan(self, *predicates: str, objects: Sequence[str] | None = None, datatypes: Sequence[str] | None = None) -> DataFrame:
        return narrowed(union(list(self._frames(predicates, objects, datatypes).values())), objects, datatypes)

    def dataset(self) -> Dataset:
        """The same triples with a named graph for each table and one for the schema."""

        def read(predicates: Sequence[str], graphs: Sequence[str] | None) -> DataFrame:
            frames = [t.withColumn("g", F.lit(GRAPHS + name)) for name, t in self._frames(predicates, graphs=graphs).items()]
            return union(frames) if frames else self.schema.filter("false").withColumn("g", F.lit(None).cast("string"))

        def once(predicates: Sequence[str]) -> DataFrame:
            return union([t.withColumn("g", F.lit(GRAPHS + name)) for name, t in self._frames(predicates, once=True).items()])

        return Dataset(self.spark, read, once)

    @property
    def triples(self) -> DataFrame:
        return self.scan()


def sql_view() -> str:
    """The same triples as a DuckDB CTE named T."""
    q = lambda x: f"'{x}'" if x else "CAST(NULL AS VARCHAR)"
    parts = [f"SELECT {s} AS s, {sk} AS sk, '{p}' AS p, {o} AS o, {ok} AS ok, {q(dt)} AS dt, {lang or 'CAST(NULL AS VARCHAR)'} AS lang FROM {table} WHERE {where} AND ({s}) IS NOT NULL AND ({o}) IS NOT NULL" for table, where, s, sk, p, o, ok, dt, lang in rules(spark=False)]
    parts.append(f"SELECT * FROM (VALUES {literal_rows(ontology())}) AS x(s, sk, p, o, ok, dt, lang)")
    return "T AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def sql_quads() -> str:
    """The same triples with their graph, as a DuckDB CTE named Q."""
    q = lambda x: f"'{x}'" if x else "CAST(NULL AS VARCHAR)"
    parts = [f"SELECT {s} AS s, {sk} AS sk, '{p}' AS p, {o} AS o, {ok} AS ok, {q(dt)} AS dt, {lang or 'CAST(NULL AS VARCHAR)'} AS lang, '{GRAPHS}{table}' AS g FROM {table} WHERE {where} AND ({s}) IS NOT NULL AND ({o}) IS NOT NULL" for table, where, s, sk, p, o, ok, dt, lang in rules(spark=False)]
    parts.append(f"SELECT *, '{GRAPHS}schema' FROM (VALUES {literal_rows(ontology())}) AS x(s, sk, p, o, ok, dt, lang)")
    return "Q AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


# --- baskets: the tables as RDF lists -----------------------------------------------------------------------------

ITEMS = EX + "items"
_NIL = v.RDF + "nil"
#: (subject, predicate, object, condition) over line items with k, their place in the order, and n, the order's size.
#: Planted: orders whose list runs in a circle, has no end, a cell without a member, or a cell with two rests.
_BASKET = [
    (f"concat('{EX}order-', CAST(l_orderkey AS STRING))", ITEMS, "concat('_:cell-', CAST(l_orderkey AS STRING), '-1')", "k = 1"),
    ("concat('_:cell-', CAST(l_orderkey AS STRING), '-', CAST(k AS STRING))", v.RDF + "first", f"concat('{EX}part-', CAST(l_partkey AS STRING))", "NOT (l_orderkey % 89 = 0 AND k = 2)"),
    ("concat('_:cell-', CAST(l_orderkey AS STRING), '-', CAST(k AS STRING))", v.RDF + "rest", f"CASE WHEN k < n THEN concat('_:cell-', CAST(l_orderkey AS STRING), '-', CAST(k + 1 AS STRING)) WHEN l_orderkey % 97 = 0 THEN concat('_:cell-', CAST(l_orderkey AS STRING), '-1') ELSE '{_NIL}' END", "k < n OR l_orderkey % 101 <> 0"),
    ("concat('_:cell-', CAST(l_orderkey AS STRING), '-', CAST(k AS STRING))", v.RDF + "rest", f"'{_NIL}'", "l_orderkey % 103 = 0 AND k = 1 AND n > 1"),
]
#: One list of all parts.
_CATALOGUE = [
    ("'_:cat-1'", "", f"'{EX}catalogue'"),
    ("concat('_:cat-', CAST(p_partkey AS STRING))", v.RDF + "first", f"concat('{EX}part-', CAST(p_partkey AS STRING))"),
    ("concat('_:cat-', CAST(p_partkey AS STRING))", v.RDF + "rest", f"CASE WHEN p_partkey < most THEN concat('_:cat-', CAST(p_partkey + 1 AS STRING)) ELSE '{_NIL}' END"),
]
_PLACED = "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {0}"
_KINDS = "CASE WHEN left(s, 2) = '_:' THEN 1 ELSE 0 END AS sk, p, o, CASE WHEN left(o, 2) = '_:' THEN 1 ELSE 0 END AS ok, CAST(NULL AS STRING) AS dt, CAST(NULL AS STRING) AS lang"


def _basket_query(lines: str, parts: str) -> str:
    rows = [f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM placed WHERE {where}" for s, p, o, where in _BASKET]
    rows.append(f"SELECT {_CATALOGUE[0][2]} AS s, '{ITEMS}' AS p, {_CATALOGUE[0][0]} AS o FROM most WHERE most IS NOT NULL")
    rows += [f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM {parts} CROSS JOIN most" for s, p, o in _CATALOGUE[1:]]
    return f"WITH placed AS ({_PLACED.format(lines)}), most AS (SELECT max(p_partkey) AS most FROM {parts}), made AS ({' UNION ALL '.join(rows)}) SELECT DISTINCT s, {_KINDS} FROM made"


def baskets(spark: SparkSession, sf_dir: str) -> Graph:
    """The parts of each order as an RDF list, and a list of all parts: triples of ex:items, rdf:first and rdf:rest.

    A row of a table makes all of its triples at once, so those of one list stand together.  Lines of one order differ in
    their place, so their triples are a set as they are; those without an order, and parts, are made distinct."""
    lines, parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    struct = lambda s, p, o, where="true": f"IF({where}, named_struct('s', {s}, 'p', '{p}', 'o', {o}), NULL)"
    made = lambda rows, rules: rows.select(F.expr(f"inline(filter(array({', '.join(struct(*r) for r in rules)}), t -> t is not null))"))

    def of(these: DataFrame) -> DataFrame:
        return made(spark.sql(_PLACED.format("{lines}"), lines=these), [(s, p, o, where) for s, p, o, where in _BASKET])

    keyed = of(lines.filter("l_orderkey is not null"))
    if lines.schema["l_orderkey"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        keyed = keyed.distinct()  # others' texts needn't tell them apart
    most = parts.agg(F.max("p_partkey").alias("most"))
    catalogue = made(parts.select("p_partkey").distinct().crossJoin(F.broadcast(most)), [(s, p, o) for s, p, o in _CATALOGUE[1:]]).distinct()
    head = made(most.filter("most is not null"), [(_CATALOGUE[0][2], ITEMS, _CATALOGUE[0][0])])
    rows = union([keyed, of(lines.filter("l_orderkey is null")).distinct(), catalogue, head])
    return Graph(spark.sql(f"SELECT s, {_KINDS} FROM {{made}}", made=rows), distinct=True)


def sql_baskets() -> str:
    """The same triples as a DuckDB CTE named B."""
    return f"B AS MATERIALIZED ({_basket_query('lineitem', 'part').replace('AS STRING', 'AS VARCHAR')})"
