"""The data model: quads and triples as flat columns, and graphs that are scanned by predicate.

A triple is s, sk, p, o, ok, dt, lang: subject and its kind, predicate, object with its kind, datatype and language.
Kinds: 0 IRI, 1 blank node (its id starts with ``_:``, so s and o alone tell nodes apart), 2 literal (with its lexical
form as written).  Two terms are equal if all of o, ok, dt and lang are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IRI, BNODE, LITERAL = 0, 1, 2
TRIPLE = ["s", "sk", "p", "o", "ok", "dt", "lang"]
TRIPLE_SCHEMA = "s string, sk int, p string, o string, ok int, dt string, lang string"
QUAD_SCHEMA = "doc string, seq long, " + TRIPLE_SCHEMA + ", g string"
FINDING = ["check_id", "category", "title", "severity", "focus_node", "path", "value", "message", "remediation", "sources"]
#: Predicates of a set that is pushed into scans; a larger set is joined.
PUSHED = 500
#: Rows that are broadcast; more are joined by a shuffle.
FEW = 200_000


def term_key(o: str = "o", ok: str = "ok", dt: str = "dt", lang: str = "lang") -> Column:
    """One column that is equal for equal terms."""
    return F.concat_ws("\u0000", F.col(ok).cast("string"), F.col(o), F.coalesce(dt, F.lit("")), F.coalesce(lang, F.lit("")))


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where it is counted to be small."""
    return F.broadcast(df) if df.count() <= FEW else df


class Graph:
    """A set of triples.  ``scan`` reads those of some predicates only, where the source can."""

    #: Whether scans give each triple once.
    once = False
    #: Predicates whose triples are alike but for subject and object, where the source tells: one kind, datatype, language.
    alike: frozenset[str] = frozenset()
    #: For a stored graph, what it was made from: there the triples of a row stand together.
    near: Graph | None = None

    def __init__(self, triples: DataFrame, distinct: bool = False):
        self.once = True
        self.spark = triples.sparkSession
        triples = triples.select(*TRIPLE)
        self.triples = triples if distinct else triples.dropDuplicates(TRIPLE)

    def scan(self, *predicates: str, objects: Sequence[str] | None = None, datatypes: Sequence[str] | None = None) -> DataFrame:
        """Triples of some predicates (all where none is given), with one of some nodes as object, or with a literal of
        one of some datatypes."""
        found = self.triples.filter(F.col("p").isin(*predicates)) if predicates else self.triples
        return narrowed(found, objects, datatypes)

    def distinct(self, *predicates: str) -> DataFrame:
        """Triples of some predicates (all where none is given), each once; a source that can tell so deals none for it."""
        found = self.scan(*predicates).select(*TRIPLE)
        return found if self.once else found.dropDuplicates(TRIPLE)

    def names(self) -> list[str] | None:
        """The predicates that it may have, where they are few."""
        if "_names" not in self.__dict__:
            found = [r[0] for r in self.scan().select("p").distinct().limit(PUSHED + 1).collect()]
            self._names = sorted(found) if len(found) <= PUSHED else None
        return self._names

    def closed(self, predicate: str) -> DataFrame:
        """x, y, hops: one or more steps of a predicate between nodes, worked out once for a graph."""
        from .operators.closure import closure, edges

        known = self.__dict__.setdefault("_closed", {})
        if predicate not in known:
            known[predicate] = closure(edges(self.scan(predicate)))
        return known[predicate]

    def scan_of(self, predicates: DataFrame) -> DataFrame:
        """Triples whose predicate is in a one-column frame p: pushed into the scan if few, else joined."""
        few = [r[0] for r in predicates.distinct().limit(PUSHED + 1).collect()]
        if len(few) <= PUSHED:
            return self.scan(*few) if few else self.scan("").filter("false")
        return self.scan().join(small(predicates.distinct()), "p", "left_semi")

    def typed(self, *classes: str) -> DataFrame:
        """s of the instances of some classes."""
        return self.scan("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", objects=classes or None).filter("ok = 0").select("s").distinct()

    def having(self, *predicates: str) -> DataFrame:
        return self.scan(*predicates).select("s").distinct()


class Dataset:
    """Named graphs.  ``read(predicates, graphs)`` gives quads (a triple and g) of some predicates and graphs, all where
    none is given; a source that keeps them apart reads those only.  ``once(predicates)`` gives the quads of some predicates,
    each once."""

    def __init__(self, spark: SparkSession, read: Callable[[Sequence[str], Sequence[str] | None], DataFrame], once: Callable[[Sequence[str]], DataFrame] | None = None):
        self.spark, self.read = spark, read
        self.once = once or (lambda predicates: read(predicates, None).select(*TRIPLE, "g").distinct())

    def graph(self, *names: str) -> Graph:
        """GRAPH <name>: the triples of one graph, or FROM <a> FROM <b>: their union."""
        return _Part(self, names)

    def default(self) -> Graph:
        """The union of all graphs."""
        return _Part(self, None)

    def each(self, *predicates: str) -> DataFrame:
        """GRAPH ?g: triples with their graph as a column."""
        return self.once(predicates).filter("g is not null").select(*TRIPLE, "g")

    def nowhere(self, nodes: DataFrame, *predicates: str) -> DataFrame:
        """NOT EXISTS { GRAPH ?g { ?s p ?o } }: nodes (column s) that no graph has as a subject of some predicates."""
        return nodes.join(self.each(*predicates).select("s").distinct(), "s", "left_anti")


class _Part(Graph):
    """The union of some graphs of a dataset, scanned through it."""

    def __init__(self, dataset: Dataset, names: Sequence[str] | None):
        self.spark, self.dataset, self.names = dataset.spark, dataset, names

    @property
    def triples(self) -> DataFrame:
        return self.scan()

    def scan(self, *predicates: str, objects: Sequence[str] | None = None, datatypes: Sequence[str] | None = None) -> DataFrame:
        # one graph is a set; several may say the same
        found = narrowed(self.dataset.read(predicates, self.names).select(*TRIPLE), objects, datatypes)
        return found if self.names is not None and len(self.names) == 1 else found.dropDuplicates(TRIPLE)


def narrowed(triples: DataFrame, objects: Sequence[str] | None, datatypes: Sequence[str] | None) -> DataFrame:
    if objects is not None:
        triples = triples.filter((F.col("ok") != LITERAL) & F.col("o").isin(*objects))
    if datatypes is not None:
        triples = triples.filter((F.col("ok") == LITERAL) & F.col("dt").isin(*datatypes))
    return triples


def union(frames: list[DataFrame]) -> DataFrame:
    """All frames, joined in pairs, so that the plan of many stays shallow."""
    while len(frames) > 1:
        frames = [a.unionByName(b[0], allowMissingColumns=True) if b else a for a, *b in (frames[i : i + 2] for i in range(0, len(frames), 2))]
    return frames[0]


def from_tuples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Triples from (s, p, o) with o an IRI, or (s, p, o, datatype, language) with o a literal; ``_:`` marks blank nodes."""
    kind = lambda x: BNODE if x.startswith("_:") else IRI
    full = [(r[0], kind(r[0]), r[1], r[2], kind(r[2]), None, None) if len(r) == 3 else (r[0], kind(r[0]), r[1], r[2], LITERAL, r[3] or ("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString" if r[4] else "http://www.w3.org/2001/XMLSchema#string"), r[4]) for r in rows]
    return inline(spark, full, TRIPLE_SCHEMA)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation, whose size the optimizer knows and which no Python worker reads."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(fields)}))
