"""User shapes as data (2.10): shapes are rows, and all of them are evaluated together in a few passes.

A row is (shape, target_kind, target, grp, path, kind, value, negate).  target_kind: class (instances of target and its
subclasses), subjects or objects (of the predicate target), node.  kind is a constraint on the values of path:

- minCount, maxCount: value is a number; hasValue: one of the values is it;
- datatype, nodeKind (0 IRI, 1 blank node, 2 literal), pattern, in (values split at |), minLength, maxLength,
  minInclusive, maxInclusive (numbers), languageIn, class: every value fits;
- qualifiedMin, qualifiedMax: value is "number class", the values that are instances of it are counted;
- equals, disjoint: the values and those of the predicate ``value`` are the same, or meet nowhere;
- closed: the node has no predicate but the shape's paths, rdf:type and those of value (split at |).

Rows of a shape with the same grp are alternatives (sh:or): one of them has to hold; rows without a grp stand alone.
negate turns a row round (sh:not).

A value is judged where it is scanned, against the rows of its path, and only what it came to is kept: the numbers of its
path and of the rows that it fits.  These, and the marks that make a node a target, are dealt once, by node; a node's
different outcomes are counted there, and its shapes' rows are held against the counts.  Only values of paths that class
or qualified rows ask for meet the instances, and only those that equals or disjoint rows speak of meet each other.
Closed shapes look up the triples of their own nodes, which are broadcast where they are counted to be few.  Shape rows
are a parameter like a rule file, and are broadcast where they are counted to be few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..model import LITERAL, PUSHED, TRIPLE, Graph, small, union
from ..operators.closure import closure
from ..storage import Scratch

c, lit = F.col, F.lit
SHAPE = "shape string, target_kind string, target string, grp string, path string, kind string, value string, negate boolean"
FEW = 10_000
_IDS = "array<long>"


def _below(g: Graph, classes: DataFrame) -> DataFrame:
    """x, class: classes (column class) with themselves and their subclasses."""
    sub = g.scan(v.SUBCLASS).filter("ok <> 2").select(c("s").alias("x"), c("o").alias("y"))
    return closure(sub).select("x", c("y").alias("class")).join(classes, "class", "left_semi").unionByName(classes.select(c("class").alias("x"), "class")).distinct()


def _typed(g: Graph, found: DataFrame, out: str) -> DataFrame:
    """s, out: what found (x, out: a list) has for each type of a node; a row for each."""
    types = g.scan(v.TYPE).filter("ok <> 2").select("s", c("o").alias("x"))
    return types.join(small(found), "x").select("s", out)


def _marked(g: Graph, rows: DataFrame, below: DataFrame) -> DataFrame:
    """s, marks: numbers of the shapes whose target a node is, but for targets that are subjects; nodes may occur again."""
    said = rows.select("shape_id", "target_kind", "target").distinct()
    of = lambda kind: said.filter(c("target_kind") == kind).select("shape_id", c("target").alias("p"))
    classes = below.join(of("class").withColumnRenamed("p", "class"), "class").groupBy("x").agg(F.collect_set("shape_id").alias("marks"))
    ends = g.scan_of(of("objects").select("p")).filter("ok <> 2").select("p", c("o").alias("s")).distinct()
    objects = ends.join(F.broadcast(of("objects").groupBy("p").agg(F.collect_set("shape_id").alias("marks"))), "p")
    return _typed(g, classes, "marks").unionByName(objects.select("s", "marks")).unionByName(of("node").select(c("p").alias("s"), F.array("shape_id").alias("marks")))


def _fits(row: Column) -> Column:
    """Whether a value fits a row; null where the kind only counts."""
    value, number = row["value"], c("o").try_cast("decimal(24,6)")
    limit, listed = value.try_cast("decimal(24,6)"), F.split(value, "\\|")
    is_a, also = F.coalesce(F.array_contains("classes", row["needs"]), lit(False)), F.coalesce(F.array_contains("also", value), lit(False))
    tests = {
        "datatype": c("dt").eqNullSafe(value),
        "nodeKind": c("ok").cast("string") == value,
        "pattern": F.rlike("o", value),
        "in": F.array_contains(listed, c("o")),
        "minLength": F.char_length("o") >= value.try_cast("int"),
        "maxLength": F.char_length("o") <= value.try_cast("int"),
        "minInclusive": F.coalesce(number >= limit, lit(False)),
        "maxInclusive": F.coalesce(number <= limit, lit(False)),
        "languageIn": F.coalesce(F.array_contains(listed, c("lang")), lit(False)),
        "hasValue": c("o") == value,
        "class": is_a,
        "qualifiedMin": is_a,
        "qualifiedMax": is_a,
        "equals": also,
        "disjoint": ~also,
    }
    out = None
    for kind, test in tests.items():
        out = F.when(row["kind"] == kind, test) if out is None else out.when(row["kind"] == kind, test)
    return out


def _each(g: Graph, predicates: DataFrame) -> DataFrame:
    """The triples of predicates (column p), each once."""
    names = [r[0] for r in predicates.limit(PUSHED + 1).collect()]
    if len(names) > PUSHED:
        found = g.scan_of(predicates)
        found = found if g.once else found.dropDuplicates(TRIPLE)
    else:
        found = g.distinct(*names) if names else g.scan("").filter("false")
    return found.select("s", "p", "o", "ok", "dt", "lang")


def validate(g: Graph, shapes: DataFrame) -> DataFrame:
    """shape, focus_node, path, broken (the kinds of the rows, all of whose alternatives fail), values (of the first)."""
    tables = Scratch(g.spark)
    rows = tables.put(shapes.coalesce(1).withColumn("id", F.monotonically_increasing_id()), "shapes")
    few = rows.count() <= FEW
    near = F.broadcast if few else (lambda df: df)
    # numbers stand for shapes and predicates
    names = tables.put(rows.select("shape").distinct().coalesce(1).withColumn("shape_id", F.monotonically_increasing_id()), "shape_names")
    needs = F.when(c("kind") == "class", c("value")).when(c("kind").startswith("qualified"), F.split("value", " ")[1])
    compares = F.when(c("kind").isin("equals", "disjoint"), c("value"))
    rows = rows.join(F.broadcast(names), "shape").withColumn("needs", needs).withColumn("compares", compares)
    judged = rows.filter("kind <> 'closed'")
    subjects = rows.filter("target_kind = 'subjects'").groupBy(c("target").alias("p")).agg(F.collect_set("shape_id").alias("marks"))
    of_path = judged.filter("path is not null").groupBy(c("path").alias("p")).agg(F.collect_list(F.struct("id", "kind", "value", "needs")).alias("rows"), F.max(c("needs").isNotNull()).alias("asks"), F.max(c("compares").isNotNull()).alias("meets"))
    used = judged.select(c("path").alias("p")).union(rows.select("compares")).union(subjects.select("p")).filter("p is not null").distinct()
    used = used.join(of_path, "p", "left").join(subjects, "p", "left").coalesce(1).withColumn("pid", F.monotonically_increasing_id())
    used = tables.put(used.fillna(False, ["asks", "meets"]), "predicates")
    classes = rows.select(c("needs").alias("class")).union(rows.filter("target_kind = 'class'").select("target")).filter("class is not null").distinct()
    below = tables.put(_below(g, classes), "classes")

    asked = below.join(rows.select(c("needs").alias("class")).distinct(), "class", "left_semi").groupBy("x").agg(F.collect_set("class").alias("classes"))
    members = _typed(g, asked, "classes").select(c("s").alias("o"), "classes").groupBy("o").agg(F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"))
    compared = _each(g, rows.select(c("compares").alias("p")).filter("p is not null").distinct()).groupBy("s", "o", "ok").agg(F.collect_set("p").alias("also"))

    def judge(asks: bool, meets: bool) -> DataFrame:
        """s, pid, good, marks: what the values of some paths came to."""
        these = used.filter((c("asks") == asks) & (c("meets") == meets))
        found, none = _each(g, these.select("p")), lit(None).cast("array<string>")
        found = found.join(compared, ["s", "o", "ok"], "left") if meets else found.withColumn("also", none)
        found = found.join(members, "o", "left").withColumn("classes", F.when(c("ok") != LITERAL, c("classes"))) if asks else found.withColumn("classes", none)
        good = F.transform(F.filter("rows", _fits), lambda r: r["id"])
        return found.join(near(these.select("p", "pid", "rows", "marks")), "p").select("s", "pid", good.alias("good"), "marks")

    outcomes = union([judge(asks, meets) for asks in (False, True) for meets in (False, True)])
    marked = _marked(g, rows, below).select("s", lit(None).cast("long").alias("pid"), lit(None).cast(_IDS).alias("good"), "marks")
    dealt = outcomes.unionByName(marked).repartition("s")
    # from here on all of a node is in one task: its list has an entry for each different outcome, not for each value
    counted = dealt.groupBy("s", "pid", "good", "marks").agg(F.count("*").alias("n"))
    nodes = counted.groupBy("s").agg(F.array_distinct(F.flatten(F.collect_set("marks"))).alias("shapes"), F.collect_list(F.struct("pid", "good", "n")).alias("seen")).filter("size(shapes) > 0")
    ids = used.select("p", "pid")
    held = judged.join(F.broadcast(ids.toDF("path", "path_id")), "path", "left").join(F.broadcast(ids.toDF("compares", "other_id")), "compares", "left").drop("target_kind", "target", "needs", "compares")
    total = lambda fits: F.aggregate(F.filter("seen", fits), lit(0).cast("long"), lambda sum_, x: sum_ + x["n"])
    per_row = nodes.select("s", F.explode("shapes").alias("shape_id"), "seen").join(near(held), "shape_id")
    per_row = per_row.withColumn("n", total(lambda x: x["pid"] == c("path_id"))).withColumn("good", total(lambda x: F.array_contains(x["good"], c("id")))).withColumn("others", total(lambda x: x["pid"] == c("other_id")))
    k = F.expr("try_cast(split(value, ' ')[0] AS long)")
    holds = (
        F.when(c("kind") == "minCount", c("n") >= k).when(c("kind") == "maxCount", c("n") <= k).when(c("kind") == "qualifiedMin", c("good") >= k).when(c("kind") == "qualifiedMax", c("good") <= k)
        .when(c("kind") == "hasValue", c("good") > 0).when(c("kind") == "equals", (c("good") == c("n")) & (c("n") == c("others"))).otherwise(c("good") == c("n"))
    )
    per_row = per_row.withColumn("holds", F.when(c("negate"), ~holds).otherwise(holds)).select("s", "shape", "path", "kind", "n", "holds", F.coalesce(F.concat(lit("g"), "grp"), F.concat(lit("r"), "id")).alias("of"))
    broken = per_row.groupBy("s", "shape", "of").agg(F.bool_or("holds").alias("holds"), F.min("path").alias("path"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("broken"), F.min("n").alias("values")).filter("not holds")
    broken = broken.select("shape", c("s").alias("focus_node"), "path", "broken", "values")
    # closed shapes: any other predicate of the nodes
    shut = rows.filter("kind = 'closed'").select("shape", F.explode(F.split(F.coalesce("value", lit("")), "\\|")).alias("p"))
    closed = rows.join(shut.select("shape").distinct(), "shape", "left_semi")
    allowed = shut.unionByName(closed.filter("path is not null").select("shape", c("path").alias("p"))).unionByName(shut.select("shape", lit(v.TYPE).alias("p"))).distinct()
    targets = closed.filter("target_kind = 'subjects'").select("shape_id", c("target").alias("p")).distinct()
    targets = g.scan_of(targets.select("p")).select("s", "p").join(near(targets), "p").select("s", "shape_id")
    targets = _marked(g, closed, below).select("s", F.explode("marks").alias("shape_id")).unionByName(targets).distinct()
    targets = tables.put(targets.join(F.broadcast(names), "shape_id").select("s", "shape"), "closed")
    if targets.isEmpty():
        return broken
    strange = g.scan().join(small(targets), "s").join(near(allowed), ["shape", "p"], "left_anti")
    strange = strange if g.once else strange.dropDuplicates(["shape", *TRIPLE])
    strange = strange.groupBy("shape", "s", "p").agg(F.count("*").alias("values"))
    return broken.unionByName(strange.select("shape", c("s").alias("focus_node"), c("p").alias("path"), lit("closed").alias("broken"), "values"))
