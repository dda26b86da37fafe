"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target size by its weight, stopped at ``most`` times its size.  Each of its documents is wanted
r = target / size times: floor(r) whole copies are certain, and the rest of the target is filled by one further copy
of some documents.  These are drawn by Pareto order sampling: document i with inclusion odds p / (1 - p) gets the rank
(U / (1 - U)) / (p / (1 - p)) from a uniform U of its own, and the documents of the smallest ranks are taken up to the
size that is left.

Inclusion is unequal: p is in proportion to a document's propensity, by default the binary order of its size, so longer
documents are likelier to get the further copy.  Where that makes p one or more, the copy is certain, and what is left is
shared by the others in proportion.  Propensities are rounded to quarters of a power of two, so a source has a few hundred
different ones at most, and the factor follows from their sums.

Ranks are compared as integers.  The cut is found without sorting a source: sizes are summed over 4096 ranges of the
rank for each source, then over 4096 ranges within the one that holds the cut; only what remains in that range is
ordered.  So no task gets a whole source, however large.

Defined cases: null or empty texts have size 0 and are taken 0 words; null sources are a source of their own, the
last; rows are told apart by a hash of all their columns, so rows of one id, or without one, each have a rank of their
own; rows that are equal in every column are counted, and each of the n has a rank from the hash and its number, so that
they are drawn one by one (which of them is taken makes no difference); an empty table gives an empty result; other columns
stay where the operator returns documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import narrow, row_hash, written

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
BITS = 12
#: Equal rows, or copies of one, that are made from one row of a plan.
RUN = 1024


def words_of(text: str = "text") -> Column:
    """The number of words, without the memory of an array of them."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> target: the share of each weight, stopped at ``most`` times the size, with the excess
    reshared by weight.  With sources ordered by the share at which they stop, all up to some place stop and the
    others share what is left.  One row for each source is ordered in one task."""
    every, order = Window.partitionBy(), F.array(*map(F.lit, weights))
    s = sizes.withColumn("_w", F.element_at(order, ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("_stop", most * F.col("source_size")).withColumn("_total", F.sum("source_size").over(every)).withColumn("_ratio", F.col("_stop") / F.col("_w"))
    upto = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_stop").over(upto), F.lit(0))).withColumn("_weight", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
    # the share for each weight, at the first source that it doesn't stop
    s = s.withColumn("_share", F.min(F.when(F.col("_left") / F.col("_weight") <= F.col("_ratio"), F.struct("_ratio", F.col("source").isNull().alias("n"), "source", (F.col("_left") / F.col("_weight")).alias("share")))).over(every)["share"])
    return s.select("source", "source_size", F.when(F.col("_ratio") <= F.col("_share"), F.col("_stop").cast("double")).otherwise(F.coalesce(F.col("_share") * F.col("_w"), F.col("_stop").cast("double"))).alias("target"))


def _cut(rows: DataFrame, keys: list[str], bin: Column, need: str) -> tuple[DataFrame, DataFrame]:
    """rows whose bin lies wholly below the cut, and those of the bin that holds it with what they still need."""
    binned = rows.withColumn("_bin", bin)
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("size").alias("_sum"), F.first(need).alias("_need"))
    sums = sums.withColumn("_upto", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bin")))
    at = sums.withColumn("_at", F.min(F.when(F.col("_upto") > F.col("_need"), F.col("_bin"))).over(Window.partitionBy(*keys)))
    at = at.filter(F.col("_bin") == F.col("_at")).select(*keys, "_at", (F.col("_need") - F.col("_upto") + F.col("_sum")).alias("_still"))
    return binned, at


def inclusion(live: DataFrame) -> DataFrame:
    """_s, e, p, _need from the rows' _s, e, size, _need: of each propensity of a source its inclusion probability, and what
    is left of the need behind the certain ones."""
    sums = live.groupBy("_s", "e").agg(F.sum("size").alias("z"), F.first("_need").alias("_need"))
    larger = Window.partitionBy("_s").orderBy(F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("_s").orderBy(F.desc("e")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sums = sums.withColumn("_before", F.coalesce(F.sum("z").over(larger), F.lit(0))).withColumn("_factor", (F.col("_need") - F.col("_before")) / F.sum(F.col("e") * F.col("z")).over(rest))
    fits = F.when(F.col("_factor") * F.col("e") < 1, F.struct(F.col("e").alias("top"), "_factor", (F.col("_need") - F.col("_before")).alias("left")))
    chosen = F.max(fits).over(Window.partitionBy("_s"))
    sums = sums.withColumn("_chosen", chosen)
    certain = F.col("_chosen").isNull() | (F.col("e") > F.col("_chosen.top"))
    return sums.select("_s", "e", F.when(certain, F.lit(1.0)).otherwise(F.col("_chosen._factor") * F.col("e")).alias("p"), F.coalesce("_chosen.left", F.lit(0)).alias("_left"))


def _numbered(groups: DataFrame, count: str, number: str) -> DataFrame:
    """Each row ``count`` times, with numbers from 0.  Large counts are first cut into runs, which are dealt out."""
    few = groups.filter(F.col(count) <= RUN).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    runs = groups.filter(F.col(count) > RUN).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {RUN}"))))
    runs = runs.repartition("row", "_run")
    many = runs.withColumn(number, F.explode(F.sequence(F.col("_run") * RUN, F.least((F.col("_run") + 1) * RUN, F.col(count)) - 1)))
    return few.unionByName(many.drop("_run"))


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, propensity: Column | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target, copies for every row, with p, the probability of the last copy, and row, the
    hash of the row."""
    wanted = (propensity if propensity is not None else F.log2(size + 1)).cast("double")
    quarters = F.pow(F.lit(2.0), F.round(4 * F.log2(F.greatest(wanted, F.lit(1e-9)))) / 4)
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size"), quarters.alias("e"), row_hash(docs).alias("row"))
    # written, since Spark would read the texts once for the few and once for the many
    rows = _numbered(written(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), "mix_groups"), "_n", "nth").drop("_n")
    again = F.when(F.col("nth") > 0, F.col("nth").cast("string"))
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("row").cast("string"), again, F.lit(seed))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = written(rows.withColumn("u", u), "mix_rows")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    plan = plan.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))).drop("source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("_whole", F.floor(ratio)).withColumn("_need", F.round(F.col("target") - F.floor(ratio) * F.col("source_size")).cast("long"))
    # one row for each source; written, so that Spark knows the size and broadcasts it only where it is small
    plan = written(plan, "mix_plan")
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))).join(plan, "_s")
    # a few rows for each source
    odds_of = written(inclusion(rows.filter((F.col("_need") > 0) & (F.col("size") > 0)).select("_s", "e", "size", "_need")), "mix_odds")
    rows = rows.join(odds_of, ["_s", "e"], "left").withColumn("p", F.when((F.col("_need") > 0) & (F.col("size") > 0), F.col("p")).otherwise(F.lit(0.0)))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.greatest(F.col("p"), F.lit(1e-12)) / (1 - F.col("p")))
    # the rank as an integer of 48 bits, of the odds' own probability scale
    rows = rows.withColumn("rank", F.when(F.col("p") < 1, F.floor(odds / (1 + odds) * F.lit(float(1 << 48))).cast("long")))
    live = rows.filter((F.col("p") > 0) & (F.col("p") < 1)).select("_s", "row", "nth", "size", "rank", "_left")
    first, at1 = _cut(live, ["_s"], F.shiftright("rank", 36), "_left")
    at1 = written(at1, "mix_cut1")
    mid = first.join(at1, "_s").filter(F.col("_bin") == F.col("_at")).drop("_bin", "_at", "_left")
    second, at2 = _cut(mid, ["_s"], F.shiftright("rank", 24) % (1 << BITS), "_still")
    at2 = written(at2, "mix_cut2")
    last = second.drop("_still").join(at2, "_s").filter(F.col("_bin") == F.col("_at"))
    # within the last range: whichever end of the document at the cut lies nearer
    upto = F.sum("size").over(Window.partitionBy("_s").orderBy("rank", "row", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    exact = last.withColumn("_upto", upto).filter(F.col("_upto") - F.col("size") / 2 <= F.col("_still"))
    exact = exact.groupBy("_s").agg(F.max(F.struct("rank", "row", "nth")).alias("_last"))
    cuts = plan.select("_s").join(at1.select("_s", F.col("_at").alias("_bin1")), "_s", "left").join(at2.select("_s", F.col("_at").alias("_bin2")), "_s", "left").join(exact, "_s", "left")
    rows = rows.join(written(cuts, "mix_cuts"), "_s")
    bin1, bin2, at = F.shiftright("rank", 36), F.shiftright("rank", 24) % (1 << BITS), F.struct("rank", "row", "nth")
    below = F.col("_bin1").isNull() | (bin1 < F.col("_bin1")) | ((bin1 == F.col("_bin1")) & (F.col("_bin2").isNull() | (bin2 < F.col("_bin2")) | ((bin2 == F.col("_bin2")) & F.col("_last").isNotNull() & (at <= F.col("_last")))))
    extra = F.when(F.col("p") >= 1, 1).when((F.col("p") > 0) & below, 1).otherwise(0)
    return rows.select(F.col("id").alias(key), "source", "size", "source_size", "target", (F.col("_whole") + extra).cast("long").alias("copies"), "p", "row")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, words_of()).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns that they had."""
    copies = mix(docs, words_of(text), weights, most, seed, None, key, source)
    # equal rows are drawn one by one; their copies are added up, and made from one of them
    copies = written(copies.groupBy("row", F.col(key).alias("id")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).filter("copies > 0"), "mix_copies")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), row_hash(docs).alias("row"), docs[key].alias("id"))

    def of(which: str) -> DataFrame:
        at = narrow(copies.filter(which).select(F.col("row").alias("_row"), F.col("id").alias("_id"), "copies"))
        return rows.join(at, (rows["row"] == F.col("_row")) & rows["id"].eqNullSafe(F.col("_id")))

    single = of("n = 1").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
    repeated = of("n > 1").groupBy("row", "id").agg(F.first("_doc").alias("_doc"), F.first("copies").alias("copies"))
    return single.unionByName(_numbered(repeated, "copies", "_nth").select("_doc.*"))
