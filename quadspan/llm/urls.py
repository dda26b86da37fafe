"""URL rules, and link-graph propagation for hosts that no rule settles.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest that
fits wins.  For the other urls the host decides: trust starts at hosts most of whose pages the rules allow and runs
along links (personalised PageRank); distrust starts at hosts most of whose pages the rules block and runs against
the links, since who links to a bad host is suspect.  A host is blocked if its distrust exceeds its trust and reaches
``share`` of what a blocked seed starts with.

All of it is DataFrame operations.  Scores are whole decimals of 24 digits, in parts (UNIT) of one seed's score however
many seeds there are, so sums don't depend on their order and reruns agree.  A link hands on the score times its part of its
host's links, in one division, so a hub of millions of links loses less than one part for each.  Trust and distrust are
compared as shares of all trusted and all blocked seeds.  Rounds end when no score moves by more than STILL of what a
verdict takes.  Links are distinct host pairs, weighted by the number of pages that have them, so the loop handles host
edges and never pages; every step is one join and one sum.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no rule, and is allowed; null html
has no links; repeated rows are judged each (and count each as pages of their host); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import narrow, written

#: (verdict, rule), a rule being host/path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UNIT = 10**12
#: Rounds go on while some score moves by more than one in so many parts of what a verdict takes.
STILL = 1000
#: Rounds of the SQL, which can't stop by itself: one seed's moves are below STILL by then.
SQL_ROUNDS = 64
#: Rounds of one plan; then the scores are written, so that a lost executor doesn't bring the rounds before back.
WRITTEN = 4
#: Percent of a score that goes on along links.
DAMPING = 85
#: A host is blocked from this part (one in SHARE) of a blocked seed's own score.
SHARE = 10
LINK = "(?i)href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null.  The rules are a parameter of bounded size."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


#: What a blocked seed starts with, and what a verdict takes.
BASE = UNIT * (100 - DAMPING) // 100
LEAST = BASE // SHARE
_SCORE = "decimal(24, 0)"


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seeds: kind, host; edges: kind, src, dst, n, total (dst gets n of total parts of what src hands on) -> kind, host,
    score."""
    base = seeds.select("kind", "host", F.lit(BASE).cast(_SCORE).alias("score"))
    if edges.isEmpty():
        return base
    # whole numbers: what doesn't divide is taken off first, so that the quotient is exact
    parts = edges.select("kind", "src", "dst", (F.col("n") * DAMPING).cast("decimal(13, 0)").alias("_n"), (F.col("total") * 100).cast("decimal(17, 0)").alias("_of"))
    given = F.col("score") * F.col("_n")
    given = ((given - given % F.col("_of")) / F.col("_of")).cast(_SCORE)
    base = rank = written(base, "host_seeds")
    while True:
        before = rank
        for _ in range(WRITTEN):
            moved = rank.join(parts, (rank["kind"] == parts["kind"]) & (rank["host"] == parts["src"])).select(rank["kind"], F.col("dst").alias("host"), given.alias("score"))
            rank = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").cast(_SCORE).alias("score"))
        rank = written(rank, "host_ranks")
        # scores only grow from round to round, so the last WRITTEN rounds' growth is a bound of each one's
        both = rank.unionByName(before.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("grown"))
        if both.filter(F.col("grown") * STILL > LEAST).isEmpty():
            return rank


def host_scores(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages: host, rule, html -> host, trust, distrust (in parts of one seed's score), blocked, for hosts that have a
    score."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("dst"))
    links = links.select(F.col("host").alias("src"), F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> dst and src <> ''")
    links = written(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "host_links")

    def shares(kind: str, src: str, dst: str) -> DataFrame:
        total = links.groupBy(src).agg(F.sum("n").alias("total")).withColumnRenamed(src, "_src")
        return links.join(total, F.col(src) == F.col("_src")).select(F.lit(kind).alias("kind"), F.col("_src").alias("src"), F.col(dst).alias("dst"), "n", "total")

    edges = written(shares("trust", "src", "dst").unionByName(shares("distrust", "dst", "src")), "host_shares")
    allow = [r for v, r in rules if v == "allow"]
    counts = pages.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("rule").isin(allow)).alias("good"), F.count_if(F.col("rule").isNotNull() & ~F.col("rule").isin(allow)).alias("bad"))
    kinds = counts.select("host", F.when(F.expr("2 * good > n"), "trust").when(F.expr("2 * bad > n"), "distrust").alias("kind")).filter("kind is not null")
    kinds = written(kinds, "host_kinds")
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).cast(_SCORE).alias(kind)
    scores = propagate(kinds, edges).groupBy("host").agg(score("trust"), score("distrust"))
    each = kinds.agg(*(F.greatest(F.count_if(F.col("kind") == k), F.lit(1)).cast("decimal(12, 0)").alias(f"_{k}") for k in ("trust", "distrust")))  # one row
    blocked = (F.col("distrust") >= LEAST) & (F.col("distrust") * F.col("_trust") > F.col("trust") * F.col("_distrust"))
    return scores.crossJoin(F.broadcast(each)).select("host", "trust", "distrust", blocked.alias("blocked"))


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust."""
    rows = pages.select(F.col(key), F.col(url).alias("_url"), F.col(html).alias("html")).withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).drop("_url")
    scores = host_scores(rows, rules)
    block = [r for v, r in rules if v == "block"]
    # one row for each host with a score, broadcast where they are few, so that pages of a frequent host stay where they lie
    out = rows.drop("html").join(narrow(written(scores, "host_scores")), "host", "left")
    verdict = F.when(F.col("rule").isin(block), "block").when(F.col("rule").isNotNull(), "allow").when(F.coalesce(F.col("blocked"), F.lit(False)), "block").otherwise("allow")
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), *(F.coalesce(k, F.lit(0)).cast(_SCORE).alias(k) for k in ("trust", "distrust")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    link = LINK.removeprefix("(?i)").replace("'", "''")
    rules = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))
    named = lambda v: ", ".join(f"'{r}'" for w, r in RULES if w == v)
    steps = [f"r0 AS (SELECT kind, host, CAST({BASE} AS HUGEINT) AS score FROM kinds)"]
    for k in range(SQL_ROUNDS):
        steps.append(f"r{k + 1} AS (SELECT kind, host, CAST(sum(score) AS HUGEINT) AS score FROM (SELECT * FROM r0 UNION ALL SELECT r.kind, e.dst, (r.score * e.n * {DAMPING}) // (e.total * 100) FROM r{k} r JOIN edges e ON r.kind = e.kind AND r.host = e.src) GROUP BY kind, host)")
    return f"""WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, html, coalesce({lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT *, CASE {rules} END AS rule FROM parsed),
found AS (SELECT host AS src, {lower.format("unnest(list_distinct(regexp_extract_all(html, '" + link + "', 1, 'i')))")} AS dst FROM parsed),
links AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> dst AND src <> '' GROUP BY src, dst),
edges AS (SELECT 'trust' AS kind, src, dst, n, CAST(sum(n) OVER (PARTITION BY src) AS HUGEINT) AS total FROM links
 UNION ALL SELECT 'distrust', dst, src, n, CAST(sum(n) OVER (PARTITION BY dst) AS HUGEINT) FROM links),
counts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE rule IN ({named("allow")})) AS good, count(*) FILTER (WHERE rule IN ({named("block")})) AS bad FROM ruled WHERE host <> '' GROUP BY host),
kinds AS (SELECT host, CASE WHEN 2 * good > n THEN 'trust' WHEN 2 * bad > n THEN 'distrust' END AS kind FROM counts WHERE 2 * good > n OR 2 * bad > n),
{", ".join(steps)},
scores AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM r{SQL_ROUNDS} GROUP BY host),
each AS (SELECT greatest(count(*) FILTER (WHERE kind = 'trust'), 1) AS nt, greatest(count(*) FILTER (WHERE kind = 'distrust'), 1) AS nd FROM kinds)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({named("block")}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN coalesce(distrust >= {LEAST} AND distrust * nt > trust * nd, false) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN scores USING (host) CROSS JOIN each"""


OP3_SQL = _sql()
