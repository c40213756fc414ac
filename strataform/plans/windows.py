"""Ranks, percentiles, classes, dominant rows and comparisons of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataform.functions.rounding import dec, half_even
from strataform.operators import ranking as R
from strataform.plans.registry import query, table
from strataform.plans.scoring import CANDIDATES_SQL, candidates

_W = "zoning * CAST({} AS DECIMAL(3,2)) + road * CAST({} AS DECIMAL(3,2)) + equity * CAST({} AS DECIMAL(3,2)) + demand * CAST({} AS DECIMAL(3,2))"
PROFILES = {"base": ("0.35", "0.25", "0.25", "0.15"), "equity": ("0.10", "0.20", "0.50", "0.20"), "access": ("0.20", "0.50", "0.15", "0.15")}
_SCORED = f"WITH c AS ({CANDIDATES_SQL}), s AS (SELECT candidate_key, " + ", ".join(f"round_even({_W.format(*w)}, 4) AS {k}" for k, w in PROFILES.items()) + " FROM c)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    def composite(w):
        return half_even(sum((F.col(k) * F.lit(x).cast("decimal(3,2)") for k, x in zip(("zoning", "road", "equity", "demand"), w)), F.lit(0).cast("decimal(3,2)")), 4, 9)

    return candidates(spark, sf_dir).select("candidate_key", *[composite(w).alias(k) for k, w in PROFILES.items()])


@query("ranked_candidates", _SCORED + " SELECT candidate_key, CAST(base AS DOUBLE) AS base, row_number() OVER (ORDER BY base DESC, candidate_key) AS rank, count(*) OVER () AS population FROM s")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_all(scored(spark, sf_dir), "base", "candidate_key").select("candidate_key", F.col("base").cast("double").alias("base"), "rank", "population")


@query("point_rank_equivalence", _SCORED + ", p AS (SELECT candidate_key AS k, base AS v FROM s WHERE candidate_key IN (7, 77)) SELECT k AS candidate_key, 1 + (SELECT count(*) FROM s WHERE base > v OR (base = v AND candidate_key < k)) AS rank FROM p")
def point_rank_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of single rows by counting who comes before, without ordering anything."""
    s = scored(spark, sf_dir)
    p = s.where("candidate_key IN (7, 77)").select(F.col("candidate_key").alias("k"), F.col("base").alias("v"))
    ahead = (F.col("base") > F.col("v")) | ((F.col("base") == F.col("v")) & (F.col("candidate_key") < F.col("k")))
    return s.join(F.broadcast(p), ahead | (F.col("candidate_key") == F.col("k"))).groupBy(F.col("k").alias("candidate_key")).agg(F.count(F.lit(1)).alias("rank"))


@query("percentile_scores", "SELECT n_nationkey, round_even(CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE percent_rank() OVER (ORDER BY v) END, 6) AS percentile FROM (SELECT s_nationkey AS n_nationkey, count(*) AS v FROM supplier GROUP BY 1)")
def percentile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("v"))
    return R.percentile_rank(v, "v").select("n_nationkey", F.col("percentile").cast("double").alias("percentile"))


_TOP = ", ".join(f"row_number() OVER (ORDER BY {k} DESC, candidate_key) <= greatest(1, ceil(count(*) OVER () * 0.10)) AS in_{k}" for k in PROFILES)


@query("top_fraction_stability", _SCORED + f", m AS (SELECT candidate_key, {_TOP} FROM s) SELECT *, CAST(in_base AS INT) + CAST(in_equity AS INT) + CAST(in_access AS INT) AS n_profiles, CASE CAST(in_base AS INT) + CAST(in_equity AS INT) + CAST(in_access AS INT) WHEN 3 THEN 'STABLE' WHEN 2 THEN 'MOSTLY' WHEN 1 THEN 'SENSITIVE' ELSE 'NONE' END AS stability FROM m")
def top_fraction_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    out = s.select("candidate_key")
    for k in PROFILES:
        r = R.rank_all(s.select("candidate_key", k), k, "candidate_key")
        out = out.join(r.select("candidate_key", R.top_fraction(F.col("rank"), F.col("population")).alias(f"in_{k}")), "candidate_key")
    n = sum((F.col(f"in_{k}").cast("int") for k in PROFILES), F.lit(0))
    return out.withColumn("n_profiles", n).withColumn("stability", F.when(F.col("n_profiles") == 3, "STABLE").when(F.col("n_profiles") == 2, "MOSTLY").when(F.col("n_profiles") == 1, "SENSITIVE").otherwise("NONE"))


@query("stable_top10", _SCORED + " SELECT candidate_key, CAST(base AS DOUBLE) AS base FROM s ORDER BY s.base DESC, candidate_key LIMIT 10")
def stable_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).orderBy(F.desc("base"), "candidate_key").limit(10).select("candidate_key", F.col("base").cast("double").alias("base"))


@query("distinct_on_first", "SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber")
def distinct_on_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("l_orderkey", "l_linenumber")).alias("f")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(first).select("l_partkey", "f.l_orderkey", "f.l_linenumber")


@query("dominant_class", "SELECT s AS l_suppkey, f AS l_returnflag, CAST(q AS DOUBLE) AS area FROM (SELECT l_suppkey AS s, l_returnflag AS f, sum(CAST(l_quantity AS DECIMAL(20,2))) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(CAST(l_quantity AS DECIMAL(20,2))) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1")
def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest class of each cell, smallest code first among equals; one aggregate, no window."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(dec(F.col("l_quantity"), 20, 2)).alias("q"))
    best = a.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("q")).alias("neg"), "l_returnflag")).alias("m"))
    return best.select("l_suppkey", "m.l_returnflag", (-F.col("m.neg")).cast("double").alias("area"))


@query("region_high_low_topn", "WITH v AS (SELECT n_regionkey, n_nationkey, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY c DESC, n_nationkey) AS hi, row_number() OVER (PARTITION BY n_regionkey ORDER BY c, n_nationkey) AS lo, count(*) FILTER (WHERE c = 0) OVER (PARTITION BY n_regionkey) AS excluded FROM v WHERE c >= 0) SELECT n_regionkey, n_nationkey, c AS suppliers, hi <= 2 AS in_high, lo <= 2 AS in_low, excluded FROM r WHERE hi <= 2 OR lo <= 2")
def region_high_low_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    v = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("s_suppkey").alias("suppliers"))
    w = Window.partitionBy("n_regionkey")
    hi = F.row_number().over(w.orderBy(F.desc("suppliers"), "n_nationkey"))
    lo = F.row_number().over(w.orderBy("suppliers", "n_nationkey"))
    out = v.select("*", (hi <= 2).alias("in_high"), (lo <= 2).alias("in_low"), F.count_if(F.col("suppliers") == 0).over(w).alias("excluded"))
    return out.where("in_high OR in_low")


@query("grade_bands", "WITH v AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1), t AS (SELECT quantile_disc(c, 0.75) AS p75, quantile_disc(c, 0.25) AS p25, count(*) AS n FROM v) SELECT s_nationkey, c AS suppliers, CASE WHEN n < 4 THEN NULL WHEN c >= p75 THEN 'A' WHEN c >= p25 THEN 'B' ELSE 'C' END AS grade FROM v, t")
def grade_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A, B and C by the nearest-rank quartiles; no grades under four values."""
    v = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    t = v.agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY suppliers)").alias("p75"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY suppliers)").alias("p25"), F.count(F.lit(1)).alias("n"))
    c = F.col("suppliers")
    return v.crossJoin(F.broadcast(t)).select("s_nationkey", "suppliers", F.when(F.col("n") >= 4, F.when(c >= F.col("p75"), "A").when(c >= F.col("p25"), "B").otherwise("C")).alias("grade"))


@query("grade_distribution", "WITH v AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1), t AS (SELECT quantile_disc(c, 0.75) AS p75, quantile_disc(c, 0.25) AS p25 FROM v) SELECT CASE WHEN c >= p75 THEN 'A' WHEN c >= p25 THEN 'B' ELSE 'C' END AS grade, count(*) AS n FROM v, t GROUP BY 1")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_bands(spark, sf_dir).where("grade IS NOT NULL").groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


_AB = _SCORED + ", a AS (SELECT candidate_key, row_number() OVER (ORDER BY base DESC, candidate_key) AS rank FROM s), b AS (SELECT candidate_key, row_number() OVER (ORDER BY equity DESC, candidate_key) AS rank FROM s), d AS (SELECT coalesce(x.candidate_key, y.candidate_key) AS candidate_key, x.rank AS rank_a, y.rank AS rank_b, y.rank - x.rank AS delta, abs(y.rank - x.rank) AS movement FROM (SELECT * FROM a WHERE rank <= 50) x FULL JOIN (SELECT * FROM b WHERE rank <= 50) y ON x.candidate_key = y.candidate_key)"


def _ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    a, b = (s.orderBy(F.desc(k), "candidate_key").limit(50).select("candidate_key", F.row_number().over(Window.orderBy(F.desc(k), "candidate_key")).cast("long").alias("rank")) for k in ("base", "equity"))
    return R.rank_diff(a, b, "candidate_key", 50)


@query("ab_rank_diff", _AB + " SELECT *, CASE WHEN delta < 0 THEN 'rose' WHEN delta > 0 THEN 'fell' WHEN delta = 0 THEN 'held' WHEN rank_a IS NULL THEN 'entered' ELSE 'left' END AS direction FROM d")
def ab_rank_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ab(spark, sf_dir)


@query("topn_retention", _AB + " SELECT count(*) FILTER (WHERE delta IS NOT NULL) AS kept, round_even(count(*) FILTER (WHERE delta IS NOT NULL) * 100.0::DOUBLE / least(50, count(rank_a), count(rank_b)), 2) AS retention_pct, count(*) FILTER (WHERE delta < 0) AS rose, count(*) FILTER (WHERE delta > 0) AS fell FROM d")
def topn_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.count("delta")
    pct = half_even(kept.cast("decimal(20,4)") * 100 / F.least(F.lit(50), F.count("rank_a"), F.count("rank_b")).cast("decimal(20,0)"), 2)
    return _ab(spark, sf_dir).agg(kept.alias("kept"), pct.cast("double").alias("retention_pct"), F.count_if(F.col("delta") < 0).alias("rose"), F.count_if(F.col("delta") > 0).alias("fell"))


@query(
    "major_impact",
    f"WITH c AS ({CANDIDATES_SQL}), x AS (SELECT candidate_key, unnest(['zoning', 'road', 'equity', 'demand']) AS factor, unnest([zoning * 0.25, road * 0.05, equity * -0.25, demand * -0.05]) AS v FROM c), m AS (SELECT candidate_key, max(abs(v)) AS top FROM x GROUP BY 1) SELECT candidate_key, CASE WHEN top > 0 THEN string_agg(factor, ',' ORDER BY factor) FILTER (WHERE abs(v) = top) END AS factors FROM x JOIN m USING (candidate_key) GROUP BY candidate_key, top",
)
def major_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors with the largest change in contribution, ties listed; null when none changes."""
    weights = {"zoning": "0.25", "road": "0.05", "equity": "-0.25", "demand": "-0.05"}
    parts = F.array(*[F.struct(F.lit(k).alias("factor"), F.abs(F.col(k) * F.lit(w).cast("decimal(3,2)")).alias("v")) for k, w in weights.items()])
    c = candidates(spark, sf_dir).select("candidate_key", parts.alias("p")).withColumn("top", F.array_max(F.transform("p", lambda x: x["v"])))
    best = F.array_sort(F.transform(F.filter("p", lambda x: x["v"] == F.col("top")), lambda x: x["factor"]))
    return c.select("candidate_key", F.when(F.col("top") > 0, F.array_join(best, ",")).alias("factors"))


@query("median_quadrants", "WITH v AS (SELECT s_nationkey, count(*) AS x, CAST(sum(CAST(s_acctbal AS DECIMAL(20,2))) AS DOUBLE) AS y FROM supplier GROUP BY 1), m AS (SELECT median(x) AS mx, median(y) AS my, count(*) AS n FROM v) SELECT s_nationkey, CASE WHEN n < 2 THEN NULL ELSE (CASE WHEN x >= mx THEN 'HIGH' ELSE 'LOW' END) || '_' || (CASE WHEN y >= my THEN 'HIGH' ELSE 'LOW' END) END AS quadrant FROM v, m")
def median_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("x"), F.sum(dec(F.col("s_acctbal"), 20, 2)).cast("double").alias("y"))
    m = v.agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.count(F.lit(1)).alias("n"))
    high = lambda a, b: F.when(F.col(a) >= F.col(b), "HIGH").otherwise("LOW")
    return v.crossJoin(F.broadcast(m)).select("s_nationkey", F.when(F.col("n") >= 2, F.concat_ws("_", high("x", "mx"), high("y", "my"))).alias("quadrant"))


@query("quantile_breaks", "WITH v AS (SELECT n_nationkey, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1), l AS (SELECT list(c ORDER BY c) AS cs, count(*) AS n FROM v), b AS (SELECT list_distinct([cs[1 + CAST(floor(k * (n - 1) / 5.0 + 0.5) AS INT)] for k in [1, 2, 3, 4]]) AS bs FROM l) SELECT n_nationkey, c AS suppliers, len(list_filter(bs, lambda x: c >= x)) AS class FROM v, b")
def quantile_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile classes; the breaks come from the sorted values of one dimension."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    v = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("suppliers"))
    breaks = R.quantile_breaks(v, "suppliers", 5)
    return v.crossJoin(F.broadcast(breaks)).select("n_nationkey", "suppliers", R.class_index(F.col("suppliers"), F.col("breaks")).cast("long").alias("class"))


@query("log_breaks", "WITH m AS (SELECT max(l_extendedprice) AS top FROM lineitem), b AS (SELECT [exp(ln(1 + top) * k / 5) - 1 for k in [1, 2, 3, 4]] AS bs FROM m) SELECT len(list_filter(bs, lambda x: l_extendedprice >= x)) AS class, count(*) AS n FROM lineitem, b GROUP BY 1")
def log_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "lineitem").agg(F.max("l_extendedprice").alias("top"))
    b = top.select(F.array(*[F.expm1(F.log1p("top") * k / 5) for k in (1, 2, 3, 4)]).alias("bs"))
    return table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(b)).groupBy(R.class_index(F.col("l_extendedprice"), F.col("bs")).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("block_segmentation", "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations")
def block_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header row starts a block that ends before the next header."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("block"))


@query("repeated_blocks", "SELECT CASE WHEN n > 1 THEN 'REPEATED' ELSE 'SINGLE' END AS state, count(*) AS texts, CAST(sum(n - 1) AS BIGINT) AS suppressed FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1) GROUP BY 1")
def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal signatures: the first is kept, the others are repetitions."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sig")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy(F.when(F.col("n") > 1, "REPEATED").otherwise("SINGLE").alias("state")).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n") - 1).alias("suppressed"))


@query("largest_remainder", "WITH v AS (SELECT n_regionkey, n_nationkey, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY n_regionkey) AS tot FROM v), f AS (SELECT *, CAST(c * 100 // tot AS BIGINT) AS low, c * 100 % tot AS rest FROM t), g AS (SELECT *, 100 - sum(low) OVER (PARTITION BY n_regionkey) AS short, row_number() OVER (PARTITION BY n_regionkey ORDER BY rest DESC, n_nationkey) AS pos FROM f) SELECT n_regionkey, n_nationkey, CAST(low + CASE WHEN pos <= short THEN 1 ELSE 0 END AS BIGINT) AS share FROM g WHERE tot > 0")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    v = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("s_suppkey").alias("c"))
    return R.largest_remainder(v, ["n_regionkey"], "c", "n_nationkey").where("share IS NOT NULL").select("n_regionkey", "n_nationkey", "share")
