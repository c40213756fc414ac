"""The indicators: per-capita figures, burdens, flows, cost chains and candidate scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataform.functions.rounding import clamp_score, dec, half_even, ratio
from strataform.operators.lookup import checked_lookup
from strataform.operators.scoring import composite, critic_weights, curve, provisional, resolve_status
from strataform.plans.registry import query, table
from strataform.plans.scoring import CANDIDATES_SQL, WEIGHTS, candidates

_POP = "SELECT c_nationkey AS nk, count(*) AS population FROM customer GROUP BY 1"
_WASTE = "SELECT c_nationkey AS nk, o_orderpriority AS stream, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS qty FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1997 GROUP BY 1, 2"


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("population"))


def _waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1997-01-01") & (F.col("o_orderdate") < "1998-01-01")), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nk"), F.col("o_orderpriority").alias("stream")).agg(F.sum(dec(F.col("o_totalprice"), 20, 2)).alias("qty"))


@query("waste_per_capita", f"SELECT nk, stream, round_even(CAST(qty AS DOUBLE) * 1000 / population, 3) AS kg_per_person, CASE WHEN population IS NULL THEN 'NO_POPULATION' END AS reason FROM ({_WASTE}) LEFT JOIN ({_POP}) USING (nk)")
def waste_per_capita(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by 1000 over population of each region and stream, with exclusions as rows."""
    w = checked_lookup(_waste(spark, sf_dir), _population(spark, sf_dir), ["nk"], "population", "NO_POPULATION", "AMBIGUOUS_POPULATION")
    return w.select("nk", "stream", ratio(F.col("qty") * 1000, F.col("population").cast("decimal(20,0)"), 3).cast("double").alias("kg_per_person"), "reason")


@query(
    "facility_burden",
    f"""WITH f AS (SELECT s_nationkey AS nk, sum(CASE WHEN s_acctbal >= 0 THEN CAST(s_acctbal AS DECIMAL(20,2)) END) AS t, count(*) AS n, count(*) FILTER (WHERE s_acctbal < 0) AS missing FROM supplier GROUP BY 1)
SELECT n_nationkey AS nk, coalesce(CAST(t AS DOUBLE), 0) AS throughput, coalesce(n, 0) AS facilities, coalesce(missing, 0) > 0 AS is_partial,
  round_even(coalesce(CAST(t AS DOUBLE), 0) / population, 4) AS per_capita, CASE WHEN population IS NULL THEN 'NO_POPULATION' END AS reason
FROM nation LEFT JOIN f ON n_nationkey = f.nk LEFT JOIN ({_POP}) p ON n_nationkey = p.nk""",
)
def facility_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("s_acctbal") >= 0
    f = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.sum(F.when(ok, dec(F.col("s_acctbal"), 20, 2))).alias("t"), F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("missing"))
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk")).join(f, "nk", "left")
    j = checked_lookup(base, _population(spark, sf_dir), ["nk"], "population", "NO_POPULATION", "AMBIGUOUS_POPULATION")
    t = F.coalesce("t", F.lit(0).cast("decimal(20,2)"))
    return j.select("nk", t.cast("double").alias("throughput"), F.coalesce("n", F.lit(0)).alias("facilities"), (F.coalesce("missing", F.lit(0)) > 0).alias("is_partial"), ratio(t, F.col("population").cast("decimal(20,0)"), 4).cast("double").alias("per_capita"), "reason")


_FLOW = "SELECT strftime(l_shipdate, '%Y-%m') AS month, s_nationkey AS origin, l_returnflag AS waste, sum(CAST(l_quantity AS DECIMAL(20,2))) AS kg, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS fee FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3"


def _cents(c: str) -> Column:
    """Hundredths as a whole number: sums of them stay exact, and on the fast path that decimals leave."""
    return F.floor(F.col(c) * 100 + 0.5)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kg and fee by month, origin and waste: months are numbers while rows are many, and texts afterwards."""
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    number = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    l = l.select("l_suppkey", number.alias("__m"), "l_returnflag", _cents("l_quantity").alias("kg"), _cents("l_extendedprice").alias("fee"))
    sums = l.join(s, l.l_suppkey == s.s_suppkey).groupBy("__m", F.col("s_nationkey").alias("origin"), F.col("l_returnflag").alias("waste")).agg(F.sum("kg").alias("kg"), F.sum("fee").alias("fee"))
    month = F.format_string("%04d-%02d", F.floor(F.col("__m") / 12), F.col("__m") % 12 + 1)
    exact = [(F.col(c).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)").alias(c) for c in ("kg", "fee")]
    return sums.select(month.alias("month"), "origin", "waste", *exact)


@query("landfill_summary", f"WITH f AS ({_FLOW}) SELECT left(month, 4) AS year, round_even(CAST(sum(kg) AS DOUBLE) / 1000, 3) AS tonnes, round_even(CAST(sum(fee) AS DOUBLE) / CAST(sum(kg) AS DOUBLE), 2) AS fee_per_kg, count(DISTINCT month) AS months, count(DISTINCT month) = 12 AS complete FROM f GROUP BY 1")
def landfill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = F.size(F.collect_set("month")).cast("long")
    return _flows(spark, sf_dir).groupBy(F.substring("month", 1, 4).alias("year")).agg(half_even(F.sum("kg") / 1000, 3).cast("double").alias("tonnes"), ratio(F.sum("fee"), F.sum("kg"), 2).cast("double").alias("fee_per_kg"), months.alias("months"), (months == 12).alias("complete"))


@query("landfill_trends", f"WITH f AS ({_FLOW}) SELECT month, CAST(sum(kg) AS DOUBLE) AS kg, CAST(sum(fee) AS DOUBLE) AS fee FROM f GROUP BY 1")
def landfill_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir).groupBy("month").agg(F.sum("kg").cast("double").alias("kg"), F.sum("fee").cast("double").alias("fee"))


@query("landfill_composition", f"WITH f AS ({_FLOW}), t AS (SELECT sum(kg) AS total FROM f) SELECT waste, CAST(sum(kg) AS DOUBLE) AS kg, round_even(CAST(sum(kg) AS DOUBLE) / CAST(min(total) AS DOUBLE), 6) AS share FROM f, t GROUP BY 1")
def landfill_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _flows(spark, sf_dir).groupBy("waste").agg(F.sum("kg").alias("kg"))
    total = w.agg(F.sum("kg").cast("decimal(30,2)").alias("total"))
    return w.crossJoin(F.broadcast(total)).select("waste", F.col("kg").cast("double").alias("kg"), ratio(F.col("kg").cast("decimal(30,2)"), F.col("total"), 6).cast("double").alias("share"))


@query("landfill_flows", f"WITH f AS ({_FLOW}) SELECT origin, CAST(sum(kg) AS DOUBLE) AS kg, CAST(sum(fee) AS DOUBLE) AS fee, min(month) AS first_month, max(month) AS last_month FROM f GROUP BY 1")
def landfill_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir).groupBy("origin").agg(F.sum("kg").cast("double").alias("kg"), F.sum("fee").cast("double").alias("fee"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@query(
    "municipal_cost_table",
    """WITH s AS (SELECT s_nationkey AS nk, count(*) AS contracts, count(*) FILTER (WHERE s_acctbal < 0) AS blocked, CAST(sum(CASE WHEN s_acctbal >= 0 THEN CAST(s_acctbal AS DECIMAL(20,2)) END) AS DOUBLE) AS amount FROM supplier GROUP BY 1)
SELECT n_nationkey AS nk, coalesce(contracts, 0) AS contracts, amount, CASE WHEN contracts IS NULL THEN 'UNAVAILABLE' WHEN blocked = contracts THEN 'UNAVAILABLE' WHEN blocked > 0 THEN 'PARTIAL' ELSE 'AVAILABLE' END AS status
FROM nation LEFT JOIN s ON n_nationkey = nk""",
)
def municipal_cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("s_acctbal") >= 0
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("contracts"), F.count_if(~ok).alias("blocked"), F.sum(F.when(ok, dec(F.col("s_acctbal"), 20, 2))).cast("double").alias("amount"))
    status = F.when(F.col("contracts").isNull() | (F.col("blocked") == F.col("contracts")), "UNAVAILABLE").when(F.col("blocked") > 0, "PARTIAL").otherwise("AVAILABLE")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"))
    return n.join(s, "nk", "left").select("nk", F.coalesce("contracts", F.lit(0)).alias("contracts"), "amount", status.alias("status"))


@query(
    "facility_cost_chain",
    """WITH a AS (SELECT p_partkey, CAST(p_size AS DECIMAL(12,2)) AS cap FROM part),
b AS (SELECT p_partkey, cap, round_even(cap * CAST(1.25 AS DECIMAL(4,2)), 2) AS service FROM a),
c AS (SELECT *, round_even(service * CAST(3.75 AS DECIMAL(4,2)), 2) AS construction FROM b),
d AS (SELECT *, round_even(CAST(construction AS DOUBLE) / 15, 4) AS annualised, round_even(construction * CAST(0.30 AS DECIMAL(3,2)), 2) AS subsidy FROM c)
SELECT p_partkey, CAST(service AS DOUBLE) AS service, CAST(construction AS DOUBLE) AS construction, annualised, CAST(subsidy AS DOUBLE) AS subsidy, CAST(construction - subsidy AS DOUBLE) AS local_share FROM d""",
)
def facility_cost_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded at each step: the intermediate rounding is part of the result."""
    p = table(spark, sf_dir, "part").select("p_partkey", dec(F.col("p_size"), 12, 2).alias("cap"))
    p = p.withColumn("service", half_even(F.col("cap") * F.lit("1.25").cast("decimal(4,2)"), 2, 14))
    p = p.withColumn("construction", half_even(F.col("service") * F.lit("3.75").cast("decimal(4,2)"), 2, 16))
    p = p.withColumn("subsidy", half_even(F.col("construction") * F.lit("0.30").cast("decimal(3,2)"), 2, 16)).withColumn("annualised", half_even(F.col("construction") / 15, 4))
    return p.select("p_partkey", *[F.col(c).cast("double").alias(c) for c in ("service", "construction", "annualised", "subsidy")], (F.col("construction") - F.col("subsidy")).cast("double").alias("local_share"))


@query("capital_rollup", "WITH m AS (SELECT n_regionkey, n_nationkey, count(c_custkey) AS pop, CAST(sum(CAST(c_acctbal AS DECIMAL(20,2))) AS DOUBLE) AS bal FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT r_name, CAST(sum(pop) AS BIGINT) AS population, round(sum(bal), 2) AS balance FROM m JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def capital_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, r = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    own = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("pop"), F.sum(dec(F.col("c_acctbal"), 20, 2)).alias("bal"))
    m = n.join(own, n.n_nationkey == own.c_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey)
    return m.groupBy("r_name").agg(F.sum("pop").alias("population"), F.sum("bal").cast("double").alias("balance"))


@query("generation_burden_scatter", "WITH x AS (SELECT s_nationkey AS nk, count(*) AS burden FROM supplier GROUP BY 1), y AS (SELECT c_nationkey AS nk, count(*) AS generation FROM customer GROUP BY 1), j AS (SELECT nk, burden, generation FROM x JOIN y USING (nk)), m AS (SELECT median(burden) AS mb, median(generation) AS mg FROM j) SELECT x.nk, CASE WHEN j.nk IS NULL THEN 'NO_MATCH' END AS reason, CASE WHEN j.nk IS NOT NULL THEN (CASE WHEN j.generation >= mg THEN 'HIGH' ELSE 'LOW' END) || '/' || (CASE WHEN j.burden >= mb THEN 'HIGH' ELSE 'LOW' END) END AS quadrant FROM x LEFT JOIN j ON x.nk = j.nk CROSS JOIN m")
def generation_burden_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("burden"))
    y = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("generation"))
    j = x.join(y, "nk", "left")
    m = j.where("generation IS NOT NULL").agg(F.median("burden").alias("mb"), F.median("generation").alias("mg"))
    side = lambda a, b: F.when(F.col(a) >= F.col(b), "HIGH").otherwise("LOW")
    known = F.col("generation").isNotNull()
    return j.crossJoin(F.broadcast(m)).select("nk", F.when(~known, "NO_MATCH").alias("reason"), F.when(known, F.concat_ws("/", side("generation", "mg"), side("burden", "mb"))).alias("quadrant"))


@query("per_capita_kg", "SELECT p_partkey, round_even(CAST(CAST(p_retailprice AS DECIMAL(20,2)) AS DOUBLE) * 1000 / p_size, 3) AS kg FROM part")
def per_capita_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ratio(dec(F.col("p_retailprice"), 20, 2) * 1000, F.col("p_size").cast("decimal(20,0)"), 3).cast("double").alias("kg"))


@query("fee_share_metrics", "WITH t AS (SELECT l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS fee, sum(CAST(l_quantity AS DECIMAL(20,2))) AS kg FROM lineitem GROUP BY 1), a AS (SELECT sum(fee) AS total FROM t) SELECT l_linestatus, round_even(CAST(fee AS DOUBLE) / (CAST(kg AS DOUBLE) / 1000), 2) AS fee_per_t, round_even(CAST(fee AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share FROM t, a")
def fee_share_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.sum(dec(F.col("l_extendedprice"), 20, 2)).alias("fee"), F.sum(dec(F.col("l_quantity"), 20, 2)).alias("kg"))
    a = t.agg(F.sum("fee").cast("decimal(30,2)").alias("total"))
    return t.crossJoin(F.broadcast(a)).select("l_linestatus", ratio(F.col("fee") * 1000, F.col("kg"), 2).cast("double").alias("fee_per_t"), ratio(F.col("fee"), F.col("total"), 6).cast("double").alias("share"))


@query("road_curve", "SELECT p_partkey, CASE WHEN x <= 250 THEN 100.0 WHEN x <= 1000 THEN round_even(100 + (x - 250) * -30 / 750.0, 4) WHEN x <= 3000 THEN round_even(70 + (x - 1000) * -50 / 2000.0, 4) WHEN x <= 5000 THEN round_even(20 + (x - 3000) * -20 / 2000.0, 4) ELSE 0 END::DOUBLE AS score FROM (SELECT p_partkey, CAST(p_size * 110 AS DOUBLE) AS x FROM part)")
def road_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", curve(F.col("p_size") * 110).cast("double").alias("score"))


_GAPS = "SELECT candidate_key, zoning, CASE WHEN p_size % 5 = 0 THEN NULL ELSE road END AS road, equity, CASE WHEN p_size % 7 = 0 THEN NULL ELSE demand END AS demand, p_size FROM c"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return c.withColumn("road", F.when(F.col("p_size") % 5 != 0, F.col("road"))).withColumn("demand", F.when(F.col("p_size") % 7 != 0, F.col("demand")))


@query(
    "composite_and_provisional",
    f"""WITH c AS ({CANDIDATES_SQL}), g AS ({_GAPS})
SELECT candidate_key, CAST(round_even(zoning * 0.35 + road * 0.25 + equity * 0.25 + demand * 0.15, 4) AS DOUBLE) AS composite,
CASE WHEN road IS NOT NULL AND demand IS NOT NULL THEN CAST(round_even(zoning * 0.35 + road * 0.25 + equity * 0.25 + demand * 0.15, 4) AS DOUBLE) ELSE round_even(CAST(coalesce(zoning * 0.35, 0) + coalesce(road * 0.25, 0) + coalesce(equity * 0.25, 0) + coalesce(demand * 0.15, 0) AS DOUBLE) / (0.60 + CASE WHEN road IS NULL THEN 0 ELSE 0.25 END + CASE WHEN demand IS NULL THEN 0 ELSE 0.15 END)::DOUBLE, 4) END AS provisional FROM g""",
)
def composite_and_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("candidate_key", composite(WEIGHTS).cast("double").alias("composite"), provisional(WEIGHTS).cast("double").alias("provisional"))


@query("status_resolution", f"WITH c AS ({CANDIDATES_SQL}), g AS ({_GAPS}), s AS (SELECT *, CASE WHEN p_size % 11 = 0 THEN 'EXCLUDED' WHEN p_size % 3 = 0 OR road IS NULL OR demand IS NULL THEN 'REVIEW_REQUIRED' ELSE 'ELIGIBLE' END AS status FROM g) SELECT candidate_key, status, CASE WHEN status = 'ELIGIBLE' THEN CAST(round_even(zoning * 0.35 + road * 0.25 + equity * 0.25 + demand * 0.15, 4) AS DOUBLE) END AS score FROM s")
def status_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded rows lose all scores, rows under review have no final one."""
    ex = F.array_compact(F.array(F.when(F.col("p_size") % 11 == 0, "PROTECTED")))
    rv = F.array_compact(F.array(F.when(F.col("p_size") % 3 == 0, "ZONING_REVIEW")))
    g = _gaps(spark, sf_dir).withColumn("status", resolve_status(ex, rv, ["zoning", "road", "equity", "demand"]))
    return g.select("candidate_key", "status", F.when(F.col("status") == "ELIGIBLE", composite(WEIGHTS)).cast("double").alias("score"))


@query("suitability_summary", f"WITH c AS ({CANDIDATES_SQL}), g AS ({_GAPS}), s AS (SELECT CASE WHEN p_size % 11 = 0 THEN 'EXCLUDED' WHEN p_size % 3 = 0 OR road IS NULL OR demand IS NULL THEN 'REVIEW_REQUIRED' ELSE 'ELIGIBLE' END AS status FROM g) SELECT status, count(*) AS n FROM s GROUP BY 1")
def suitability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_resolution(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("critic_weights")
def critic_weights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the four components; finished in 60 digits, so without SQL."""
    w = critic_weights(candidates(spark, sf_dir), ["zoning", "road", "equity", "demand"])
    return spark.createDataFrame([(k, float(v)) for k, v in w.items()], "component string, weight double")


@query("clamped_half_even", "SELECT p_partkey, CAST(round_even(greatest(0, least(100, CAST((p_retailprice - 1000) / 8 AS DECIMAL(20,6)))), 4) AS DOUBLE) AS score FROM part")
def clamped_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", clamp_score(dec((F.col("p_retailprice") - 1000) / 8)).cast("double").alias("score"))


@query("avoidance_demand_scores", "WITH v AS (SELECT s_nationkey AS nk, count(*) AS c FROM supplier GROUP BY 1), p AS (SELECT nk, percent_rank() OVER (ORDER BY c) AS pr FROM v) SELECT nk, round_even((1 - round_even(pr, 6)) * 100, 4) AS equity, round_even(round_even(pr, 6) * 100, 4) AS demand FROM p")
def avoidance_demand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.operators.ranking import percentile_rank

    v = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("c"))
    p = percentile_rank(v, "c")
    return p.select("nk", half_even((F.lit(1) - F.col("percentile")) * 100, 4).cast("double").alias("equity"), half_even(F.col("percentile") * 100, 4).cast("double").alias("demand"))


@query("guarded_ratio", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE round_even(CAST(CAST(s_acctbal AS DECIMAL(20,2)) AS DOUBLE) / (s_suppkey % 4), 3) END AS r FROM supplier")
def guarded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", ratio(dec(F.col("s_acctbal"), 20, 2), (F.col("s_suppkey") % 4).cast("decimal(20,0)"), 3).cast("double").alias("r"))


@query("clamp_guard_flags", "SELECT p_partkey, greatest(p_size - 25, 0) AS residual, least(p_size / 25.0, 1.0)::DOUBLE AS covered, p_size < 25 AS guarded FROM part")
def clamp_guard_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.greatest(s - 25, F.lit(0)).alias("residual"), F.least(s / 25.0, F.lit(1.0)).alias("covered"), (s < 25).alias("guarded"))


@query("contribution_rows", f"WITH c AS ({CANDIDATES_SQL}) SELECT candidate_key, unnest(['zoning', 'road', 'equity', 'demand']) AS component, unnest([CAST(zoning * 0.35 AS DOUBLE), CAST(road * 0.25 AS DOUBLE), CAST(equity * 0.25 AS DOUBLE), CAST(demand * 0.15 AS DOUBLE)]) AS contribution FROM c")
def contribution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(k).alias("component"), (F.col(k) * F.lit(w).cast("decimal(3,2)")).cast("double").alias("contribution")) for k, w in WEIGHTS.items()])
    return candidates(spark, sf_dir).select("candidate_key", F.inline(parts))


@query("ton_km_cost", "SELECT l_orderkey, l_linenumber, round_even(CAST(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(6,4)) * 300 AS DOUBLE) / 10000, 6) AS cost FROM lineitem")
def ton_km_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = dec(F.col("l_quantity"), 12, 2) * dec(F.col("l_tax"), 6, 4) * 300
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", half_even(cost / 10000, 6).cast("double").alias("cost"))


@query("display_half_up", "SELECT p_partkey, round(CAST(p_retailprice AS DECIMAL(20,2)) / CAST(1 AS DECIMAL(1,0)) * 1.0, 1)::DOUBLE AS shown FROM part")
def display_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display figures alone are rounded half up."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(dec(F.col("p_retailprice"), 20, 2), 1).cast("double").alias("shown"))


@query("payment_per_capita", "SELECT n_nationkey, CASE WHEN bal < 0 THEN 'NEGATIVE_NUMERATOR' WHEN bal IS NULL THEN 'MISSING' END AS reason, CASE WHEN bal >= 0 THEN round_even(CAST(bal AS DOUBLE) / n, 4) END AS paid FROM nation LEFT JOIN (SELECT s_nationkey, sum(CAST(s_acctbal AS DECIMAL(20,2))) AS bal, count(*) AS n FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def payment_per_capita(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum(dec(F.col("s_acctbal"), 20, 2)).alias("bal"), F.count(F.lit(1)).alias("n"))
    j = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.select("n_nationkey", F.when(F.col("bal") < 0, "NEGATIVE_NUMERATOR").when(F.col("bal").isNull(), "MISSING").alias("reason"), F.when(F.col("bal") >= 0, ratio(F.col("bal"), F.col("n").cast("decimal(20,0)"), 4)).cast("double").alias("paid"))
