"""Grouping: null-aware sums, ratios, completeness, fingerprints, array and map building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataform.functions.rounding import dec, half_even, ratio
from strataform.plans.registry import query, table


def d2(name: str):
    return dec(F.col(name), 20, 2)


@query("two_measure_group", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(20,2))) AS DOUBLE) AS sum_kg, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS sum_fee FROM lineitem GROUP BY 1")
def two_measure_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(d2("l_quantity")).cast("double").alias("sum_kg"), F.sum(d2("l_extendedprice")).cast("double").alias("sum_fee"))


@query("global_totals", "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(20,2))) AS DOUBLE) AS kg FROM lineitem")
def global_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum(d2("l_quantity")).cast("double").alias("kg"))


@query("conditional_counts", "SELECT s_nationkey, count(*) AS n, count(*) FILTER (WHERE s_acctbal > 0) AS positive, count(*) FILTER (WHERE s_acctbal <= 0) AS negative FROM supplier GROUP BY 1")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(b > 0).alias("positive"), F.count_if(b <= 0).alias("negative"))


@query("group_breakdowns", "SELECT 'status' AS dimension, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def group_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pairs = F.array(F.struct(F.lit("status").alias("dimension"), F.col("o_orderstatus").alias("label")), F.struct(F.lit("priority").alias("dimension"), F.col("o_orderpriority").alias("label")))
    return o.select(F.inline(pairs)).groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "partial_aware_sum",
    """SELECT s_nationkey, coalesce(CAST(sum(CASE WHEN s_acctbal >= 0 THEN CAST(s_acctbal AS DECIMAL(20,2)) END) AS DOUBLE), 0) AS throughput,
count(*) FILTER (WHERE s_acctbal < 0) AS missing, count(*) AS facilities, count(*) FILTER (WHERE s_acctbal < 0) > 0 AS is_partial FROM supplier GROUP BY 1""",
)
def partial_aware_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid quantities are counted as missing, never as zero."""
    ok = F.col("s_acctbal") >= 0
    missing = F.count_if(~ok)
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.coalesce(F.sum(F.when(ok, d2("s_acctbal"))).cast("double"), F.lit(0.0)).alias("throughput"), missing.alias("missing"), F.count(F.lit(1)).alias("facilities"), (missing > 0).alias("is_partial"))


@query("unnest_reason_counts", "SELECT word AS reason, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY 1")
def unnest_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("nested_status_map", "SELECT coalesce(p_brand, 'UNKNOWN') AS brand, count(*) FILTER (WHERE p_size <= 15) AS small, count(*) FILTER (WHERE p_size > 15 AND p_size <= 35) AS medium, count(*) FILTER (WHERE p_size > 35) AS large FROM part GROUP BY 1")
def nested_status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 35, "medium").otherwise("large")
    counts = table(spark, sf_dir, "part").groupBy(F.coalesce("p_brand", F.lit("UNKNOWN")).alias("brand"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    nested = counts.groupBy("brand").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("m"))
    return nested.select("brand", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(k) for k in ("small", "medium", "large")])


@query("area_weighted_ratio", "SELECT l_returnflag, round_even(CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(20,2))) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE), 6) AS ratio FROM lineitem GROUP BY 1")
def area_weighted_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio of sums, never a mean of ratios."""
    num, den = F.sum(dec(F.col("l_extendedprice") * F.col("l_discount"), 20, 2)), F.sum(d2("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(ratio(num, den, 6).cast("double").alias("ratio"))


@query("closed_domain_counts", "SELECT status, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) ON status = o_orderstatus")
def closed_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "status", "left").na.fill(0, ["n"])


@query(
    "aggregate_fee_per_capita",
    """WITH fee AS (SELECT c_nationkey AS nk, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS fee FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
pop AS (SELECT c_nationkey AS nk, count(*) AS population FROM customer WHERE c_acctbal > 9700 GROUP BY 1),
j AS (SELECT n_regionkey, fee, population, CASE WHEN population IS NULL THEN 'NO_POPULATION' END AS reason FROM fee JOIN nation ON nk = n_nationkey LEFT JOIN pop USING (nk))
SELECT n_regionkey, CASE WHEN count(reason) = 0 THEN round_even(CAST(sum(fee) AS DOUBLE) / CAST(sum(population) AS DOUBLE), 2) END AS fee_per_capita, CASE WHEN count(reason) > 0 THEN CASE WHEN count(DISTINCT reason) = 1 THEN min(reason) ELSE 'MIXED' END END AS reason FROM j GROUP BY 1""",
)
def aggregate_fee_per_capita(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of fees over sum of populations, only with complete coverage; else the shared reason."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    fee = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.sum(d2("o_totalprice")).alias("fee"))
    pop = c.where("c_acctbal > 9700").groupBy(F.col("c_nationkey").alias("pk")).agg(F.count(F.lit(1)).alias("population"))
    j = fee.join(n, fee.c_nationkey == n.n_nationkey).join(pop, F.col("c_nationkey") == F.col("pk"), "left")
    j = j.withColumn("reason", F.when(F.col("population").isNull(), "NO_POPULATION"))
    g = j.groupBy("n_regionkey").agg(F.sum("fee").alias("f"), F.sum("population").alias("p"), F.collect_set("reason").alias("rs"))
    whole = F.size("rs") == 0
    return g.select(
        "n_regionkey",
        F.when(whole, ratio(F.col("f"), F.col("p").cast("decimal(20,0)"), 2)).cast("double").alias("fee_per_capita"),
        F.when(~whole, F.when(F.size("rs") == 1, F.get("rs", F.lit(0))).otherwise("MIXED")).alias("reason"),
    )


@query("min_label_group", "SELECT n_regionkey, min(n_name) AS label, count(*) AS n FROM nation GROUP BY 1")
def min_label_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("label"), F.count(F.lit(1)).alias("n"))


@query("state_accumulators", "SELECT o_orderstatus, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months, count(DISTINCT o_orderpriority) AS categories, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS category_list FROM orders GROUP BY 1")
def state_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    months, cats = F.collect_set(F.date_format("o_orderdate", "yyyy-MM")), F.collect_set("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.size(months).cast("long").alias("months"), F.size(cats).cast("long").alias("categories"), F.array_join(F.sort_array(cats), "|").alias("category_list"))


@query("distinct_code_array", "SELECT n_regionkey, string_agg(DISTINCT s_nationkey, ',' ORDER BY s_nationkey) AS codes FROM (SELECT n_regionkey, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1")
def distinct_code_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("s_nationkey").cast("string"))), ",").alias("codes"))


@query("table_fingerprint", "SELECT sha256(string_agg(n_nationkey || ':' || n_name || ':' || n_regionkey, chr(10) ORDER BY n_nationkey)) AS fingerprint FROM nation")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a dimension's rows in order."""
    row = F.concat_ws(":", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r"))))
    return table(spark, sf_dir, "nation").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["r"]), "\n"), 256).alias("fingerprint"))


@query("occurrence_audit", "SELECT n, count(*) AS keys FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def occurrence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


@query("single_value_assert", "SELECT l_returnflag, count(DISTINCT l_linestatus) AS n_values, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS single_value FROM lineitem GROUP BY 1")
def single_value_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.collect_set("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.size(seen).cast("long").alias("n_values"), F.when(F.size(seen) == 1, F.min("l_linestatus")).alias("single_value"))


@query("residual_row", "WITH t AS (SELECT p_brand AS name, CAST(sum(CAST(p_retailprice AS DECIMAL(20,2))) AS DOUBLE) AS v FROM part GROUP BY 1), k AS (SELECT * FROM t ORDER BY v DESC, name LIMIT 3) SELECT * FROM k UNION ALL SELECT 'others', round((SELECT sum(v) FROM t) - (SELECT sum(v) FROM k), 2) WHERE (SELECT sum(v) FROM t) - (SELECT sum(v) FROM k) > 0.5")
def residual_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups and the rest as one row, only if it is worth more than 0.5."""
    t = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.sum(d2("p_retailprice")).alias("v"))
    k = t.orderBy(F.desc("v"), "name").limit(3)
    rest = t.agg(F.sum("v").alias("t")).crossJoin(F.broadcast(k.agg(F.sum("v").alias("k")))).select(F.lit("others").alias("name"), (F.col("t") - F.col("k")).alias("v")).where("v > 0.5")
    return k.unionByName(rest).select("name", F.col("v").cast("double").alias("v"))


@query("exact_decimal_rollup", "SELECT s_nationkey, CASE WHEN count(*) FILTER (WHERE s_acctbal < -900) = 0 THEN CAST(sum(CAST(s_acctbal AS DECIMAL(20,2))) AS DOUBLE) END AS total FROM supplier GROUP BY 1")
def exact_decimal_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact sum of decimal strings; one malformed string makes it null."""
    raw = F.when(F.col("s_acctbal") < -900, "n/a").otherwise(d2("s_acctbal").cast("string"))
    s = table(spark, sf_dir, "supplier").select("s_nationkey", raw.try_cast("decimal(20,2)").alias("v"))
    return s.groupBy("s_nationkey").agg(F.when(F.count_if(F.col("v").isNull()) == 0, F.sum("v")).cast("double").alias("total"))


@query("all_or_nothing_sum", "SELECT n_regionkey, CASE WHEN count(*) = count(v) THEN CAST(sum(v) AS BIGINT) END AS total FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS v FROM supplier WHERE s_acctbal > 3000 GROUP BY 1) ON n_nationkey = s_nationkey GROUP BY 1")
def all_or_nothing_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("v"))
    n = table(spark, sf_dir, "nation")
    return n.join(v, n.n_nationkey == v.s_nationkey, "left").groupBy("n_regionkey").agg(F.when(F.count_if(F.col("v").isNull()) == 0, F.sum("v")).alias("total"))


@query("complete_month_sets", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT c_nationkey) FILTER (WHERE c_nationkey < 8) AS found FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT month, 8 - found AS n_missing, found = 8 AS complete FROM m")
def complete_month_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months whose regions include every required one."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.collect_set("c_nationkey").alias("seen"))
    missing = F.size(F.array_except(F.array(*[F.lit(i) for i in range(8)]), F.col("seen"))).cast("long")
    return m.select("month", missing.alias("n_missing"), (missing == 0).alias("complete"))


@query("eligible_numerator", "SELECT s_nationkey, coalesce(CAST(sum(CAST(s_acctbal AS DECIMAL(20,2))) FILTER (WHERE s_acctbal > 0 AND s_suppkey % 3 <> 0) AS DOUBLE), 0) AS numerator, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM (SELECT *, CASE WHEN s_acctbal <= 0 THEN 'NON_POSITIVE' WHEN s_suppkey % 3 = 0 THEN 'OUT_OF_SCOPE' END AS reason FROM supplier) GROUP BY 1")
def eligible_numerator(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("s_acctbal") <= 0, "NON_POSITIVE").when(F.col("s_suppkey") % 3 == 0, "OUT_OF_SCOPE")
    s = table(spark, sf_dir, "supplier").withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return s.groupBy("s_nationkey").agg(F.coalesce(F.sum(F.when(ok, d2("s_acctbal"))).cast("double"), F.lit(0.0)).alias("numerator"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


@query("complete_years", "SELECT y AS year, months, months = 12 AS complete, coalesce(max(CASE WHEN months = 12 THEN y END) OVER (), max(y) OVER ()) AS resolved FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(DISTINCT month(o_orderdate)) AS months FROM orders GROUP BY 1)")
def complete_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.size(F.collect_set(F.month("o_orderdate"))).cast("long").alias("months"))
    y = y.withColumn("complete", F.col("months") == 12)
    best = y.agg(F.coalesce(F.max(F.when(F.col("complete"), F.col("year"))), F.max("year")).alias("resolved"))
    return y.crossJoin(F.broadcast(best))


@query("missing_months", "SELECT y AS year, 12 - count(DISTINCT m) AS n_missing FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, month(o_orderdate) AS m FROM orders WHERE month(o_orderdate) NOT IN (4, 11)) GROUP BY 1")
def missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(~F.month("o_orderdate").isin(4, 11))
    due = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.format_string("%02d", m))
    g = o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.collect_set(F.date_format("o_orderdate", "MM")).alias("seen"))
    return g.select("year", F.size(F.array_except(due, F.col("seen"))).cast("long").alias("n_missing"))


@query("month_sequence", "SELECT count(*) AS months, min(m) AS first_month, max(m) AS last_month, max(last_day(CAST(m || '-01' AS DATE))::VARCHAR) AS month_end FROM (SELECT strftime(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)), '%Y-%m') AS m FROM (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders))")
def month_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    s = b.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))).alias("d"))
    return s.agg(F.count(F.lit(1)).alias("months"), F.date_format(F.min("d"), "yyyy-MM").alias("first_month"), F.date_format(F.max("d"), "yyyy-MM").alias("last_month"), F.last_day(F.max("d")).cast("string").alias("month_end"))


@query("definition_version", "SELECT CASE WHEN m >= '2000-01' THEN 'V3' WHEN m >= '1997-10' THEN 'V2' ELSE 'V1' END AS version, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m FROM orders) GROUP BY 1")
def definition_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.date_format("o_orderdate", "yyyy-MM")
    v = F.when(m >= "2000-01", "V3").when(m >= "1997-10", "V2").otherwise("V1")
    return table(spark, sf_dir, "orders").groupBy(v.alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_path_extract",
    "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.page')) AS with_page, count(json_extract_string(props, '$.missing')) AS with_missing FROM events GROUP BY 1",
)
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.page")).alias("with_page"), F.count(F.get_json_object("props", "$.missing")).alias("with_missing"))


@query(
    "map_build",
    """WITH t AS (SELECT l_partkey, l_returnflag AS profile, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY total DESC, profile) AS rank FROM t)
SELECT l_partkey, max(total) FILTER (WHERE profile = 'A') AS total_a, max(rank) FILTER (WHERE profile = 'N') AS rank_n, count(*) AS n_keys FROM k GROUP BY 1""",
)
def map_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{profile: total} and {profile: rank} of each candidate, read back by key; an absent key is null."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("profile")).agg(F.sum("l_quantity").alias("total"))
    held = t.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("less"), "profile"))).alias("held"))
    totals = F.map_from_entries(F.transform("held", lambda e: F.struct(e.profile, -e.less)))
    ranks = F.map_from_entries(F.transform("held", lambda e, i: F.struct(e.profile, (i + 1).cast("long"))))
    maps = held.select("l_partkey", totals.alias("totals"), ranks.alias("ranks"))
    return maps.select("l_partkey", F.try_element_at("totals", F.lit("A")).alias("total_a"), F.try_element_at("ranks", F.lit("N")).alias("rank_n"), F.size("ranks").cast("long").alias("n_keys"))


@query("nested_matrix_walk", "SELECT l_suppkey, l_returnflag AS layer, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def nested_matrix_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{owner: {layer: {status: rows}}}, gathered level by level and walked back by explodes."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    layers = n.groupBy("l_suppkey", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("statuses"))
    matrix = layers.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "statuses"))).alias("layers"))
    return matrix.select("l_suppkey", F.explode("layers").alias("layer", "statuses")).select("l_suppkey", "layer", F.explode("statuses").alias("status", "n"))


@query("map_score_range_filter", "SELECT event_id, CAST(TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(7, 4)) AS DOUBLE) AS score FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(7, 4)) BETWEEN 30 AND 60")
def map_score_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose decimal within a JSON text lies in a closed range; absent and unreadable ones are in none."""
    score = F.get_json_object("props", "$.k").try_cast("decimal(7,4)")
    return table(spark, sf_dir, "events").select("event_id", score.alias("s")).where("s BETWEEN 30 AND 60").select("event_id", F.col("s").cast("double").alias("score"))


@query("vintage_dimension_scan", "SELECT CAST(year(o_orderdate) AS BIGINT) AS vintage, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def vintage_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("vintage")).agg(F.countDistinct("o_custkey").alias("n"))


@query("catalog_search_overview", "SELECT count(*) AS n, count(*) FILTER (WHERE suppliers IS NULL) AS never_refreshed, count(*) FILTER (WHERE contains(lower(n_name), '1')) AS matching FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 4000 GROUP BY 1) ON n_nationkey = s_nationkey")
def catalog_search_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 4000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    n = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("suppliers").isNull()).alias("never_refreshed"), F.count_if(F.contains(F.lower("n_name"), F.lit("1"))).alias("matching"))


@query("scope_option_groups", "SELECT r_name, string_agg(CAST(n_nationkey AS VARCHAR), '|' ORDER BY CAST(n_nationkey AS VARCHAR)) AS codes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def scope_option_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set(F.col("n_nationkey").cast("string"))), "|").alias("codes"))


@query("percent_change_by_year", "SELECT y AS year, n, prev, CASE WHEN prev IS NULL OR prev = 0 THEN NULL ELSE round_even((n - prev) * 100.0::DOUBLE / prev, 2) END AS change_pct FROM (SELECT y, n, lag(n) OVER (ORDER BY y) AS prev FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1))")
def percent_change_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the previous year, joined on the year before; null on a missing or zero base."""
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    p = y.select((F.col("year") + 1).alias("year"), F.col("n").alias("prev"))
    j = y.join(p, "year", "left")
    change = half_even(F.try_divide((F.col("n") - F.col("prev")).cast("decimal(20,4)") * 100, F.nullif(F.col("prev"), F.lit(0)).cast("decimal(20,0)")), 2)
    return j.select("year", "n", "prev", change.cast("double").alias("change_pct"))


@query("rank_pages", "SELECT s_nationkey, page, count(*) AS n, min(s_suppkey) AS first_key FROM (SELECT s_nationkey, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 2 AS page FROM supplier) GROUP BY 1, 2")
def rank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    at = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return s.select("s_nationkey", "s_suppkey", F.floor(at / 2).alias("page")).groupBy("s_nationkey", "page").agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("first_key"))
