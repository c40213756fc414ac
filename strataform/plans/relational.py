"""Filters, paging, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataform.functions.rounding import dec
from strataform.operators.lookup import all_of, band_join, checked_lookup, complete_sum, longest_prefix, missing_combinations, reconcile
from strataform.plans.registry import query, table


@query("available_years", "SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS reference_year FROM orders WHERE o_orderstatus IS NOT NULL ORDER BY 1")
def available_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus IS NOT NULL")
    return o.select(F.year("o_orderdate").cast("long").alias("reference_year")).distinct().orderBy("reference_year")


@query(
    "resolve_year",
    """SELECT CAST(requested AS BIGINT) AS requested,
  CASE WHEN latest IS NULL THEN 'NO_DATA_AVAILABLE' WHEN requested IS NOT NULL AND NOT known THEN 'NO_DATA_FOR_PERIOD' END AS reason,
  CAST(CASE WHEN requested IS NULL THEN latest WHEN known THEN requested END AS BIGINT) AS resolved
FROM (VALUES (NULL), (1997), (1900)) q(requested)
CROSS JOIN (SELECT max(year(o_orderdate)) AS latest FROM orders)
CROSS JOIN LATERAL (SELECT requested IN (SELECT year(o_orderdate) FROM orders) AS known)""",
)
def resolve_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).agg(F.collect_set("y").alias("years"), F.max("y").alias("latest"))
    asked = spark.createDataFrame([(None,), (1997,), (1900,)], "requested long")
    known = F.array_contains("years", F.col("requested").cast("int"))
    return asked.crossJoin(F.broadcast(years)).select(
        "requested",
        F.when(F.col("latest").isNull(), "NO_DATA_AVAILABLE").when(F.col("requested").isNotNull() & ~known, "NO_DATA_FOR_PERIOD").alias("reason"),
        F.when(F.col("requested").isNull(), F.col("latest").cast("long")).when(known, F.col("requested")).alias("resolved"),
    )


@query("shared_year_intersection", "SELECT CAST(max(y) AS BIGINT) AS shared_year FROM (SELECT year(o_orderdate) AS y FROM orders INTERSECT SELECT year(l_shipdate) FROM lineitem)")
def shared_year_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"))
    b = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"))
    # years are grouped where they are read: in a join all rows of a year would meet in one task
    both = a.withColumn("side", F.lit(1)).union(b.withColumn("side", F.lit(2))).groupBy("y").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    return both.where("low < high").agg(F.max("y").cast("long").alias("shared_year"))


@query("facility_filters_page", "SELECT s_suppkey, s_name, s_acctbal, total, total > 5 + 10 AS has_more FROM (SELECT *, count(*) OVER () AS total FROM supplier WHERE s_acctbal IS NOT NULL AND s_nationkey IN (1, 3, 5, 7, 9) AND s_acctbal > 0) ORDER BY s_acctbal DESC, s_suppkey LIMIT 10 OFFSET 5")
def facility_filters_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional filters ANDed, a page in total order, the total and whether more follows."""
    s = table(spark, sf_dir, "supplier").where(all_of(F.col("s_acctbal").isNotNull(), F.col("s_nationkey").isin(1, 3, 5, 7, 9), None, F.col("s_acctbal") > 0))
    total = s.agg(F.count(F.lit(1)).alias("total"))
    page = s.orderBy(F.desc("s_acctbal"), "s_suppkey").offset(5).limit(10)
    return page.crossJoin(F.broadcast(total)).select("s_suppkey", "s_name", "s_acctbal", "total", (F.col("total") > 15).alias("has_more"))


@query("bbox_page", "SELECT p_partkey, x0, y0, x1, y1 FROM (SELECT p_partkey, p_partkey % 100 AS x0, p_size AS y0, p_partkey % 100 + 5 AS x1, p_size + 5 AS y1 FROM part) WHERE x0 <= 40 AND x1 >= 20 AND y0 <= 30 AND y1 >= 10 ORDER BY p_partkey LIMIT 50")
def bbox_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope overlap as four comparisons."""
    b = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100).alias("x0"), F.col("p_size").alias("y0"), (F.col("p_partkey") % 100 + 5).alias("x1"), (F.col("p_size") + 5).alias("y1"))
    return b.where("x0 <= 40 AND x1 >= 20 AND y0 <= 30 AND y1 >= 10").orderBy("p_partkey").limit(50)


@query("literal_ilike_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('_1')) OR contains(lower(p_brand), lower('#2'))")
def literal_ilike_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive literal substring over name or code; wildcards are plain text."""
    p = table(spark, sf_dir, "part")
    return p.where(F.contains(F.lower("p_name"), F.lit("_1")) | F.contains(F.lower("p_brand"), F.lit("#2"))).select("p_partkey", "p_name")


@query("dim_inner_join", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query("dim_left_unmapped", "SELECT s_suppkey, n_name, n_name IS NULL AS unmapped FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey")
def dim_left_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select("s_suppkey", "n_name", F.col("n_name").isNull().alias("unmapped"))


@query("freshness_left_default", "SELECT n_name, coalesce(status, 'UNKNOWN') AS status FROM nation LEFT JOIN (SELECT s_nationkey, 'FRESH' AS status FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) ON n_nationkey = s_nationkey")
def freshness_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    f = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey").distinct().withColumn("status", F.lit("FRESH"))
    return n.join(f, n.n_nationkey == f.s_nationkey, "left").select("n_name", F.coalesce("status", F.lit("UNKNOWN")).alias("status"))


@query(
    "checked_lookup_reason",
    """SELECT n_nationkey, CASE WHEN coalesce(c, 0) = 1 THEN v END AS s_suppkey,
  CASE WHEN coalesce(c, 0) = 0 THEN 'MISSING' WHEN c > 1 THEN 'AMBIGUOUS' END AS reason
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c, min(s_suppkey) AS v FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) ON n_nationkey = s_nationkey""",
)
def checked_lookup_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return checked_lookup(n, s, ["n_nationkey"], "s_suppkey", "MISSING", "AMBIGUOUS")


@query("reconcile_full_join", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def reconcile_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "bridge_complete_sum",
    """WITH v AS (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT n_regionkey, count(*) AS expected, count(customers) AS found,
  CASE WHEN count(*) = count(customers) THEN CAST(sum(customers) AS BIGINT) END AS customers,
  CASE WHEN count(*) <> count(customers) THEN 'INCOMPLETE_MEMBERS' END AS reason
FROM nation LEFT JOIN v ON n_nationkey = c_nationkey GROUP BY 1""",
)
def bridge_complete_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    v = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return complete_sum(n, v, "n_regionkey", "n_nationkey", "customers")


@query(
    "missing_stream_combinations",
    """WITH o AS (SELECT DISTINCT o_custkey AS c_custkey, o_orderpriority AS stream FROM orders)
SELECT c.c_custkey, s.stream, 'SOURCE_NOT_REPORTED' AS reason FROM customer c CROSS JOIN (SELECT DISTINCT stream FROM o) s
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c_custkey = c.c_custkey AND o.stream = s.stream)""",
)
def missing_stream_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that a reporter never delivered."""
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("stream")).distinct()
    return missing_combinations(table(spark, sf_dir, "customer").select("c_custkey"), seen.select("stream").distinct(), seen, ["c_custkey", "stream"])


@query("semi_join_bbox", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20) GROUP BY 1")
def semi_join_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size BETWEEN 10 AND 20").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(p, "l_partkey", "left_semi").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("exists_projection", "SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) AS hit FROM part")
def exists_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("h", F.lit(True))
    return table(spark, sf_dir, "part").select("p_partkey").join(hit, "p_partkey", "left").select("p_partkey", F.coalesce("h", F.lit(False)).alias("hit"))


@query("anti_join_children", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000)")
def anti_join_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 2000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(s, "n_nationkey", "left_anti")


BANDS = [("S", None, 10.0, False, False), ("M", 10.0, 30.0, True, False), ("L", 30.0, 45.0, True, False), ("XL", 40.0, None, True, False)]


@query(
    "band_join_unique",
    """WITH b(band, low, high) AS (VALUES ('S', NULL, 10.0), ('M', 10.0, 30.0), ('L', 30.0, 45.0), ('XL', 40.0, NULL)),
m AS (SELECT p_partkey, count(band) AS n, min(band) AS band FROM part LEFT JOIN b ON (low IS NULL OR p_size > low) AND (high IS NULL OR p_size <= high) GROUP BY 1)
SELECT p_partkey, CASE WHEN n = 1 THEN band END AS band, CASE WHEN n = 0 THEN 'NO_BAND' WHEN n > 1 THEN 'SEVERAL_BANDS' END AS reason FROM m""",
)
def band_join_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "band string, low double, high double, low_open boolean, high_open boolean")
    return band_join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), bands, F.col("p_size")).select("p_partkey", "band", "reason")


@query(
    "exact_month_denominator",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1),
d AS (SELECT month, orders FROM m WHERE CAST(right(month, 2) AS INT) % 3 = 0)
SELECT m.month, m.orders, d.orders AS denominator, CASE WHEN d.month IS NULL THEN 'NO_EXACT_MONTH' END AS reason FROM m LEFT JOIN d ON m.month = d.month""",
)
def exact_month_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denominator's month must match exactly; a neighbour's is never borrowed."""
    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orders"))
    d = m.where(F.substring("month", 6, 2).cast("int") % 3 == 0).select("month", F.col("orders").alias("denominator"))
    return m.join(d, "month", "left").withColumn("reason", F.when(F.col("denominator").isNull(), "NO_EXACT_MONTH"))


@query(
    "name_crosswalk_cascade",
    """WITH q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN 'N' || c_nationkey WHEN 2 THEN 'NATION_' || c_nationkey ELSE 'X' || c_custkey END AS raw FROM customer),
a AS (SELECT 'N' || n_nationkey AS alias, n_nationkey FROM nation WHERE n_nationkey < 20)
SELECT c_custkey, coalesce(n1.n_nationkey, a.n_nationkey, n2.n_nationkey) AS matched,
  CASE WHEN n1.n_nationkey IS NOT NULL THEN 'EXACT' WHEN a.n_nationkey IS NOT NULL THEN 'ALIAS' WHEN n2.n_nationkey IS NOT NULL THEN 'CASE_FOLDED' ELSE 'UNMATCHED' END AS how
FROM q LEFT JOIN nation n1 ON raw = n1.n_name LEFT JOIN a ON raw = alias LEFT JOIN nation n2 ON upper(raw) = n2.n_name""",
)
def name_crosswalk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact name, then alias, then case-folded name; each step a join on its own key."""
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("nation_"), "c_nationkey")).when(k == 1, F.concat(F.lit("N"), "c_nationkey")).when(k == 2, F.concat(F.lit("NATION_"), "c_nationkey")).otherwise(F.concat(F.lit("X"), "c_custkey"))
    q = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    n = table(spark, sf_dir, "nation")
    exact = n.select(F.col("n_name").alias("raw"), F.col("n_nationkey").alias("e"))
    alias = n.where("n_nationkey < 20").select(F.concat(F.lit("N"), "n_nationkey").alias("raw"), F.col("n_nationkey").alias("a"))
    folded = n.select(F.col("n_name").alias("up"), F.col("n_nationkey").alias("f"))
    j = q.join(exact, "raw", "left").join(alias, "raw", "left").withColumn("up", F.upper("raw")).join(folded, "up", "left")
    how = F.when(F.col("e").isNotNull(), "EXACT").when(F.col("a").isNotNull(), "ALIAS").when(F.col("f").isNotNull(), "CASE_FOLDED").otherwise("UNMATCHED")
    return j.select("c_custkey", F.coalesce("e", "a", "f").alias("matched"), how.alias("how"))


@query(
    "longest_prefix_match",
    """WITH r AS (SELECT DISTINCT prefix FROM (SELECT substr(p_type, 1, 3) AS prefix FROM part UNION ALL SELECT substr(p_type, 1, 5) FROM part WHERE p_size < 10))
SELECT p_partkey, p_type, arg_max(prefix, length(prefix)) AS matched_prefix FROM part LEFT JOIN r ON starts_with(p_type, prefix) GROUP BY ALL""",
)
def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    r = p.select(F.substring("p_type", 1, 3).alias("prefix")).union(p.where("p_size < 10").select(F.substring("p_type", 1, 5)))
    return longest_prefix(p.select("p_partkey", "p_type"), r, "p_type", "prefix")


@query("settings_cross_join", "SELECT n_nationkey, n_nationkey * mult AS scaled FROM nation, (SELECT max(r_regionkey) + 1 AS mult FROM region)")
def settings_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "region").agg((F.max("r_regionkey") + 1).alias("mult"))
    return table(spark, sf_dir, "nation").crossJoin(F.broadcast(one)).select("n_nationkey", (F.col("n_nationkey") * F.col("mult")).alias("scaled"))


@query(
    "level_pivot_assembly",
    """SELECT l_orderkey, coalesce(sum(CAST(l_quantity AS DECIMAL(20,2))) FILTER (l_linenumber = 1), 0)::DOUBLE AS level1, coalesce(sum(CAST(l_quantity AS DECIMAL(20,2))) FILTER (l_linenumber = 2), 0)::DOUBLE AS level2,
coalesce(sum(CAST(l_quantity AS DECIMAL(20,2))) FILTER (l_linenumber = 3), 0)::DOUBLE AS level3 FROM lineitem GROUP BY 1""",
)
def level_pivot_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dec(F.col("l_quantity"), 20, 2).alias("q"))
    p = l.groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.sum("q"))
    return p.select("l_orderkey", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("double").alias(f"level{i}") for i in (1, 2, 3)])


@query("grid_self_equality", "SELECT count(*) AS occurrences, count(*) FILTER (WHERE a.l_quantity IS DISTINCT FROM c.l_quantity) AS unequal FROM lineitem a JOIN (SELECT l_partkey, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity FROM lineitem GROUP BY 1) c USING (l_partkey)")
def grid_self_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a key against its first one, null-safe."""
    l = table(spark, sf_dir, "lineitem")
    first = l.groupBy("l_partkey").agg(F.min_by("l_quantity", F.struct("l_orderkey", "l_linenumber")).alias("canon"))
    return l.join(first, "l_partkey").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(~F.col("l_quantity").eqNullSafe(F.col("canon"))).alias("unequal"))


@query("decorrelated_lookup", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation")
def decorrelated_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a loop asks for each region, as two aggregates and two joins."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return n.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").na.fill(0, ["suppliers", "customers"])


@query(
    "two_key_path_join",
    """WITH a AS (SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), '|' ORDER BY CAST(n_nationkey AS VARCHAR)) AS codes FROM nation GROUP BY 1),
b AS (SELECT n_regionkey AS rk, string_agg(CAST(n_nationkey AS VARCHAR), '|' ORDER BY CAST(n_nationkey AS VARCHAR)) AS codes FROM nation GROUP BY 1)
SELECT r_regionkey, coalesce(d.rk, k.rk) AS matched, CASE WHEN d.rk IS NOT NULL THEN 'DIRECT' WHEN k.rk IS NOT NULL THEN 'CODE_SET' ELSE 'NONE' END AS path
FROM region LEFT JOIN a ON r_regionkey = a.n_regionkey LEFT JOIN (SELECT * FROM b WHERE rk < 2) d ON d.rk = r_regionkey LEFT JOIN b k ON k.codes = a.codes""",
)
def two_key_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    codes = n.groupBy("n_regionkey").agg(F.concat_ws("|", F.array_sort(F.collect_list(F.col("n_nationkey").cast("string")))).alias("codes"))
    r = table(spark, sf_dir, "region").join(codes, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    direct = codes.where("n_regionkey < 2").select(F.col("n_regionkey").alias("d"))
    by_set = codes.select(F.col("n_regionkey").alias("k"), F.col("codes").alias("kc"))
    j = r.join(direct, F.col("r_regionkey") == F.col("d"), "left").join(by_set, F.col("codes") == F.col("kc"), "left")
    return j.select("r_regionkey", F.coalesce("d", "k").alias("matched"), F.when(F.col("d").isNotNull(), "DIRECT").when(F.col("k").isNotNull(), "CODE_SET").otherwise("NONE").alias("path"))


@query(
    "typed_exclusion_join",
    """SELECT n_nationkey, CASE WHEN reason IS NULL THEN v END AS value, reason FROM (
  SELECT n_nationkey, v, CASE WHEN n_nationkey % 10 = 0 THEN 'DERIVED_CITY' WHEN s_nationkey IS NULL THEN 'NO_MATCH' WHEN v IS NULL THEN 'UNPARSEABLE' END AS reason
  FROM nation LEFT JOIN (SELECT s_nationkey, TRY_CAST(CASE WHEN s_nationkey % 4 = 1 THEN 'n/a' ELSE CAST(count(*) AS VARCHAR) END AS BIGINT) AS v FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) ON n_nationkey = s_nationkey)""",
)
def typed_exclusion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("string").alias("raw"))
    s = s.withColumn("raw", F.when(F.col("s_nationkey") % 4 == 1, "n/a").otherwise(F.col("raw")))
    j = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").withColumn("v", F.col("raw").try_cast("long"))
    reason = F.when(F.col("n_nationkey") % 10 == 0, "DERIVED_CITY").when(F.col("s_nationkey").isNull(), "NO_MATCH").when(F.col("v").isNull(), "UNPARSEABLE")
    return j.withColumn("reason", reason).select("n_nationkey", F.when(F.col("reason").isNull(), F.col("v")).alias("value"), "reason")


@query("nulls_last_sorts", "SELECT s_suppkey, bal, row_number() OVER (PARTITION BY s_nationkey ORDER BY bal DESC NULLS LAST, s_suppkey) AS down, row_number() OVER (PARTITION BY s_nationkey ORDER BY bal ASC NULLS LAST, s_suppkey) AS up FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS bal FROM supplier)")
def nulls_last_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within each region, nulls last in both directions."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("bal"))
    w = Window.partitionBy("s_nationkey")
    down = F.row_number().over(w.orderBy(F.desc_nulls_last("bal"), "s_suppkey")).cast("long")
    up = F.row_number().over(w.orderBy(F.asc_nulls_last("bal"), "s_suppkey")).cast("long")
    return s.select("s_suppkey", "bal", down.alias("down"), up.alias("up"))


PRIORITY = ["PROTECTED", "ZONING", "ROAD"]


@query(
    "reason_priority_order",
    """WITH r AS (SELECT p_partkey, unnest(list_filter([CASE WHEN p_size > 40 THEN 'ROAD' END, CASE WHEN p_size % 3 = 0 THEN 'AREA' END, CASE WHEN p_size % 2 = 0 THEN 'PROTECTED' END, CASE WHEN p_size % 5 = 0 THEN 'ZONING' END], lambda x: x IS NOT NULL)) AS reason FROM part)
SELECT p_partkey, string_agg(reason, ',' ORDER BY CASE reason WHEN 'PROTECTED' THEN 1 WHEN 'ZONING' THEN 2 WHEN 'ROAD' THEN 3 ELSE 99 END, reason) AS reasons FROM r GROUP BY 1""",
)
def reason_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons in a fixed priority, then alphabetically."""
    size = F.col("p_size")
    raw = F.array_compact(F.array(F.when(size > 40, "ROAD"), F.when(size % 3 == 0, "AREA"), F.when(size % 2 == 0, "PROTECTED"), F.when(size % 5 == 0, "ZONING")))
    order = F.array(*map(F.lit, PRIORITY))
    keyed = F.transform(raw, lambda x: F.struct(F.when(F.array_contains(order, x), F.array_position(order, x)).otherwise(99).alias("k"), x.alias("v")))
    ordered = F.transform(F.array_sort(keyed), lambda s: s["v"])
    return table(spark, sf_dir, "part").select("p_partkey", ordered.alias("r")).where(F.size("r") > 0).select("p_partkey", F.array_join("r", ",").alias("reasons"))


@query("union_levels", "SELECT 1 AS level, n_name AS label, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT 2, r_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 3, 'ALL', count(*) FROM supplier")
def union_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    own = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")).join(n, F.col("s_nationkey") == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    one = own.select(F.lit(1).alias("level"), F.col("n_name").alias("label"), "n")
    two = own.groupBy("r_name").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.col("r_name").alias("label"), "n")
    return one.unionByName(two).unionByName(s.agg(F.count(F.lit(1)).alias("n")).select(F.lit(3).alias("level"), F.lit("ALL").alias("label"), "n"))


@query("coverage_gaps", "SELECT DISTINCT n_nationkey AS code FROM nation WHERE n_regionkey < 3 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("code"))
    return wanted.subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 7000").select("s_nationkey"))


@query(
    "matrix_merge",
    """WITH c AS (SELECT o_custkey % 20 AS region_code, o_orderpriority AS layer, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2)
SELECT region_code, count(*) AS layers, bool_and(status = 'F') AS all_final, bool_or(status = 'F') AS any_final FROM c GROUP BY 1""",
)
def matrix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last contribution of each region and layer wins; then a roll-up."""
    c = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("region_code"), F.col("o_orderpriority").alias("layer")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    f = F.col("status") == "F"
    return c.groupBy("region_code").agg(F.count(F.lit(1)).alias("layers"), F.bool_and(f).alias("all_final"), F.bool_or(f).alias("any_final"))


@query(
    "symmetric_code_diff",
    """WITH a AS (SELECT DISTINCT s_nationkey AS code FROM supplier WHERE s_acctbal > 6000), b AS (SELECT DISTINCT c_nationkey AS code FROM customer WHERE c_acctbal > 9500)
SELECT code, 'only_first' AS side FROM a WHERE code NOT IN (SELECT code FROM b) UNION ALL SELECT code, 'only_second' FROM b WHERE code NOT IN (SELECT code FROM a)""",
)
def symmetric_code_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 6000").select(F.col("s_nationkey").alias("code")).distinct()
    b = table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("code")).distinct()
    return a.subtract(b).withColumn("side", F.lit("only_first")).union(b.subtract(a).withColumn("side", F.lit("only_second")))


@query(
    "overlap_guard",
    """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'),
o AS (SELECT l_suppkey, count(*) AS overlap FROM a JOIN n USING (l_suppkey, l_partkey) GROUP BY 1)
SELECT s_suppkey, coalesce(overlap, 0) AS overlap, coalesce(overlap, 0) > 0 AS rejected FROM supplier LEFT JOIN o ON s_suppkey = l_suppkey""",
)
def overlap_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request with two sets, what it includes and what it leaves out: rejected if they share a member."""
    flag = F.col("l_returnflag")
    members = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.bool_or(flag == "A").alias("a"), F.bool_or(flag == "N").alias("n"))
    shared = members.where("a AND n").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("shared"))
    overlap = F.coalesce("shared", F.lit(0).cast("long"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(shared, "s_suppkey", "left").select("s_suppkey", overlap.alias("overlap"), (overlap > 0).alias("rejected"))


@query(
    "reporting_union",
    """SELECT 'native' AS kind, n_name AS name, 1 AS members FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'city', r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY r_name""",
)
def reporting_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native regions without the children of derived cities, and those cities."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_regionkey = 2")
    children = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left_semi")
    native = n.join(children.select("n_nationkey"), "n_nationkey", "left_anti").select(F.lit("native").alias("kind"), F.col("n_name").alias("name"), F.lit(1).cast("long").alias("members"))
    city = children.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count(F.lit(1)).alias("members")).select(F.lit("city").alias("kind"), F.col("r_name").alias("name"), "members")
    return native.unionByName(city)


@query("top_types_limit", "SELECT p_type, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_type LIMIT 10")
def top_types_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("unmapped_page_blank_reason", "SELECT s_suppkey, nullif(trim(note), '') AS reason FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' no address ' END AS note FROM supplier WHERE s_acctbal < 0) ORDER BY s_suppkey LIMIT 20 OFFSET 0")
def unmapped_page_blank_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("s_suppkey") % 3 == 0, "  ").when(F.col("s_suppkey") % 3 == 1, " no address ")
    return table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_suppkey", F.nullif(F.trim(note), F.lit("")).alias("reason")).orderBy("s_suppkey").limit(20)


@query("latest_run_resolution", "SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F' ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey DESC LIMIT 1")
def latest_run_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.orderBy(done.desc_nulls_last(), F.desc("o_orderkey")).limit(1).select(F.col("o_orderkey").alias("run_id"))


@query("active_release_check", "SELECT dataset, count(*) FILTER (WHERE active) AS n_active, CASE WHEN count(*) FILTER (WHERE active) = 0 THEN 'NOT_FOUND' WHEN count(*) FILTER (WHERE active) > 1 THEN 'CONFLICT' ELSE 'OK' END AS state, min(s_suppkey) AS canonical_run FROM (SELECT s_nationkey AS dataset, s_suppkey, s_acctbal > 9000 AS active FROM supplier) GROUP BY 1")
def active_release_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("dataset")).agg(F.count_if(F.col("s_acctbal") > 9000).alias("n_active"), F.min("s_suppkey").alias("canonical_run"))
    return s.withColumn("state", F.when(F.col("n_active") == 0, "NOT_FOUND").when(F.col("n_active") > 1, "CONFLICT").otherwise("OK"))


@query("canonical_code_in_list", "SELECT c_custkey, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN 'N-' || raw ELSE raw END AS code, CASE WHEN length(regexp_replace(raw, '[^0-9]', '', 'g')) = 1 THEN 'SHORT' ELSE 'LONG' END AS code_level FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'N-' || c_nationkey END AS raw FROM customer) WHERE raw IN ('3', 'N-3', '12', 'N-12')")
def canonical_code_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.concat(F.lit("N-"), "c_nationkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).where(F.col("raw").isin("3", "N-3", "12", "N-12"))
    code = F.when(F.rlike("raw", F.lit("^[0-9]+$")), F.concat(F.lit("N-"), "raw")).otherwise(F.col("raw"))
    level = F.when(F.length(F.regexp_replace("raw", r"\D", "")) == 1, "SHORT").otherwise("LONG")
    return c.select("c_custkey", code.alias("code"), level.alias("code_level"))


@query("whitelisted_sort", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name DESC, s_suppkey LIMIT 15")
def whitelisted_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort key from a fixed list, - for descending, with a unique tie-break."""
    allowed = {"name": "s_name", "balance": "s_acctbal"}
    key = "-name"
    column = F.col(allowed[key.lstrip("-")])
    return table(spark, sf_dir, "supplier").orderBy(column.desc() if key.startswith("-") else column.asc(), "s_suppkey").limit(15).select("s_suppkey", "s_name")
