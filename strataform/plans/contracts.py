"""Contracts of delivered data: reconciliation, duplicates, totals, drift, invariants, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataform.functions.staging import staged
from strataform.plans.registry import query, table


@query(
    "treatment_reconciliation",
    """WITH t AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS parts FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) - parts AS DOUBLE) AS diff, CASE WHEN parts IS NULL THEN 'NO_PARTS' WHEN abs(CAST(o_totalprice AS DECIMAL(20,2)) - parts) > 1.0 THEN 'RECONCILIATION_MISMATCH' END AS flag
FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""",
)
def treatment_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total against the sum of its parts, with a tolerance of 1.0; rows that differ stay and are flagged."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).alias("parts"))
    diff = F.col("o_totalprice").cast("decimal(20,2)") - F.col("parts")
    flag = F.when(F.col("parts").isNull(), "NO_PARTS").when(F.abs(diff) > 1, "RECONCILIATION_MISMATCH")
    return table(spark, sf_dir, "orders").join(parts, "o_orderkey", "left").select("o_orderkey", diff.cast("double").alias("diff"), flag.alias("flag"))


@query("duplicate_code_rejection", "SELECT p_brand AS code, count(*) AS n, min(p_partkey) AS first_key, 'DUPLICATE_CODE' AS reason FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_code_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"))
    return g.where("n > 1").withColumn("reason", F.lit("DUPLICATE_CODE"))


_STATE = "CASE l_returnflag WHEN 'A' THEN NULL WHEN 'R' THEN CAST(l_quantity AS DECIMAL(20,2)) ELSE CAST(l_quantity AS DECIMAL(20,2)) END"


@query(
    "recomputed_total",
    f"""WITH s AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'A') AS measured, sum({_STATE}) AS total, sum(CAST(l_quantity AS DECIMAL(20,2))) AS stated FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN measured > 0 THEN CAST(total AS DOUBLE) END AS total, CASE WHEN measured = 0 THEN 'NO_MEASURED_VALUE' WHEN total <> stated THEN 'TOTAL_MISMATCH' END AS reason FROM s""",
)
def recomputed_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated total against the sum of its measured cells; a sum of nothing but dashes is missing, not zero."""
    q = F.col("l_quantity").cast("decimal(20,2)")
    own = F.when(F.col("l_returnflag") != "A", q)
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(own).alias("sum"), F.sum(q).alias("stated"))
    reason = F.when(F.col("sum").isNull(), "NO_MEASURED_VALUE").when(F.col("sum") != F.col("stated"), "TOTAL_MISMATCH")
    return s.select("l_orderkey", F.col("sum").cast("double").alias("total"), reason.alias("reason"))


@query(
    "duplicate_series",
    """WITH p AS (SELECT p_partkey, p_brand, strftime(l_shipdate, '%m') AS m, CAST(min(l_linenumber) <= 3 AS INT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
s AS (SELECT p_partkey, p_brand, sha256(string_agg(m || '=' || v, ';' ORDER BY m)) AS digest FROM p GROUP BY 1, 2 HAVING count(*) >= 12)
SELECT digest, count(*) AS series, count(DISTINCT p_brand) AS owners FROM s GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""",
)
def duplicate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of twelve or more points that different owners deliver alike."""
    low = F.min("l_linenumber") <= 3
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.date_format("l_shipdate", "MM").alias("m")).agg(low.cast("int").cast("string").alias("v"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat("m", F.lit("="), "v"))), ";")
    series = points.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("k"), F.sha2(text, 256).alias("digest")).where("k >= 12")
    named = series.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return named.groupBy("digest").agg(F.count(F.lit(1)).alias("series"), F.countDistinct("p_brand").alias("owners")).where("owners > 1")


_VALUE = "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value, CASE WHEN c_acctbal >= 0 OR c_mktsegment = 'BUILDING' THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status FROM customer"


@query("value_status_invariant", f"SELECT status, value IS NOT NULL AS has_value, count(*) AS n FROM ({_VALUE}) WHERE (status = 'AVAILABLE') <> (value IS NOT NULL) GROUP BY 1, 2")
def value_status_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose status says that there's a value where there is none, or none where there is one."""
    value = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    status = F.when(value.isNotNull() | (F.col("c_mktsegment") == "BUILDING"), "AVAILABLE").otherwise("UNAVAILABLE")
    v = table(spark, sf_dir, "customer").select(status.alias("status"), value.isNotNull().alias("has_value"))
    return v.where((F.col("status") == "AVAILABLE") != F.col("has_value")).groupBy("status", "has_value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "canonical_copy",
    "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1",
)
def canonical_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of byte-identical deliveries the one with the smallest id stands for all."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.countDistinct("source").alias("sources"))


@query(
    "recompute_delta",
    """WITH a AS (SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(20,2))) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(20,2))) AS v FROM lineitem WHERE l_linestatus <> 'F' OR l_tax > 0 GROUP BY 1)
SELECT count(*) AS compared, count(*) FILTER (WHERE a.v IS DISTINCT FROM b.v) AS changed, CAST(max(abs(a.v - coalesce(b.v, 0))) AS DOUBLE) AS max_delta FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey""",
)
def recompute_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored result against its recomputation: rows that differ and the largest difference."""
    l = table(spark, sf_dir, "lineitem")
    total = F.sum(F.col("l_quantity").cast("decimal(20,2)"))
    both = l.groupBy("l_suppkey").agg(total.alias("a")).join(l.where("l_linestatus <> 'F' OR l_tax > 0").groupBy("l_suppkey").agg(total.alias("b")), "l_suppkey", "full")
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.max(F.abs(F.col("a") - F.coalesce("b", F.lit(0).cast("decimal(20,2)")))).cast("double").alias("max_delta"))


_WANTED = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "int"), ("title", "string")]


@query("schema_drift", "SELECT * FROM (VALUES ('n_chars', 'EXTRA'), ('source', 'TYPE_MISMATCH'), ('title', 'MISSING')) t(field, problem)")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a delivery that are missing, extra or of another type than its contract says; only the schema is read."""
    held = spark.createDataFrame(table(spark, sf_dir, "documents").dtypes, "field string, held string")
    both = spark.createDataFrame(_WANTED, "field string, wanted string").join(held, "field", "full")
    problem = F.when(F.col("held").isNull(), "MISSING").when(F.col("wanted").isNull(), "EXTRA").when(F.col("held") != F.col("wanted"), "TYPE_MISMATCH")
    return both.select("field", problem.alias("problem")).where("problem IS NOT NULL")


@query(
    "seed_check",
    """WITH held AS (SELECT l_partkey, min(l_returnflag) AS flag FROM lineitem WHERE l_quantity >= 45 GROUP BY 1),
r AS (SELECT p_brand, p_size, CASE WHEN p_size <= 25 THEN 'A' ELSE 'N' END AS wanted, flag FROM part LEFT JOIN held ON p_partkey = l_partkey),
g AS (SELECT p_brand, p_size, count(*) AS n, count(*) FILTER (WHERE flag IS NULL) AS missing, count(*) FILTER (WHERE flag <> wanted) AS changed FROM r GROUP BY 1, 2)
SELECT p_brand, p_size, missing, changed, CASE WHEN missing = n THEN 'SEED' WHEN missing + changed = 0 THEN 'NO_OP' ELSE 'MISMATCH' END AS outcome FROM g""",
)
def seed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows against the seed that defines them, by group: none are stored, all as they should be, or the seed must not go on."""
    held = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_returnflag").alias("flag"))
    wanted = F.when(F.col("p_size") <= 25, "A").otherwise("N")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", wanted.alias("wanted")).join(held, "p_partkey", "left")
    groups = rows.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag").isNull()).alias("missing"), F.count_if(F.col("flag") != F.col("wanted")).alias("changed"))
    outcome = F.when(F.col("missing") == F.col("n"), "SEED").when(F.col("missing") + F.col("changed") == 0, "NO_OP").otherwise("MISMATCH")
    return groups.select("p_brand", "p_size", "missing", "changed", outcome.alias("outcome"))


@query(
    "batch_slices",
    "SELECT CAST((k - 1) // 1000 AS BIGINT) AS batch, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1",
)
def batch_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order cut to batches of 1,000, without sorting them in one task: ranges first, then places within a range."""
    spread = table(spark, sf_dir, "orders").select("o_orderkey").repartitionByRange("o_orderkey").withColumn("part", F.spark_partition_id())
    # range bounds are sampled, so the ranges are fixed by a checkpoint before they are counted
    spread = staged(spread)
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("o_orderkey")) + F.col("before")
    k = spread.join(F.broadcast(before), "part").select("o_orderkey", place.alias("k"))
    return k.groupBy(F.floor((F.col("k") - 1) / 1000).alias("batch")).agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count(F.lit(1)).alias("n"))


@query(
    "merged_batch_totals",
    "SELECT l_returnflag AS state, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(20,2))) AS DOUBLE) AS total, max(l_tax) AS largest FROM lineitem GROUP BY 1",
)
def merged_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of batches (ship months) merged by their kind: counts and sums add, maxima win."""
    q = F.col("l_quantity").cast("decimal(20,2)")
    batches = table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("batch"), F.col("l_returnflag").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum(q).alias("total"), F.max("l_tax").alias("largest"))
    return batches.groupBy("state").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"), F.max("largest").alias("largest"))
