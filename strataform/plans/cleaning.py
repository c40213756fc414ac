"""Parsing, validation, profiling, change plans and plane geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strataform.functions.quantities import blank_to_null, parse_quantity
from strataform.plans.registry import query, table

#: Fixed value: the sphere's radius in metres that web mercator uses.
MERCATOR_RADIUS = 6378137.0


@query(
    "quantity_parse",
    """SELECT event_id, CASE n WHEN 0 THEN CAST('1234' || CAST(event_id AS VARCHAR) || '.5' AS DECIMAL(20,6)) WHEN 5 THEN CAST(1500 AS DECIMAL(20,6)) END AS quantity,
  CASE n WHEN 1 THEN 'MISSING' WHEN 2 THEN 'NEGATIVE' WHEN 3 THEN 'NOT_NUMERIC' WHEN 4 THEN 'MISSING' WHEN 6 THEN 'OUT_OF_RANGE' WHEN 7 THEN 'NEGATIVE' WHEN 8 THEN 'MISSING' END AS reason
  FROM (SELECT event_id, event_id % 9 AS n FROM events)""",
)
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 9
    raw = F.when(n == 0, F.concat(F.lit(" 1,234"), F.col("event_id").cast("string"), F.lit(".5 "))).when(n == 1, "-").when(n == 2, "-7").when(n == 3, F.col("event_type")).when(n == 4, " ")
    raw = raw.when(n == 5, "1.5e3").when(n == 6, "12345678901234567890").when(n == 7, "-12345678901234567890").otherwise("n/a")
    value, reason = parse_quantity(F.col("raw"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", value.alias("quantity"), reason.alias("reason"))


@query(
    "value_state_classifier",
    """SELECT state, count(*) AS n FROM (SELECT CASE WHEN trim(v) = '' THEN 'BLANK' WHEN trim(v) = '-' THEN 'DASH' WHEN NOT regexp_matches(trim(v), '^[0-9]+$') THEN 'TEXT_NO_DATA'
  WHEN CAST(trim(v) AS BIGINT) = 0 THEN 'MEASURED_ZERO' ELSE 'MEASURED' END AS state
  FROM (SELECT CASE event_type WHEN 'error' THEN '-' WHEN 'signup' THEN ' ' WHEN 'click' THEN 'none' ELSE regexp_extract(props, '[0-9]+') END AS v FROM events)) GROUP BY state""",
)
def value_state_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cell says: a measure, a measured zero, a dash, a text or nothing."""
    kind = F.col("event_type")
    v = F.trim(F.when(kind == "error", "-").when(kind == "signup", " ").when(kind == "click", "none").otherwise(F.regexp_extract("props", "[0-9]+", 0)))
    state = F.when(v == "", "BLANK").when(v == "-", "DASH").when(~v.rlike("^[0-9]+$"), "TEXT_NO_DATA").when(v.rlike("^0+$"), "MEASURED_ZERO").otherwise("MEASURED")
    return table(spark, sf_dir, "events").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("whitespace_collapse", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS digest FROM documents")
def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))).alias("digest"))


@query(
    "csv_safe_cells",
    """SELECT doc_id, md5(CASE WHEN regexp_matches(safe, '[",\\n\\r]') THEN '"' || replace(safe, '"', '""') || '"' ELSE safe END) AS cell_digest, guarded
FROM (SELECT doc_id, guarded, CASE WHEN guarded THEN '''' || text ELSE text END AS safe FROM (SELECT doc_id, text, regexp_matches(text, '^[=+@\\t\\r-]') AS guarded FROM documents))""",
)
def csv_safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a spreadsheet would take for a formula get an apostrophe; then quotes, commas and line ends are escaped."""
    guarded = F.col("text").rlike(r"^[=+@\t\r-]")
    safe = F.when(guarded, F.concat(F.lit("'"), "text")).otherwise(F.col("text"))
    cells = table(spark, sf_dir, "documents").select("doc_id", guarded.alias("guarded"), safe.alias("safe"))
    quoted = F.concat(F.lit('"'), F.replace("safe", F.lit('"'), F.lit('""')), F.lit('"'))
    return cells.select("doc_id", F.md5(F.when(F.col("safe").rlike(r'[",\n\r]'), quoted).otherwise(F.col("safe"))).alias("cell_digest"), "guarded")


@query(
    "wide_to_long_months",
    """SELECT l_returnflag, CAST(month(l_shipdate) AS INT) AS month, CAST(sum(CAST(l_quantity AS DECIMAL(20,2))) AS DECIMAL(30,2)) AS quantity
FROM lineitem GROUP BY ALL""",
)
def wide_to_long_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each month, read back as a row for each; the month is in the column's name."""
    months = [f"m{m:02d}_total" for m in range(1, 13)]
    amount = F.col("l_quantity").cast("decimal(20,2)")
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.sum(F.when(F.month("l_shipdate") == m, amount)).cast("decimal(30,2)").alias(c) for m, c in enumerate(months, 1)])
    long = wide.unpivot("l_returnflag", months, "label", "quantity").where("quantity IS NOT NULL")
    return long.select("l_returnflag", F.regexp_extract("label", r"^m(\d{2})_", 1).cast("int").alias("month"), "quantity")


@query(
    "row_triage",
    """SELECT verdict, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DECIMAL(30,2)) AS total FROM (SELECT o_totalprice,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'REJECT_PRIORITY' WHEN o_totalprice < 1000 THEN 'REJECT_AMOUNT' WHEN o_orderstatus = 'P' THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict FROM orders) GROUP BY verdict""",
)
def row_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row gets the first verdict that holds; nothing is dropped."""
    verdict = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "REJECT_PRIORITY").when(F.col("o_totalprice") < 1000, "REJECT_AMOUNT").when(F.col("o_orderstatus") == "P", "REVIEW").otherwise("ACCEPT")
    total = F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("decimal(30,2)")
    return table(spark, sf_dir, "orders").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@query(
    "column_profile",
    """SELECT 'lang' AS column_name, count(*) AS n_rows, count(*) FILTER (trim(coalesce(lang, '')) = '') AS n_empty, count(DISTINCT lang) AS n_distinct, CAST(max(length(lang)) AS INT) AS max_length FROM documents
UNION ALL SELECT 'source', count(*), count(*) FILTER (trim(coalesce(source, '')) = ''), count(DISTINCT source), CAST(max(length(source)) AS INT) FROM documents""",
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, empty cells, distinct values and the longest cell of each column, in one scan; values are counted after a partial count by value."""
    long = table(spark, sf_dir, "documents").unpivot([], ["lang", "source"], "column_name", "cell")
    by_value = long.groupBy("column_name", "cell").agg(F.count(F.lit(1)).alias("n"))
    empty = F.sum(F.when(F.trim(F.coalesce("cell", F.lit(""))) == "", F.col("n")).otherwise(0))
    return by_value.groupBy("column_name").agg(F.sum("n").alias("n_rows"), empty.alias("n_empty"), F.count("cell").alias("n_distinct"), F.max(F.length("cell")).alias("max_length"))


@query("fd_violations", "SELECT p_name, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def fd_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that don't determine their brand."""
    pairs = table(spark, sf_dir, "part").where("p_brand IS NOT NULL").select("p_name", "p_brand").distinct()
    return pairs.groupBy("p_name").agg(F.count(F.lit(1)).alias("n_brands")).where("n_brands > 1")


@query(
    "duplicate_scope",
    "SELECT digest, n, n - 1 AS surplus, n_sources > 1 AS across_sources FROM (SELECT md5(text) AS digest, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents WHERE text IS NOT NULL GROUP BY ALL) WHERE n > 1",
)
def duplicate_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated texts with their surplus rows, and whether they cross sources."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    found = docs.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.min("source") < F.max("source"), F.lit(False))).alias("across_sources"))
    return found.where("n > 1").select("digest", "n", (F.col("n") - 1).alias("surplus"), "across_sources")


_STORED = """SELECT o_orderkey AS k, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(20,2)) AS price FROM orders WHERE o_orderdate < DATE '2001-01-01'"""
_DELIVERED = """SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS status, CAST(o_totalprice AS DECIMAL(20,2)) AS price FROM orders WHERE o_orderdate >= DATE '1996-01-01'"""


def _version(orders: DataFrame, status: Column) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("k"), status.alias("status"), F.col("o_totalprice").cast("decimal(20,2)").alias("price"))


def stored(orders: DataFrame) -> DataFrame:
    """What is known of the orders before the last year's delivery; every order is stored, delivered or both."""
    return _version(orders.where("o_orderdate < DATE '2001-01-01'"), F.col("o_orderstatus"))


def delivered(orders: DataFrame) -> DataFrame:
    """The next delivery: open orders are filled, those before 1996 gone."""
    return _version(orders.where("o_orderdate >= DATE '1996-01-01'"), F.when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus")))


def change_plan(stored: DataFrame, arriving: DataFrame, key: str, material: list[str]) -> DataFrame:
    """key and action (insert, update, keep, absent): an update only where a material column differs, nulls being equal."""
    old = stored.select(key, F.struct(*material).alias("__old"))
    new = arriving.select(key, F.struct(*material).alias("__new"))
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "absent").when(F.col("__old").eqNullSafe(F.col("__new")), "keep").otherwise("update")
    return old.join(new, key, "full_outer").select(key, action.alias("action"))


@query(
    "upsert_plan",
    f"""SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.k IS NULL THEN 'insert' WHEN d.k IS NULL THEN 'absent' WHEN o.status IS NOT DISTINCT FROM d.status AND o.price IS NOT DISTINCT FROM d.price THEN 'keep' ELSE 'update' END AS action
FROM ({_STORED}) o FULL JOIN ({_DELIVERED}) d ON o.k = d.k) GROUP BY action""",
)
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return change_plan(stored(orders), delivered(orders), "k", ["status", "price"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("insert_ignore", f"SELECT o.k IS NULL AS inserted, count(*) AS n FROM ({_DELIVERED}) d LEFT JOIN ({_STORED}) o ON o.k = d.k GROUP BY ALL")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving keys that are stored are skipped; both kinds are counted."""
    orders = table(spark, sf_dir, "orders")
    known = stored(orders).select("k", F.lit(True).alias("known"))
    return delivered(orders).join(known, "k", "left").groupBy(F.col("known").isNull().alias("inserted")).agg(F.count(F.lit(1)).alias("n"))


@query("freshness_rollup", "SELECT event_type, max(ts) AS last_seen, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS n FROM events GROUP BY event_type")
def freshness_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last_seen"), F.max(F.struct("ts", "event_id"))["event_id"].alias("last_event"), F.count(F.lit(1)).alias("n"))


@query(
    "latest_snapshot",
    "SELECT event_type, path FROM (SELECT event_type, 'snap/' || strftime(ts, '%Y%m%d') || '/' || CAST(event_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY event_type ORDER BY strftime(ts, '%Y%m%d') DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the listed paths the one with the latest date in it; of these the last listed."""
    paths = table(spark, sf_dir, "events").select("event_type", "event_id", F.concat_ws("/", F.lit("snap"), F.date_format("ts", "yyyyMMdd"), F.col("event_id").cast("string")).alias("path"))
    best = F.max_by("path", F.struct(F.regexp_extract("path", r"/(\d{8})/", 1), "event_id"))
    return paths.groupBy("event_type").agg(best.alias("path"))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of a longitude and latitude in degrees."""
    return F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * MERCATOR_RADIUS


@query(
    "web_mercator",
    "SELECT s_suppkey, round(radians(124.0 + s_nationkey / 5.0) * 6378137.0, 3) AS x, round(ln(tan(radians(33.0 + s_suppkey % 50 / 10.0) / 2 + pi() / 4)) * 6378137.0, 3) AS y FROM supplier",
)
def web_mercator_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = web_mercator(124.0 + F.col("s_nationkey") / 5.0, 33.0 + F.col("s_suppkey") % 50 / 10.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "cell_class_area",
    """SELECT cell, cls, area, area / sum(area) OVER (PARTITION BY cell) AS share FROM (SELECT CAST(p_partkey % 40 AS BIGINT) AS cell, p_type AS cls, CAST(sum(p_size) AS DOUBLE) AS area FROM part GROUP BY ALL)""",
)
def cell_class_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area by cell and class, and its share of the cell."""
    areas = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).alias("cell"), F.col("p_type").alias("cls")).agg(F.sum("p_size").cast("double").alias("area"))
    return areas.withColumn("share", F.col("area") / F.sum("area").over(Window.partitionBy("cell")))


@query(
    "clip_boxes",
    "SELECT p_partkey, w, h, w * h AS area FROM (SELECT p_partkey, least(p_partkey % 100 + 5, 40) - greatest(p_partkey % 100, 20) AS w, CAST(least(p_size + 5, 30) - greatest(p_size, 10) AS BIGINT) AS h FROM part) WHERE w > 0 AND h > 0",
)
def clip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut to a window; those without an area in it go."""
    x, y = F.col("p_partkey") % 100, F.col("p_size")
    w = F.least(x + 5, F.lit(40)) - F.greatest(x, F.lit(20))
    h = (F.least(y + 5, F.lit(30)) - F.greatest(y, F.lit(10))).cast("long")
    cut = table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"))
    return cut.where("w > 0 AND h > 0").withColumn("area", F.col("w") * F.col("h"))
