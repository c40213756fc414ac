"""Rule cascades, scopes, registries and searches over the tables: every branch is in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataform.operators import overlay, triage
from strataform.operators.ranking import rank_all
from strataform.operators.scoring import weight_fault
from strataform.plans.overlay import _parts
from strataform.plans.registry import query, table

_REQUIRED = ["CITY", "KIND", "QTY", "WASTE"]


@query(
    "schema_contract_check",
    """SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'FIELDS_MISSING' WHEN 2 THEN 'PID_MISMATCH' WHEN 3 THEN 'YEAR_MISMATCH' WHEN 4 THEN 'UNIT_MISMATCH' WHEN 5 THEN 'HEADER_MISSING' END AS reason,
  CASE event_id % 7 WHEN 1 THEN 'QTY,WASTE' WHEN 5 THEN 'CITY,KIND,QTY,WASTE' ELSE '' END AS missing FROM events""",
)
def schema_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first breach of each response's contract: header fields, data set, year, unit."""
    kind = F.col("event_id") % 7
    header = F.when(kind == 1, '{"CITY":"a","KIND":"b","EXTRA":"c"}').when(kind == 5, None).otherwise('{"WASTE":"w","QTY":"q","KIND":"k","CITY":"c","EXTRA":"e"}')
    rows = table(spark, sf_dir, "events").select("event_id", F.json_object_keys(header).alias("declared"), F.when(kind == 2, "NTN008").otherwise("NTN007").alias("pid"), F.when(kind == 3, 2023).when(kind == 5, None).otherwise(2024).alias("year"), F.when(kind == 4, "kg").otherwise("톤/년").alias("unit"))
    reason, missing = triage.schema_contract(F.col("declared"), _REQUIRED, F.col("pid"), "NTN007", F.col("year"), 2024, F.col("unit"), "톤/년")
    return rows.select("event_id", reason.alias("reason"), F.array_join(missing, ",").alias("missing"))


@query(
    "facility_triage",
    """WITH r AS (SELECT o_orderkey, o_custkey % 20 AS file, o_orderkey % 3 = 0 AS landfill, o_orderkey % 11 AS k, CAST(floor(o_totalprice) AS BIGINT) AS q FROM orders),
c AS (SELECT *, CASE WHEN k = 1 OR k = 2 THEN 'AGGREGATE' WHEN k IN (3, 4, 5) OR (k = 6 AND landfill) OR (k = 7 AND NOT landfill) THEN 'REJECTED' ELSE 'RECORD' END AS outcome FROM r)
SELECT o_orderkey, outcome, CASE WHEN outcome = 'REJECTED' THEN CASE k WHEN 3 THEN 'missing facility name' WHEN 4 THEN 'missing address' WHEN 5 THEN CASE WHEN landfill THEN 'LANDFILL_QTY NEGATIVE' ELSE 'DISPOSAL_QTY NEGATIVE' END
  WHEN 6 THEN 'FILL_AREA NOT_NUMERIC' ELSE 'RESIDUE_RECY NOT_NUMERIC' END END AS reason,
  CASE WHEN outcome <> 'AGGREGATE' THEN count(*) FILTER (WHERE outcome <> 'AGGREGATE') OVER (PARTITION BY file ORDER BY o_orderkey) - 1 END AS position,
  CASE WHEN outcome = 'RECORD' THEN CAST(q AS DOUBLE) END AS throughput, CASE WHEN outcome = 'RECORD' AND landfill THEN 1234.5 END::DOUBLE AS fill_area, CASE WHEN outcome = 'RECORD' AND NOT landfill THEN 7.25 END::DOUBLE AS residue FROM c""",
)
def facility_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility rows sorted out: totals of regions, rejected rows and records, with the fields of their kind."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 11
    landfill = k % 3 == 0
    quantity = F.when(n == 5, "-3").otherwise(F.col("o_totalprice").cast("long").cast("string"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 20).alias("file"), F.when(landfill, "LANDFILL").otherwise("INCINERATION").alias("kind"), F.lit("경기도").alias("sido"), F.when(n == 2, " 소계").otherwise("용인시").alias("sigungu"),
        F.when(n == 1, "합계 ").when(n == 3, "  ").otherwise("시설").alias("name"), F.when(n == 4, None).otherwise("길 1").alias("address"),
        quantity.alias("LANDFILL_QTY"), F.when(n == 6, "x").otherwise("1,234.5").alias("FILL_AREA"), F.lit("-").alias("TOTAL_CAPA"), F.lit(None).cast("string").alias("REMAIN_CAPA"), F.lit("").alias("FILL_QTY_M3"),
        quantity.alias("DISPOSAL_QTY"), F.when(n == 7, "y").otherwise("7.25").alias("RESIDUE_RECY"), F.lit("0").alias("RESIDUE_INCI"), F.lit("-").alias("RESIDUE_LAND"),
    )
    found = triage.facility_rows(rows, "file", "o_orderkey")
    return found.select("o_orderkey", "outcome", "reason", F.col("index").alias("position"), *[F.col(c).cast("double").alias(a) for c, a in (("throughput", "throughput"), ("fill_area_m2", "fill_area"), ("residue_recycling", "residue"))])


@query(
    "resolution_cascade",
    """WITH f AS (SELECT c_custkey AS file, c_custkey % 12 AS k, c_nationkey AS n FROM customer)
SELECT file, CASE WHEN k IN (2, 3, 5, 6, 9) THEN 'key' || n WHEN k = 1 THEN 'key' || (n + 1) % 25 END AS key,
  CASE WHEN k = 1 THEN 'REVIEWED_MAPPING' WHEN k IN (2, 3, 9) THEN 'WORKBOOK_NAME' WHEN k IN (5, 6) THEN 'FILENAME' ELSE 'UNRESOLVED' END AS basis, CASE WHEN k IN (1, 2, 3, 5, 6, 9) THEN 'ACCEPTED' ELSE 'REJECTED' END AS decision,
  CASE WHEN k = 0 THEN 'DUPLICATE_SOURCE_RECORD' WHEN k = 8 THEN 'BOUNDARY_MISMATCH' WHEN k IN (4, 7, 10, 11) THEN 'AMBIGUOUS_REGION_MAPPING' END AS reason FROM f""",
)
def resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which municipality a file is of, by rules, reviewed maps, the workbook and the file name."""
    k, n = F.col("c_custkey") % 12, F.col("c_nationkey")
    name = lambda i: F.concat(F.lit("city"), i.cast("string"))
    files = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("file"), F.lit("28").alias("metro"), F.concat(F.lit("file"), F.col("c_custkey")).alias("filename"),
        F.when(k.isin(2, 5, 6), name(n)).when(k == 4, name((n + 1) % 25)).when(k.isin(8, 9), name(n + 100)).when(k == 7, "nowhere").when(k == 10, "").otherwise(F.when(k == 3, "unknown").otherwise(F.lit(None))).alias("file_name"),
        F.when(k.isin(0, 1, 2, 3, 4, 9), name(n)).when(k == 6, "unknown").otherwise(F.lit(None)).alias("workbook_name"),
    )
    rejections = files.where("file % 12 = 0").select("metro", "filename", F.lit("DUPLICATE_SOURCE_RECORD").alias("reason"))
    reviewed = table(spark, sf_dir, "customer").where("c_custkey % 12 = 1").select(F.lit("28").alias("metro"), F.concat(F.lit("file"), F.col("c_custkey")).alias("filename"), name((n + 1) % 25).alias("name"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    now = nations.select(F.lit("28").alias("metro"), name(F.col("n_nationkey")).alias("name"), F.concat(F.lit("key"), F.col("n_nationkey")).alias("key"), F.lit(True).alias("current"))
    later = nations.select(F.lit("28").alias("metro"), name(F.col("n_nationkey") + 100).alias("name"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("current"))
    return triage.resolve_files(files, rejections, reviewed, now.union(later))


@query(
    "coverage_classify",
    """WITH s AS (SELECT s_suppkey AS region, s_suppkey % 8 AS k FROM supplier), q AS (SELECT l_suppkey AS region, count(*) AS n FROM lineitem WHERE l_suppkey % 8 <> 5 GROUP BY 1)
SELECT region, CASE k WHEN 0 THEN 'OFFICIAL_SOURCE_UNAVAILABLE' WHEN 1 THEN 'SOURCE_MISSING' WHEN 2 THEN 'VALIDATION_FAILURE' WHEN 3 THEN 'NOT_EVALUATED' ELSE CASE WHEN coalesce(n, 0) > 0 THEN 'EVALUATED_WITH_FEATURES' ELSE 'EVALUATED_ZERO_FEATURES' END END AS coverage,
  CASE WHEN k IN (2, 4, 5, 6, 7) THEN coalesce(n, 0) END AS features FROM s LEFT JOIN q USING (region)""",
)
def coverage_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each region's layer; no features isn't no source."""
    k = F.col("s_suppkey") % 8
    held = table(spark, sf_dir, "lineitem").where("l_suppkey % 8 <> 5").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").join(held, "s_suppkey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    coverage = triage.layer_coverage(k > 1, k == 0, k == 2, k != 3, F.col("n"))
    rows = rows.select(F.col("s_suppkey").alias("region"), coverage.alias("coverage"), "n")
    known = F.col("coverage").isin("VALIDATION_FAILURE", "EVALUATED_WITH_FEATURES", "EVALUATED_ZERO_FEATURES")
    return rows.select("region", "coverage", F.when(known, F.col("n")).alias("features"))


@query(
    "retry_decision",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0) THEN 'already_geocoded' WHEN c_custkey % 6 = 3 THEN 'previously_failed' END AS skip, CASE WHEN c_custkey % 6 = 0 THEN 'already_geocoded' END AS skip_when_retrying FROM customer""",
)
def retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses need no geocoder's call: 1 has no place, 2 and 4 have moved, 5 was never asked."""
    k = F.col("c_custkey") % 6
    status = F.when(k.isin(0, 1, 2), "SUCCEEDED").when(k.isin(3, 4), "FAILED")
    before = F.when(k.isin(2, 4), "old road").when(k != 5, F.concat(F.lit("road "), F.col("c_custkey")))
    asking = F.concat(F.lit("road "), F.col("c_custkey"))
    skips = [triage.geocode_skip(status, before, asking, k != 1, retry).alias(n) for n, retry in (("skip", False), ("skip_when_retrying", True))]
    return table(spark, sf_dir, "customer").select("c_custkey", *skips)


@query(
    "stale_key_diagnosis",
    """SELECT p_partkey AS key, CASE WHEN p_partkey % 5 IN (0, 1) THEN 'FOUND' WHEN p_partkey % 5 IN (2, 3) THEN 'CANDIDATE_KEY_NOT_IN_ACTIVE_RELEASE' ELSE 'CANDIDATE_CELL_NOT_FOUND' END AS finding, CAST(CASE p_partkey % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS INTEGER) AS elsewhere FROM part""",
)
def stale_key_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are unknown, told apart from those of another release or grid."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("key"))
    rows = lambda kinds, release, grid: parts.where((F.col("key") % 5).isin(*kinds)).select("key", F.lit(release).alias("release"), F.lit(grid).alias("grid"))
    stored = rows([0, 1], 2, "v2").union(rows([1, 2], 1, "v1")).union(rows([3], 2, "v1"))
    return triage.stale_keys(parts, stored, 2, "v2")


@query(
    "policy_invariants",
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 11 = 3 THEN 'COMPONENTS' END, CASE WHEN p_partkey % 7 = 1 THEN 'WEIGHT_SUM' END, CASE WHEN p_partkey % 5 IN (1, 2) THEN 'CURVE' END, CASE WHEN p_partkey % 3 = 1 THEN 'CODES_OVERLAP' END) AS faults FROM part""",
)
def policy_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken invariants of each stored policy."""
    k = F.col("p_partkey")
    half = F.lit("0.25").cast("decimal(20,8)") + F.when(k % 7 == 1, F.lit("0.00000001")).otherwise("0").cast("decimal(20,8)")
    weights = F.create_map(F.when(k % 11 == 3, "other").otherwise("zoning"), half, F.lit("road"), F.lit("0.25").cast("decimal(20,8)"), F.lit("demand"), F.lit("0.5").cast("decimal(20,8)"))
    point = lambda d, s: F.struct(F.lit(d).alias("distance"), s.alias("score") if not isinstance(s, int) else F.lit(s).alias("score"))
    curve = F.array(point(0, 100), point(500, F.when(k % 5 == 1, 101).otherwise(80)), F.struct(F.when(k % 5 == 2, 500).otherwise(1000).alias("distance"), F.lit(80).alias("score")))
    hard, review = F.array(F.lit("a"), F.lit("b")), F.array(F.when(k % 3 == 1, "b").otherwise("c"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(triage.policy_faults(weights, ["zoning", "road", "demand"], curve, hard, review), ",").alias("faults"))


@query(
    "weight_validation",
    """SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN 'NOT_AN_OBJECT' WHEN 2 THEN 'KEYS' WHEN 3 THEN 'NOT_EXACT' WHEN 4 THEN 'NOT_EXACT' WHEN 5 THEN 'NOT_A_NUMBER' WHEN 6 THEN 'OUT_OF_RANGE' WHEN 7 THEN 'ALL_ZERO' WHEN 8 THEN 'SUM' END AS fault FROM part""",
)
def weight_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each user's weights."""
    k, rest = F.col("p_partkey") % 10, ', "road": "0.25", "equity": "0.25", "demand": "0.25"}'
    first = F.when(k == 3, "0.25").when(k == 4, "true").when(k == 5, '"x"').when(k == 6, '"-0.25"').when(k == 8, '"0.25000001"').otherwise('"0.2500"')
    text = F.when(k == 1, "[1]").when(k == 2, '{"zoning": "1"}').when(k == 7, '{"zoning": 0, "road": "0", "equity": "0.0", "demand": 0}').when(k == 9, '{"zoning": 1, "road": "0", "equity": 0, "demand": "0"}').otherwise(F.concat(F.lit('{"zoning": '), first, F.lit(rest)))
    return table(spark, sf_dir, "part").select("p_partkey", weight_fault(text).alias("fault"))


@query(
    "mapping_coverage",
    """WITH r AS (SELECT c_custkey, c_custkey % 4 AS pid, c_nationkey AS n, c_custkey % 9 AS k FROM customer), s AS (SELECT *, CASE WHEN n >= 20 THEN 'OUT_OF_SCOPE' WHEN k = 1 THEN 'UNMATCHED' WHEN k = 2 THEN 'AMBIGUOUS' WHEN k = 3 THEN 'COARSER' ELSE 'EXACT' END AS status FROM r),
e AS (SELECT DISTINCT n FROM s WHERE status = 'EXACT')
SELECT 'pid ' || pid AS scope, count(*) FILTER (WHERE status <> 'OUT_OF_SCOPE') AS in_scope, count(*) FILTER (WHERE status = 'EXACT') AS matched, count(*) FILTER (WHERE status IN ('UNMATCHED', 'AMBIGUOUS')) AS rejected, NULL::BIGINT AS missing FROM s GROUP BY pid
UNION ALL SELECT 'sido ' || n_regionkey, count(*), count(n), NULL, count(*) - count(n) FROM nation LEFT JOIN e ON n_nationkey = n AND n < 20 GROUP BY n_regionkey""",
)
def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by data set: in scope, mapped, rejected; and regions by province: all, matched, missing."""
    k, n = F.col("c_custkey") % 9, F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("pid"), n.alias("nk"), F.when(n >= 20, "far").otherwise("near").alias("province"), F.when(k == 1, F.lit("nowhere")).when(k == 2, F.lit("twice")).when(k == 3, F.concat(F.lit("city"), n)).otherwise(F.concat(F.lit("district"), n)).alias("label"))
    # a label may stand for no region, for several, or for a city above the districts
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    names = nations.select(F.concat(F.lit("district"), F.col("n_nationkey")).alias("label"), F.col("n_nationkey").alias("region"), F.lit("EXACT").alias("kind"))
    names = names.union(nations.select(F.concat(F.lit("city"), F.col("n_nationkey")), F.col("n_nationkey"), F.lit("COARSER"))).union(nations.select(F.lit("twice"), F.col("n_nationkey"), F.lit("EXACT")))
    one = names.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"), F.min("region").alias("region"))
    status = F.when(F.col("province") == "far", "OUT_OF_SCOPE").when(F.col("n").isNull(), "UNMATCHED").when(F.col("n") > 1, "AMBIGUOUS").otherwise(F.col("kind"))
    mapped = rows.join(one, "label", "left").select("pid", "region", status.alias("status"))
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    none = F.lit(None).cast("long")
    by_pid = mapped.groupBy("pid").agg(F.count_if(F.col("status") != "OUT_OF_SCOPE").alias("in_scope"), is_("EXACT").alias("matched"), is_("UNMATCHED", "AMBIGUOUS").alias("rejected"))
    exact = mapped.where("status = 'EXACT'").select(F.col("region").alias("hit")).distinct()
    by_sido = nations.join(exact, F.col("n_nationkey") == F.col("hit"), "left").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("in_scope"), F.count("hit").alias("matched"))
    left = by_pid.select(F.concat(F.lit("pid "), "pid").alias("scope"), "in_scope", "matched", "rejected", none.alias("missing"))
    return left.union(by_sido.select(F.concat(F.lit("sido "), "n_regionkey"), "in_scope", "matched", none, F.col("in_scope") - F.col("matched")))


@query(
    "scoped_population_year",
    """WITH p AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, CASE o_orderkey % 3 WHEN 0 THEN 'ANNUAL' ELSE 'MONTHLY' END AS period, CASE o_orderkey % 5 WHEN 0 THEN 'KOSIS' ELSE 'SGIS' END AS source, CASE WHEN o_custkey % 4 = 0 THEN 'SIDO' ELSE 'SIGUNGU' END AS level FROM orders),
s AS (SELECT * FROM p WHERE period = 'ANNUAL' AND source = 'SGIS' AND level = 'SIGUNGU'), l AS (SELECT max(y) AS y FROM s) SELECT o_orderkey, CAST(s.y AS INTEGER) AS reference_year, CAST(l.y AS INTEGER) AS latest FROM s, l WHERE s.y = l.y""",
)
def scoped_population_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the latest year of one scope of population: the same scope finds the year and the rows."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("reference_year"), F.when(k % 3 == 0, "ANNUAL").otherwise("MONTHLY").alias("period"), F.when(k % 5 == 0, "KOSIS").otherwise("SGIS").alias("source"), F.when(F.col("o_custkey") % 4 == 0, "SIDO").otherwise("SIGUNGU").alias("level")
    )
    scoped = rows.where((F.col("period") == "ANNUAL") & (F.col("source") == "SGIS") & (F.col("level") == "SIGUNGU"))
    latest = scoped.agg(F.max("reference_year").alias("latest"))
    return scoped.join(F.broadcast(latest), F.col("reference_year") == F.col("latest")).select("o_orderkey", "reference_year", "latest")


@query(
    "profile_availability",
    """SELECT o_orderkey AS run, unnest(['balanced', 'equity', 'critic', 'other']) AS profile, unnest([true, true, o_orderkey % 3 = 0, false]) AS available, unnest([NULL, NULL, CASE WHEN o_orderkey % 3 <> 0 THEN 'PROFILE_NOT_STORED_WITH_RUN' END, 'UNKNOWN_PROFILE']) AS reason FROM orders""",
)
def profile_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static profiles always, one derived from data only if its weights are stored with the run, others never."""
    stored = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("critic"), F.lit(0.5)))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), stored.alias("weights"), F.explode(F.array(*map(F.lit, ("balanced", "equity", "critic", "other")))).alias("profile"))
    known, fixed = F.col("profile").isin("balanced", "equity", "critic"), F.col("profile").isin("balanced", "equity")
    available = known & (fixed | F.coalesce(F.map_contains_key("weights", F.col("profile")), F.lit(False)))
    reason = F.when(~known, "UNKNOWN_PROFILE").when(~available, "PROFILE_NOT_STORED_WITH_RUN")
    return rows.select("run", "profile", available.alias("available"), reason.alias("reason"))


@query(
    "geometry_bounds",
    """SELECT p_partkey AS id, CAST(p_partkey * 37 % 200 AS DOUBLE) AS west, CAST(p_partkey * 91 % 200 AS DOUBLE) AS south, CAST(p_partkey * 37 % 200 + CASE WHEN p_partkey % 10 = 1 THEN 0 ELSE p_size % 9 + 1 END AS DOUBLE) AS east,
  CAST(p_partkey * 91 % 200 + p_partkey % 7 + 1 AS DOUBLE) AS north, p_partkey % 10 = 1 AS degenerate FROM part WHERE p_partkey % 10 <> 2""",
)
def geometry_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shape's box, and whether it has no extent in a direction; shapes that aren't there have none."""
    flat = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(F.when(F.col("id") % 10 == 1, F.lit(0.0) + F.col("id") * 37 % 200).otherwise(p.x).alias("x"), p.y.alias("y"))))
    shapes = _parts(spark, sf_dir).select("id", F.when(F.col("id") % 10 != 2, flat).alias("rings"))
    west, south, east, north = overlay.box(F.col("rings"))
    found = shapes.where("rings IS NOT NULL").select("id", west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))
    return found.withColumn("degenerate", (F.col("west") == F.col("east")) | (F.col("south") == F.col("north")))


_WET = "w AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_partkey * 37 % 200 AS x, p_partkey * 91 % 200 AS y, p_size % 9 + 1 AS w, p_partkey % 7 + 1 AS h FROM part)"


def _wetlands(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    shapes = _parts(spark, sf_dir).select("id", "rings").withColumn("b", F.array(*overlay.box(F.col("rings"))))
    hole = F.when(F.size("rings") > 1, (F.col("b")[2] - F.col("b")[0] - 2) * (F.col("b")[3] - F.col("b")[1] - 2)).otherwise(0.0)
    return parts.join(shapes.withColumn("area", (F.col("b")[2] - F.col("b")[0]) * (F.col("b")[3] - F.col("b")[1]) - hole), "id")


@query(
    "feature_search",
    f"""WITH {_WET}, m AS (SELECT id, name, kind FROM w WHERE x + w >= 50 AND x <= 120 AND y + h >= 40 AND y <= 150 AND lower(name) LIKE '%a%')
SELECT id, name, kind, count(*) OVER () AS total, CAST((row_number() OVER (ORDER BY name, id) - 1) // 20 AS BIGINT) AS page FROM m""",
)
def feature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wetlands whose name has a text and whose box meets a window, by name, in pages of twenty with the total."""
    b = F.col("b")
    found = _wetlands(spark, sf_dir).where((b[2] >= 50) & (b[0] <= 120) & (b[3] >= 40) & (b[1] <= 150) & F.lower("name").contains("a")).select("id", "name", "kind")
    ranked = rank_all(found, "name", "id", "position", descending=False)
    return ranked.select("id", "name", "kind", F.col("population").alias("total"), F.floor((F.col("position") - 1) / 20).alias("page"))


@query(
    "wetland_metadata",
    f"""WITH {_WET}, a AS (SELECT *, CAST(w * h - CASE WHEN w > 2 AND h > 2 THEN (w - 2) * (h - 2) ELSE 0 END AS DOUBLE) AS area FROM w)
SELECT kind, count(*) AS n, sum(area) AS area, CAST(min(x) AS DOUBLE) AS west, CAST(max(x + w) AS DOUBLE) AS east, sum(area) / (SELECT sum(area) FROM a) AS share FROM a GROUP BY 1""",
)
def wetland_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, area, extent and share of the whole area of each kind of wetland."""
    b = F.col("b")
    kinds = _wetlands(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), F.min(b[0]).alias("west"), F.max(b[2]).alias("east"))
    total = kinds.agg(F.sum("area").alias("whole"))
    return kinds.join(F.broadcast(total)).select("kind", "n", "area", "west", "east", (F.col("area") / F.col("whole")).alias("share"))


@query(
    "registry_by_lifecycle",
    """WITH l AS (SELECT n_nationkey AS layer, n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'PLANNED' ELSE 'RETIRED' END AS lifecycle FROM nation), u AS (SELECT c_nationkey AS layer, count(*) AS used, max(c_custkey) AS last FROM customer GROUP BY 1)
SELECT layer, name, lifecycle, coalesce(used, 0) AS used, lifecycle = 'ACTIVE' AND coalesce(used, 0) > 0 AS served, CASE WHEN lifecycle <> 'ACTIVE' THEN 'LAYER_NOT_ACTIVE' WHEN used IS NULL THEN 'NO_DATA' END AS reason FROM l LEFT JOIN u USING (layer)""",
)
def registry_by_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of the registry by their state of life, with what is held of them and why they aren't served."""
    state = F.get(F.array(*map(F.lit, ("ACTIVE", "PLANNED", "RETIRED"))), F.col("n_nationkey") % 3)
    layers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("layer"), F.col("n_name").alias("name"), state.alias("lifecycle"))
    held = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("held_layer")).agg(F.count(F.lit(1)).alias("n"))
    rows = layers.join(held, F.col("layer") == F.col("held_layer"), "left").withColumn("used", F.coalesce("n", F.lit(0).cast("long")))
    reason = F.when(F.col("lifecycle") != "ACTIVE", "LAYER_NOT_ACTIVE").when(F.col("n").isNull(), "NO_DATA")
    return rows.select("layer", "name", "lifecycle", "used", ((F.col("lifecycle") == "ACTIVE") & (F.col("used") > 0)).alias("served"), reason.alias("reason"))
