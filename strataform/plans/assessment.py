"""Cost scenarios of facilities, national grids, tiles, address tries, contractors, anomalies and saved scenarios."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataform.functions import geodesy, labels
from strataform.operators.facility_cost import SUBSIDY_RATES, facility_cost
from strataform.plans.registry import query, table

#: Unit costs of the scenario query; the two first bands of sorting overlap, and none goes beyond 40 tons a day.
BANDS = [("INCINERATION", "0", "50", "5.2000"), ("INCINERATION", "50", None, "4.1500"), ("SORTING", "0", "20", "1.3750"), ("SORTING", "19", "40", "1.1000")]
_SCHEMES = [*SUBSIDY_RATES, "unknown"]


def _even(n: str, d: str) -> str:
    """SQL of a quotient of whole numbers of at least 0, rounded half to even."""
    return f"(({n}) // ({d}) + CASE WHEN 2 * (({n}) % ({d})) > ({d}) OR (2 * (({n}) % ({d})) = ({d}) AND (({n}) // ({d})) % 2 = 1) THEN 1 ELSE 0 END)"


@query(
    "facility_cost_scenario",
    f"""WITH pop AS (SELECT c_nationkey AS nk, count(*) AS people FROM customer GROUP BY 1),
q AS (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS HUGEINT) AS ton FROM lineitem GROUP BY 1),
i AS (SELECT s_suppkey, coalesce(ton, 0) AS ton, CASE s_suppkey % 3 WHEN 0 THEN 'SORTING' ELSE 'INCINERATION' END AS kind, CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 290 + s_suppkey % 60 END AS days,
  CAST(100 + s_suppkey % 43 AS HUGEINT) AS mult, s_suppkey % 5 AS scheme, CASE WHEN s_suppkey % 7 <> 0 THEN people END AS people FROM supplier LEFT JOIN q ON s_suppkey = l_suppkey LEFT JOIN pop ON s_nationkey = nk),
c AS (SELECT *, ton * 650000 AS service, CASE WHEN days > 0 THEN {_even("ton * 650000", "days")} END AS cap FROM i),
r AS (SELECT *, CASE WHEN mult > 140 THEN 'INVALID_UNDERGROUND_MULTIPLIER' WHEN scheme = 4 THEN 'UNKNOWN_SUBSIDY_SCHEME' WHEN days = 0 THEN 'INVALID_OPERATING_DAYS'
  WHEN cap = 0 OR (kind = 'SORTING' AND cap > 40000000) THEN 'NO_MATCHING_COST_BAND' WHEN kind = 'SORTING' AND cap > 19000000 AND cap <= 20000000 THEN 'OVERLAPPING_COST_BAND' END AS reason,
  CAST(CASE kind WHEN 'INCINERATION' THEN CASE WHEN cap <= 50000000 THEN 52000 ELSE 41500 END ELSE CASE WHEN cap <= 20000000 THEN 13750 ELSE 11000 END END AS HUGEINT) AS unit FROM c),
s AS (SELECT *, CASE WHEN reason IS NULL THEN {_even("unit * cap * mult", "1000000")} END AS con, CASE WHEN reason IS NULL THEN CASE WHEN kind = 'INCINERATION' AND cap > 50000000 THEN 20 ELSE 15 END END AS life FROM r),
t AS (SELECT *, {_even("con", "life")} AS ann, {_even("con * CASE scheme WHEN 1 THEN 40 WHEN 3 THEN 50 ELSE 30 END", "100")} AS sub FROM s)
SELECT s_suppkey, reason, CAST(service AS DOUBLE) / 1e6 AS service_ton, CAST(cap AS DOUBLE) / 1e6 AS capacity_tpd, CAST(con AS DOUBLE) / 1e6 AS construction, CAST(life AS INTEGER) AS lifetime_years, CAST(ann AS DOUBLE) / 1e6 AS annualised,
  CAST(sub AS DOUBLE) / 1e6 AS subsidy, CAST(con - sub AS DOUBLE) / 1e6 AS local_share, CAST({_even("(con - sub) * 10000", "people")} AS DOUBLE) / 100 AS won_per_person,
  CASE WHEN reason IS NULL AND people IS NULL THEN 'NO_OFFICIAL_SERVICE_POPULATION' END AS population_reason FROM t""",
)
def facility_cost_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facility for each supplier's quantity; the population is that of its nation."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("people"))
    tons = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("ton"))
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(tons, "s_suppkey", "left").join(people, "s_nationkey", "left")
    rows = rows.select(
        "s_suppkey",
        F.coalesce("ton", F.lit(0)).alias("annual_ton"),
        F.when(key % 3 == 0, "SORTING").otherwise("INCINERATION").alias("facility_type"),
        F.lit("0.65").cast("decimal(5,4)").alias("share"),
        F.when(key % 17 == 0, 0).otherwise(290 + key % 60).alias("days"),
        ((100 + key % 43).cast("decimal(6,2)") / 100).cast("decimal(4,2)").alias("multiplier"),
        F.get(F.array(*[F.lit(s) for s in _SCHEMES]), (key % 5).cast("int")).alias("scheme"),
        F.when(key % 7 != 0, F.col("people")).alias("population"),
    )
    steps = ["service_ton", "capacity_tpd", "construction", "annualised", "subsidy", "local_share", "won_per_person"]
    return facility_cost(rows, BANDS).select("s_suppkey", "reason", "lifetime_years", "population_reason", *[F.col(c).cast("double").alias(c) for c in steps])


def _grid_sql(code: int) -> str:
    g = geodesy.GRIDS[code]
    size = g.scale * geodesy._A
    east = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geodesy.ALPHA, 1))
    north = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geodesy.ALPHA, 1))
    return f"""WITH p AS (SELECT c_custkey, 126 + (c_custkey % 3001) / 1000.0::DOUBLE AS lon, 33 + (c_custkey * 7 % 5003) / 1000.0::DOUBLE AS lat FROM customer),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {geodesy._E!r} * atanh({geodesy._E!r} * sin(radians(lat)))) AS t, radians(lon - {g.lon0!r}) AS d FROM p),
a AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t)
SELECT c_custkey, round({g.east!r} + {size!r} * (eta + {east}), 2) AS x, round({g.north!r} + {size!r} * (xi + {north} - {geodesy._meridian(g)!r}), 2) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM a"""


def _grid_query(code: int) -> None:
    @query(f"grid_{code}_round_trip", _grid_sql(code))
    def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Places on the national grid, and the degrees that they have when they come back."""
        key = F.col("c_custkey")
        p = table(spark, sf_dir, "customer").select("c_custkey", (126 + (key % 3001) / 1000.0).alias("lon"), (33 + (key * 7 % 5003) / 1000.0).alias("lat"))
        x, y = geodesy.to_grid(F.col("lon"), F.col("lat"), code)
        p = p.select("c_custkey", x.alias("x"), y.alias("y"))
        lon, lat = geodesy.from_grid(F.col("x"), F.col("y"), code)
        return p.select("c_custkey", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


for _code in geodesy.GRIDS:
    _grid_query(_code)


@query(
    "tile_envelopes",
    f"""WITH t AS (SELECT event_id, event_id % 9 AS z, event_id % 300 AS x, event_id * 3 % 257 AS y FROM events), s AS (SELECT *, CAST(2 ** z AS DOUBLE) AS side FROM t), v AS (SELECT *, x < side AND y < side AS valid FROM s)
SELECT event_id, valid, CASE WHEN valid THEN round(x / side * 360 - 180, 6) END AS west, CASE WHEN valid THEN round(degrees(atan(sinh({math.pi!r} * (1 - 2 * (y + 1) / side)))), 6) END AS south,
  CASE WHEN valid THEN round((x + 1) / side * 360 - 180, 6) END AS east, CASE WHEN valid THEN round(degrees(atan(sinh({math.pi!r} * (1 - 2 * y / side)))), 6) END AS north FROM v""",
)
def tile_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    valid, *sides = geodesy.tile_envelope(key % 9, key % 300, key * 3 % 257)
    return table(spark, sf_dir, "events").select("event_id", valid.alias("valid"), *[F.round(c, 6).alias(n) for c, n in zip(sides, ("west", "south", "east", "north"), strict=True)])


@query(
    "box_iou",
    """WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 40 AS DOUBLE) AS d FROM part), s AS (SELECT *, greatest(least(w, d + 20) - greatest(0, d), 0) * greatest(least(10, 25) - greatest(0, 5), 0) AS shared FROM b)
SELECT p_partkey, round(shared / (w * 10 + 400 - shared), 6) AS iou FROM s""",
)
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, d = F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double")
    a = (F.lit(0.0), F.lit(0.0), w, F.lit(10.0))
    b = (d, F.lit(5.0), d + 20, F.lit(25.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(geodesy.box_iou(a, b), 6).alias("iou"))


@query(
    "geocode_attempt_rows",
    """WITH a AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS n FROM customer),
b AS (SELECT k, CASE k % 4 WHEN 0 THEN '경기도 용인시 고잔로 ' || n WHEN 1 THEN '경기 용인시 고잔로 ' || n WHEN 2 THEN '경기도 용인시 탄천로 ' || n || '(태평동)' ELSE '경기도 용인시 완장리 ' || n || '-1,2' END AS full_text,
  CASE k % 4 WHEN 2 THEN '경기도 용인시 탄천로 ' || n WHEN 3 THEN '경기도 용인시 완장리 ' || n || '-1' END AS short_text FROM a),
t AS (SELECT k, full_text AS address, 'ROAD' AS kind, 0 AS attempt FROM b UNION ALL SELECT k, full_text, 'PARCEL', 1 FROM b UNION ALL SELECT k, short_text, 'ROAD', 2 FROM b WHERE short_text IS NOT NULL UNION ALL SELECT k, short_text, 'PARCEL', 3 FROM b WHERE short_text IS NOT NULL)
SELECT k AS c_custkey, attempt, address, kind FROM t""",
)
def geocode_attempt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each try of a facility's address, the plain ones first."""
    key = F.col("c_custkey")
    n = key.cast("string")
    raw = F.when(key % 4 == 0, F.concat(F.lit(" 고잔로  "), n)).when(key % 4 == 1, F.concat(F.lit("경기 용인시 고잔로 "), n)).when(key % 4 == 2, F.concat(F.lit("용인시 탄천로 "), n, F.lit("(태평동)"))).otherwise(F.concat(F.lit("완장리 "), n, F.lit("-1,2")))
    asked = labels.request_address(F.lit("경기도"), F.lit("용인시"), raw)
    # the table is small for the work on it: more tasks than its file has parts
    rows = table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    tries = rows.select("c_custkey", F.posexplode(labels.geocode_attempts(asked)).alias("attempt", "t"))
    return tries.select("c_custkey", "attempt", "t.address", "t.kind")


@query(
    "contractor_names",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '(주)' || o_custkey WHEN 1 THEN '㈜' || o_custkey WHEN 3 THEN '주식회사 ' || o_custkey END AS contractor FROM orders""",
)
def contractor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the note if it names a company, else from the end of the contract's name."""
    which, n = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    note = F.when(which == 0, F.concat(F.lit("계약상대자: (주)"), n, F.lit(", 2024년"))).when(which == 1, F.concat(F.lit("비고; 업체 ㈜"), n, F.lit(" | 기타"))).when(which == 2, F.concat(F.lit("업체: "), n))
    name = F.when(which == 3, F.concat(F.lit("수집 - 운반 - 주식회사 "), n)).when(which == 4, F.concat(F.lit("수집 - "), n)).otherwise("수집 운반")
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.contractor(name, note).alias("contractor"))


_PUBLISHED = "CASE p_partkey % 9 WHEN 0 THEN lower(p_brand) WHEN 1 THEN 'unknown ' || p_size ELSE p_brand END"


@query(
    "published_anomalies",
    f"""WITH v AS (SELECT {_PUBLISHED} AS value, count(*) AS n_rows FROM part GROUP BY 1)
SELECT value, n_rows, NOT regexp_full_match(value, '[A-Za-z]+#[0-9]+') AS not_a_code, value <> upper(value) AND upper(value) IN (SELECT value FROM v) AS case_variant FROM v""",
)
def published_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as published, marked where they are no code or another's variant in lower case; none is corrected."""
    values = table(spark, sf_dir, "part").groupBy(F.expr(_PUBLISHED).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    upper = values.where(F.col("value") == F.upper("value")).select(F.col("value").alias("upper_value"))
    marked = values.join(upper, F.upper("value") == F.col("upper_value"), "left")
    return marked.select("value", "n_rows", (~F.col("value").rlike("^[A-Za-z]+#[0-9]+$")).alias("not_a_code"), ((F.col("value") != F.upper("value")) & F.col("upper_value").isNotNull()).alias("case_variant"))


@query(
    "saved_scenarios",
    """WITH r AS (SELECT c_custkey, c_custkey * 7 % 1009 AS id, c_custkey % 100 AS w FROM customer WHERE c_custkey % 13 > 1), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c_custkey) AS n FROM r)
SELECT 's' || id AS id, c_custkey AS position, CAST(w AS DOUBLE) / 100 AS zoning, CAST(100 - w AS DOUBLE) / 100 AS road FROM f WHERE n = 1""",
)
def saved_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts that can be read, the first of each id; broken ones and those without a weight go."""
    key = F.col("c_custkey")
    w = (key % 100).cast("string")
    good = F.concat(F.lit('{"id":"s'), (key * 7 % 1009).cast("string"), F.lit('","weights":{"zoning":'), w, F.lit(',"road":'), (100 - key % 100).cast("string"), F.lit("}}"))
    raw = F.when(key % 13 == 0, F.substring(good, 1, 12)).when(key % 13 == 1, F.lit('{"id":"s1","weights":{"zoning":4}}')).otherwise(good)
    read = table(spark, sf_dir, "customer").select("c_custkey", F.from_json(raw, "id string, weights struct<zoning: double, road: double>").alias("j"))
    whole = read.where(F.col("j.id").isNotNull() & F.col("j.weights.zoning").isNotNull() & F.col("j.weights.road").isNotNull())
    first = whole.groupBy(F.col("j.id").alias("id")).agg(F.min_by(F.struct("c_custkey", "j.weights"), "c_custkey").alias("r"))
    return first.select("id", F.col("r.c_custkey").alias("position"), (F.col("r.weights.zoning") / 100).alias("zoning"), (F.col("r.weights.road") / 100).alias("road"))
