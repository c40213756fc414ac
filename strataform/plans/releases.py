"""Packages and releases compared, encodings told, names in Korean order, and rule cascades over deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataform.functions import encodings
from strataform.operators import packages
from strataform.plans.registry import query, table


@query(
    "package_reconcile",
    """SELECT o_orderkey AS key, 'MISSING' AS finding FROM orders WHERE o_orderkey % 1009 = 3 UNION ALL SELECT o_orderkey + 100000000, 'EXTRA' FROM orders WHERE o_orderkey % 997 = 5
UNION ALL SELECT o_orderkey, 'CHANGED' FROM orders WHERE o_orderkey % 1009 <> 3 AND (o_orderkey % 503 = 7 OR o_orderkey % 811 = 2)
UNION ALL SELECT o_orderkey, 'ORPHAN' FROM orders WHERE o_orderkey % 1009 <> 3 AND o_orderkey % 811 = 2 UNION ALL SELECT o_orderkey + 100000000, 'ORPHAN' FROM orders WHERE o_orderkey % 997 = 5 AND o_orderkey % 811 = 2""",
)
def package_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of orders against the orders held: lacking, added, changed ones and those without a customer."""
    held = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderdate")
    key = F.col("o_orderkey")
    sent = held.withColumn("c_custkey", F.when(key % 811 == 2, F.col("c_custkey") + 10_000_000).otherwise(F.col("c_custkey")))
    sent = sent.withColumn("o_orderdate", F.when(key % 503 == 7, None).otherwise(F.col("o_orderdate")))
    sent = sent.where("o_orderkey % 1009 <> 3").union(sent.where("o_orderkey % 997 = 5").withColumn("o_orderkey", key + 100_000_000))
    return packages.reconcile(sent, held, "o_orderkey", ["c_custkey", "o_totalprice", "o_orderdate"], table(spark, sf_dir, "customer"), "c_custkey")


def _releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kind = k % 6
    first = F.concat(F.lit('{"run": {"id": '), k, F.lit(', "by": "'), F.col("event_type"), F.lit('", "none": null}, "list": [1, {"u": '), u, F.lit('}, []], "e": {}}'))
    # names in another order, then a change of each kind
    last = F.concat(
        F.lit('{"e": '), F.when(kind == 1, '{"new": true}').otherwise("{}"), F.lit(',  "list":[ 1,{"u":'), F.when(kind == 2, F.concat(F.lit('"'), u, F.lit('"'))).otherwise(u), F.lit("}"), F.when(kind == 3, "").otherwise(", []"),
        F.lit('], "run": {"none": '), F.when(kind == 4, "0").otherwise("null"), F.lit(', "by": "'), F.col("event_type"), F.lit('", "id": '), k, F.lit("}}"),
    )
    return rows.select("event_id", first.alias("body")), rows.select("event_id", last.alias("body"))


@query(
    "release_diff",
    """WITH e AS (SELECT event_id AS id, event_id % 6 AS k, CAST(user_id AS VARCHAR) AS u FROM events)
SELECT id, '$.["e"]' AS path, 'REMOVED' AS kind, '{}' AS old, NULL AS new FROM e WHERE k = 1 UNION ALL SELECT id, '$.["e"].["new"]', 'ADDED', NULL, 'true' FROM e WHERE k = 1
UNION ALL SELECT id, '$.["list"][1].["u"]', 'CHANGED', u, '"' || u || '"' FROM e WHERE k = 2 UNION ALL SELECT id, '$.["list"][2]', 'REMOVED', '[]', NULL FROM e WHERE k = 3
UNION ALL SELECT id, '$.["run"].["none"]', 'CHANGED', 'null', '0' FROM e WHERE k = 4""",
)
def release_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two releases of each document, whatever the order of names."""
    return packages.json_diff(*_releases(spark, sf_dir), "event_id", "body")


@query("release_digest", "SELECT event_id AS id, event_id % 6 IN (0, 5) AS same FROM events")
def release_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two releases of a document have one canonical digest."""
    first, last = (packages.json_digests(r, "event_id", "body") for r in _releases(spark, sf_dir))
    both = first.join(last.withColumnsRenamed({"id": "other", "digest": "last"}), F.col("id") == F.col("other"))
    return both.select("id", (F.col("digest") == F.col("last")).alias("same"))


@query(
    "encoding_evidence",
    """WITH c AS (SELECT c_nationkey AS file, c_custkey, c_nationkey % 4 AS kind FROM customer)
SELECT file, count(*) AS n, count(*) FILTER (WHERE kind IN (1, 3) AND c_custkey % 3 > 0) AS utf8_failures, count(*) FILTER (WHERE kind IN (0, 3) AND c_custkey % 3 <> 1) AS cp949_failures,
  CASE WHEN count(*) FILTER (WHERE kind IN (1, 3) AND c_custkey % 3 > 0) = 0 THEN 'UTF-8' WHEN count(*) FILTER (WHERE kind IN (0, 3) AND c_custkey % 3 <> 1) = 0 THEN 'CP949' ELSE 'UNDETERMINED' END AS encoding FROM c GROUP BY 1""",
)
def encoding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each file are no text of an encoding; the first encoding without any is the file's."""
    k, kind = F.col("c_custkey"), F.col("c_nationkey") % 4
    ascii_part = F.encode(F.concat(F.lit("record "), k), "US-ASCII")
    utf8 = F.concat(ascii_part, F.encode(F.lit(" 한글"), "UTF-8"))
    # rows of Hangul in the code page: any lead from B0 to C8 with any trail from A1 to FE
    pair = F.unhex(F.concat(F.hex((0xB0 + k % 25).cast("long")), F.hex((0xA1 + k % 94).cast("long"))))
    cp949 = F.concat(ascii_part, pair, F.unhex(F.lit("B0A1")))
    data = F.when(kind == 0, F.when(k % 3 == 1, ascii_part).otherwise(utf8)).when(kind == 1, F.when(k % 3 == 0, ascii_part).otherwise(cp949)).when(kind == 2, ascii_part)
    data = data.otherwise(F.when(k % 3 == 0, utf8).when(k % 3 == 1, cp949).otherwise(F.concat(ascii_part, F.unhex(F.lit("FF80")))))
    fails = lambda e: F.count_if(~encodings.readable(F.col("data"), e))
    counted = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), data.alias("data")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), fails("UTF-8").alias("utf8_failures"), fails("CP949").alias("cp949_failures"))
    return counted.withColumn("encoding", encodings.verdict({"UTF-8": F.col("utf8_failures"), "CP949": F.col("cp949_failures")}))


#: Names in Korean order: Hangul first, by syllable, then Latin without regard to case (small letters first among equals).
_KOREAN = ["가평군", "강남구", "금천구", "남동구", "노원구", "부평구", "수원시", "양천구", "옹진군", "중구"]
_LATIN = ["ansan", "Ansan", "bucheon", "Goyang", "paju", "Suwon"]


@query(
    "korean_name_order",
    f"""WITH n AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 < 2 THEN {_KOREAN}[c_custkey % 10 + 1] ELSE {_LATIN}[c_custkey % 6 + 1] END AS name,
  CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 10 ELSE 10 + c_custkey % 6 END AS place FROM customer)
SELECT c_custkey, name, row_number() OVER (PARTITION BY c_nationkey ORDER BY place, c_custkey) AS position FROM n""",
)
def korean_name_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each name in its list by the Korean collation, which isn't that of code points."""
    k = F.col("c_custkey")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (k % n).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(k % 3 < 2, pick(_KOREAN, 10)).otherwise(pick(_LATIN, 6)).alias("name"))
    order = Window.partitionBy("c_nationkey").orderBy(F.collate(F.col("name"), "ko"), "c_custkey")
    return rows.select("c_custkey", "name", F.row_number().over(order).alias("position"))
