"""Labels of sources: money, periods, date ranges, lists, units, names, options, secrets, canonical texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from strataform.functions import labels
from strataform.plans.registry import query, table

#: What the SQL makes its labels of, by the event's number; the queries make the same.
_TIDY = "trim(regexp_replace(raw, '\\s+', ' ', 'g'))"


def _choice(key: str, *texts: object) -> Column:
    out = None
    for i, t in enumerate(texts):
        value = t if isinstance(t, Column) else F.lit(t)
        out = F.when(F.col(key) % len(texts) == i, value) if out is None else out.when(F.col(key) % len(texts) == i, value)
    return out


_AMOUNT = "(CAST(o_orderkey % 900 + 100 AS VARCHAR) || ',' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0'))"


@query(
    "money_literal",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN CAST(replace({_AMOUNT}, ',', '') || CASE o_orderkey % 6 WHEN 1 THEN '.25' ELSE '' END AS DECIMAL(38,6)) END AS amount FROM orders""",
)
def money_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as sources write them; dashes, ranges and prose stay missing."""
    text = F.concat((F.col("o_orderkey") % 900 + 100).cast("string"), F.lit(","), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))
    raw = _choice("o_orderkey", text, F.concat(F.lit(" "), text, F.lit(".25 원")), F.concat(text, F.lit("원")), "-", F.concat(text, F.lit("~"), text), F.concat(F.lit("약 "), text))
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.money(raw).alias("amount"))


@query(
    "label_period",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '2024-' || lpad(CAST(event_id % 12 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN '2023-' || lpad(CAST(event_id % 12 + 1 AS VARCHAR), 2, '0') END AS month,
  CASE event_id % 7 WHEN 0 THEN 'MONTHLY' WHEN 1 THEN 'MONTHLY' WHEN 2 THEN 'ANNUAL' WHEN 3 THEN 'MONTHLY_AVERAGE' ELSE 'UNSPECIFIED' END AS kind FROM events""",
)
def label_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 12 + 1).cast("string")
    raw = _choice("event_id", F.concat(F.lit("반입량 : "), n, F.lit("월")), F.concat(F.lit("반입량 : 2023-"), n), "반입량 : 계", F.concat(F.lit("월평균: "), n, F.lit("월")), "반입량 : 13월", "", "2024년")
    month, kind = labels.label_period(raw, F.lit(2024))
    return table(spark, sf_dir, "events").select("event_id", month.alias("month"), kind.alias("kind"))


@query(
    "date_range_label",
    """SELECT event_id, CASE WHEN event_id % 8 IN (1, 5) THEN make_date(2024, 2, CAST(event_id % 28 + 1 AS BIGINT)) WHEN event_id % 8 = 2 THEN make_date(2023, 11, 5) END AS start_date,
  CASE WHEN event_id % 8 IN (1, 5) THEN make_date(2024, 4, 5) WHEN event_id % 8 = 2 THEN make_date(2023, 12, 31) WHEN event_id % 8 = 6 THEN make_date(2024, 3, 1) END AS end_date, event_id % 8 NOT IN (0, 4) AS part_year FROM events""",
)
def date_range_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second date takes the year of the first; days that don't exist are missing; a single date is part of a year."""
    day = (F.col("event_id") % 28 + 1).cast("string")
    raw = _choice("event_id", "2024", F.concat(F.lit("2024.2."), day, F.lit(".~4.5")), "2023. 11. 5 ∼ 12. 31.", "2024.2.30~2024.13.1", "연중", F.concat(F.lit("2024-2-"), day, F.lit(" ~ 2024/04/05")), "상반기~3/1", "2024 . 7.")
    start, end, part = labels.date_range(raw, F.lit(2024))
    return table(spark, sf_dir, "events").select("event_id", start.alias("start_date"), end.alias("end_date"), part.alias("part_year"))


@query("list_cell", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|' || CAST(user_id AS VARCHAR) || '|last' WHEN 1 THEN event_type ELSE '' END AS items FROM events")
def list_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    raw = _choice("event_id", F.concat(kind, F.lit("; "), user, F.lit(" / ;last")), F.concat(F.lit(" / "), kind, F.lit(";")), " ; / ")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(labels.list_cell(raw), "|").alias("items"))


@query("unit_token", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '톤/년' WHEN 1 THEN n_name ELSE 'kg' END AS unit FROM nation")
def unit_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _choice("n_nationkey", "( 단위 : 톤/년 )", F.concat(F.lit("(단위:"), F.col("n_name"), F.lit(")")), " kg ")
    return table(spark, sf_dir, "nation").select("n_nationkey", labels.unit_token(raw).alias("unit"))


@query("organisation_name", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '동구' WHEN 1 THEN n_name || '군' WHEN 2 THEN n_name ELSE '청' || n_name END AS name FROM nation")
def organisation_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_name")
    raw = _choice("n_nationkey", "인천광역시 동구청", F.concat(n, F.lit("군청 ")), F.concat(F.lit("경기도"), n), F.concat(F.lit("청"), n))
    return table(spark, sf_dir, "nation").select("n_nationkey", labels.organisation(raw).alias("name"))


@query("selected_option", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y%m') WHEN event_id % 3 = 1 THEN '' END AS month FROM events")
def selected_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option that is selected in the select of one name, among others; an empty value is a value."""
    month = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyyMM")).otherwise("")
    other = F.lit('<select name="searchYearEnd"><option value="1900" selected>x</option></select>')
    wanted = F.concat(F.lit('<select class="s" name="searchMonthEnd" id="m"><option value="190001" title="not selected">x</option><OPTION class="a" value="'), month, F.when(F.col("event_id") % 3 < 2, '" id="b" selected="selected">').otherwise('">'), F.lit("y</option></select>"))
    page = F.concat(other, F.when(F.col("event_id") % 6 < 3, wanted).otherwise(F.concat(wanted, other)))
    return table(spark, sf_dir, "events").select("event_id", labels.selected_option(page, "searchMonthEnd").alias("month"))


@query(
    "secret_redaction",
    """SELECT event_id, '{"serviceKey": "[REDACTED]", "page": ' || CAST(user_id AS VARCHAR) || ', "auth": {"TOKEN": "[REDACTED]", "kind": "' || event_type || '"}, "list": [{"apiKey": "[REDACTED]"}, {"key": "[REDACTED]", "keys": 1}], "access_token" : "[REDACTED]"}' AS body FROM events""",
)
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every kind go where their key is sensitive, whatever its case and depth."""
    k = F.col("event_id").cast("string")
    hidden = _choice("event_id", F.concat(F.lit('{"id": ['), k, F.lit(', {"a": "}"}], "b": "\\"]"}')), F.concat(F.lit("["), k, F.lit(", [2, {}]]")), F.concat(F.lit('"a\\"b'), k, F.lit('"')), k, "null")
    raw = F.concat(
        F.lit('{"serviceKey": '), hidden, F.lit(', "page": '), F.col("user_id").cast("string"), F.lit(', "auth": {"TOKEN": 12, "kind": "'), F.col("event_type"),
        F.lit('"}, "list": [{"apiKey": '), hidden, F.lit('}, {"key": true, "keys": 1}], "access_token" : '), hidden, F.lit("}"),
    )
    return table(spark, sf_dir, "events").select("event_id", labels.redacted(raw).alias("body"))


@query(
    "canonical_weight_hash",
    """WITH w AS (SELECT p_partkey, printf('%.8f', (p_size % 10) / 16.0) AS a, printf('%.8f', 1 - (p_size % 10) / 16.0) AS b FROM part)
SELECT p_partkey, a, b, sha256('{"demand":"' || a || '","road":"' || b || '"}') AS digest FROM w""",
)
def canonical_weight_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as fixed-point texts, and the digest of their JSON with sorted keys."""
    share = (F.col("p_size") % 10).cast("decimal(12,8)") / F.lit(16).cast("decimal(2,0)")
    p = table(spark, sf_dir, "part").select("p_partkey", labels.fixed_point(share).alias("a"), labels.fixed_point(F.lit(1).cast("decimal(1,0)") - share).alias("b"))
    return p.withColumn("digest", F.sha2(F.format_string('{"demand":"%s","road":"%s"}', "a", "b"), 256))


@pandas_udf(StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode normal form C; there is no built-in for it."""
    for t in texts:
        yield t.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@query("unicode_nfc", "SELECT event_id, md5(nfc_normalize(event_type || 'e' || chr(769) || chr(4352) || chr(4449))) AS digest FROM events")
def unicode_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("event_type"), F.lit("é가"))
    return table(spark, sf_dir, "events").select("event_id", F.md5(nfc(raw)).alias("digest"))


@query(
    "required_paths",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS value,
  CASE event_id % 3 WHEN 1 THEN 'body.items' WHEN 2 THEN 'body,body.items' ELSE '' END AS missing FROM events""",
)
def required_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dotted path's value in a JSON text, and which of the required paths are missing."""
    raw = _choice("event_id", F.concat(F.lit('{"body":{"items":'), F.col("user_id").cast("string"), F.lit("}}")), '{"body":{}}', "{}")
    paths = ["body", "body.items"]
    missing = F.array_compact(F.array(*[F.when(F.get_json_object("raw", "$." + p).isNull(), F.lit(p)) for p in paths]))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", F.get_json_object("raw", "$.body.items").alias("value"), F.array_join(missing, ",").alias("missing"))


@query(
    "ordered_unique",
    """WITH r AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS kinds FROM r GROUP BY 1""",
)
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of event in the order of their first one."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda e: e.event_type)
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query(
    "provider_result",
    """SELECT event_type, CASE event_type WHEN 'click' THEN 'OK' WHEN 'view' THEN 'NO_DATA' WHEN 'error' THEN 'QUOTA' ELSE 'ERROR' END AS result, count(*) AS n FROM events GROUP BY 1""",
)
def provider_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider's code says of its response."""
    code = F.when(F.col("event_type") == "click", " E000 ").when(F.col("event_type") == "view", "E099").when(F.col("event_type") == "error", "E022").otherwise("E999")
    body = F.to_json(F.struct(F.array(F.struct(code.alias("ERR_CODE"))).alias("result")))
    found = F.trim(F.get_json_object(body, "$.result[0].ERR_CODE"))
    result = F.when(found == "E000", "OK").when(found == "E099", "NO_DATA").when(found.isin("E021", "E022"), "QUOTA").otherwise("ERROR")
    return table(spark, sf_dir, "events").groupBy("event_type", result.alias("result")).agg(F.count(F.lit(1)).alias("n"))
