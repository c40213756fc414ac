"""Contract workbooks: each order is a contract of the workbook of its customer's number mod 40, in every layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strataform.functions.staging import staged
from strataform.operators import workbooks
from strataform.plans.registry import query, table

YEAR, FILES, GRID = 2024, 40, 7
#: By the contract's number mod 7: its name, and what the SQL expects of it.
_NAMES = ["생활폐기물 수집·운반 대행용역", "음식물류폐기물  위탁처리", "재활용품 수집운반 및 선별처리 용역", "반입수수료(생활폐기물 운반)", "생활폐기물(영흥면) 수집운반", "음식물·재활용 청소 용역", "(일반)쓰레기 수거"]
_BASES = ["COLLECTION_TRANSPORT", "TREATMENT_SERVICE", "COLLECTION_TRANSPORT_WITH_TREATMENT", "FACILITY_INBOUND_FEE", "COLLECTION_TRANSPORT", "COLLECTION_TRANSPORT", "COLLECTION_TRANSPORT"]
_SCOPES = ["ALL_MUNICIPAL", "FOOD_ONLY", "RECYCLING_ONLY", "ALL_MUNICIPAL", "ALL_MUNICIPAL", "ALL_MUNICIPAL", "GENERAL_ONLY"]
_STREAMS = ["COMBINED", "FOOD", "RECYCLING", "COMBINED", "COMBINED", "COMBINED", "GENERAL"]
_LAYOUTS = ["QUANTITY_PAIRS", "WITH_PAYMENT_LEDGER", "TONNE_LABELLED_PAIRS", "DESTINATION_SPLIT", "NUMBERED_PAIRS", "DASH_ONLY_QUANTITY"]


def _pick(values: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), key.cast("int"))


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, layout number f, number n in the file, and the order's keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % FILES).alias("file"))
    return staged(orders.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("o_orderkey"))).withColumn("f", F.col("file") % 8))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all workbooks, as a reader of spreadsheets would give them."""
    c = _contracts(spark, sf_dir)
    n, f = F.col("n"), F.col("f")

    def cell(row: Column | int, col: int, value: Column | str, kind: Column | str = "text") -> Column:
        value, kind = (F.lit(v) if isinstance(v, str) else v for v in (value, kind))
        return F.struct((F.lit(row) if isinstance(row, int) else row).cast("int").alias("row"), F.lit(col).alias("col"), kind.alias("kind"), value.cast("string").alias("value"))

    top = 2 + 2 * (n - 1)
    dash = f == 5
    year = F.when(n % 4 == 1, "2024.2.26.~4.5").when(n % 4 == 3, "2024-03").otherwise("2024")
    paid = F.when(n % 5 == 1, "12,345원").when(n % 5 == 3, "확인 불가").otherwise(F.col("o_custkey").cast("string"))
    note = F.when(n % 6 == 0, F.concat(F.lit("업체: (주)"), F.col("o_custkey"))).when(n % 6 == 1, "총금액은 계약금액 임").when(n % 6 == 2, "예산/예상금액").otherwise("")
    number = F.when(dash, "text").otherwise("number")
    second = F.when(n % 5 == 0, F.col("o_orderkey")).otherwise(n % 2)
    body = [
        cell(top, 1, year, F.when(n % 4 % 2 == 0, "number").otherwise("text")), cell(top, 2, F.concat(F.lit("구"), F.col("file"))), cell(top, 3, _pick(_NAMES, n % 7)),
        cell(top, 4, paid, F.when(n % 5 % 2 == 1, "text").otherwise("number")), cell(top, 5, F.when(dash, "-").otherwise(F.concat(F.lit("소각장 : "), n % 3 + 1, F.lit("월")))), cell(top, 6, F.when(dash, "－").otherwise((n % 4).cast("string")), number),
        cell(top, 9, "가; 나"), cell(top, 10, "소각"), cell(top, 11, note), cell(top + 1, 5, F.when(dash, "-").otherwise("재활용 : 계")), cell(top + 1, 6, F.when(dash, "-").otherwise(second.cast("string")), number),
    ]
    ledger = [cell(top, 12, "2024-01"), cell(top + 1, 12, "2024.2")]
    contracts = c.where(f < GRID).select("file", F.lit("A").alias("role"), F.explode(F.when(f == 1, F.array(*body, *ledger)).otherwise(F.array(*body))).alias("c")).select("file", "role", "c.*")

    sums = c.groupBy("file", "f").agg(F.max("n").alias("n"), F.sum(F.when(F.col("n") % 5 == 1, 12345).when(F.col("n") % 5 != 3, F.col("o_custkey"))).alias("sum"))
    pairs = F.when(f == 2, F.array(*map(F.lit, ("항목", "반출량(톤)", "항목2", "반출량2(톤)")))).when(f == 3, F.array(*map(F.lit, ("월별 반출량 항목(소각)", "값", "월별 반출량 항목(매립)", "값")))).when(f == 4, F.array(*map(F.lit, ("항목1", "항목1의 수치)", "항목2", "항목2의 수치)")))).otherwise(F.array(*map(F.lit, ("항목", "반출량", "항목", "반출량"))))
    head = F.concat(F.array(*map(F.lit, ("년도", "기관명", "계약명"))), F.array(F.when(f == 6, "계약금액").when(F.col("file") % 16 == 0, "2024년 금액").otherwise("총 금액(원)")), pairs, F.array(*map(F.lit, ("최종 처리시설", "처리방식", "비고"))), F.when(f == 1, F.array(*map(F.lit, ("지급월", "월별 지급액 합계(원)")))).otherwise(F.array().cast("array<string>")))
    heads = sums.where(f < GRID).select("file", F.lit("A").alias("role"), F.lit(1).alias("row"), F.posexplode(head).alias("col", "value"))
    heads = heads.select("file", "role", "row", (F.col("col") + 1).alias("col"), F.lit("text").alias("kind"), "value")
    last = 2 + 2 * n
    total = F.col("sum") + F.when(F.col("file") % 3 == 0, 1).otherwise(0)
    totals = sums.where(f < GRID).select("file", F.lit("A").alias("role"), F.explode(F.array(cell(last, 3, "합계"), cell(last, 4, total, "number"))).alias("c")).select("file", "role", "c.*")

    months = c.where(f == GRID).groupBy("file").agg(*[F.count_if((F.col("o_orderkey") % 12 == m) & (F.col("o_orderkey") % 3 == k)).alias(f"m{m}_{k}") for m in range(12) for k in range(3) if m % 3 == k])
    value = lambda m, k: F.col(f"m{m}_{k}") if m % 3 == k else F.lit(0)
    dashed = F.col("file") % 16 == 15
    lines = [cell(1, 1, "구분"), *[cell(1, m + 2, f"{m + 1}월") for m in range(12)], cell(1, 14, "계")]
    for k, name in enumerate(("일반", "음식물", "재활용")):
        off = dashed & (k == 2)
        lines += [cell(k + 2, 1, name), *[cell(k + 2, m + 2, F.when(off, "-").otherwise(value(m, k).cast("string")), F.when(off, "text").otherwise("number")) for m in range(12)]]
        whole = value(0, k)
        for m in range(1, 12):
            whole = whole + value(m, k)
        lines.append(cell(k + 2, 14, F.when(off, 0).otherwise(whole + F.when((F.col("file") % 16 == 7) & (k == 1), 1).otherwise(0)), "number"))
    grids = months.select("file", F.lit("B").alias("role"), F.explode(F.array(*lines)).alias("c")).select("file", "role", "c.*")
    return contracts.unionByName(heads).unionByName(totals).unionByName(grids)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_ORDERS = f"c AS (SELECT o_orderkey, o_custkey, o_custkey % {FILES} AS file, o_custkey % {FILES} % 8 AS f, row_number() OVER (PARTITION BY o_custkey % {FILES} ORDER BY o_orderkey) AS n FROM orders)"
_AMOUNT = "CASE WHEN n % 5 = 1 THEN 12345 WHEN n % 5 <> 3 THEN o_custkey END"
_PAID = "CASE n % 6 WHEN 1 THEN 'CONTRACT_AWARD_AMOUNT' WHEN 2 THEN 'BUDGET_ESTIMATE' ELSE 'ACTUAL_PAID_AMOUNT' END"


@query(
    "cell_table_to_contracts",
    f"""WITH {_ORDERS}, d AS (SELECT *, CAST({_AMOUNT} AS DOUBLE) AS amount, {_list(_BASES)}[n % 7 + 1] AS basis, {_PAID} AS paid,
  concat_ws(',', CASE WHEN n % 2 = 1 THEN 'PARTIAL_PERIOD_COVERAGE' END, CASE WHEN n % 7 = 4 THEN 'PARTIAL_GEOGRAPHIC_SCOPE' END, CASE WHEN f = 1 THEN 'PAYMENT_PERIOD_COVERAGE_INCOMPLETE' END) AS limits FROM c WHERE f < 6)
SELECT file, CAST(2 * n AS INTEGER) AS row, CAST(2 * n + 1 AS INTEGER) AS row_end, replace({_list(_NAMES)}[n % 7 + 1], '  ', ' ') AS contract_name, CASE WHEN n % 6 = 0 THEN '(주)' || o_custkey END AS contractor, amount, paid AS payment_type, basis AS accounting_basis,
  amount IS NOT NULL AND paid = 'ACTUAL_PAID_AMOUNT' AND basis LIKE 'COLL%' AS eligible, {_list(_SCOPES)}[n % 7 + 1] AS waste_scope, CASE WHEN n % 7 = 4 THEN 'SUB_MUNICIPAL' ELSE 'WHOLE_MUNICIPALITY' END AS geographic_scope,
  CASE WHEN amount IS NULL THEN 'UNUSABLE' WHEN limits <> '' THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness, concat_ws(',', nullif(limits, ''), CASE WHEN basis NOT LIKE 'COLL%' THEN 'NON_COLLECTION_TRANSPORT_BASIS' END) AS limitations,
  CASE WHEN n % 4 = 1 THEN DATE '2024-02-26' END AS period_start, CASE WHEN n % 4 = 1 THEN DATE '2024-04-05' END AS period_end FROM d""",
)
def cell_table_to_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts of all workbooks whose layout is supported."""
    found = workbooks.contracts(_cells(spark, sf_dir), YEAR)
    columns = ["file", "row", "row_end", "contract_name", "contractor", "payment_type", "accounting_basis", "eligible", "waste_scope", "geographic_scope", "completeness", "period_start", "period_end"]
    return found.select(*columns, F.col("amount").cast("double").alias("amount"), F.array_join("limitations", ",").alias("limitations"))


@query(
    "workbook_quantities",
    f"""WITH {_ORDERS}, d AS (SELECT *, CASE WHEN f = 5 OR n % 5 = 0 THEN 'u' || o_orderkey ELSE 'r' || n % 12 END AS mark FROM c WHERE f < 6),
g AS (SELECT *, count(*) OVER (PARTITION BY file, mark) AS copies, min(n) OVER (PARTITION BY file, mark) AS first FROM d),
h AS (SELECT *, copies > 1 AS rep FROM g WHERE n = first)
SELECT file, CAST(2 * n + i AS INTEGER) AS row, CASE WHEN f = 5 THEN '-' WHEN i = 0 THEN '소각장 : ' || (n % 3 + 1) || '월' ELSE '재활용 : 계' END AS label, CAST(copies AS INTEGER) AS places, CASE WHEN NOT rep THEN CAST(2 * n AS INTEGER) END AS contract_row,
  CASE WHEN f <> 5 AND i = 0 THEN '2024-0' || (n % 3 + 1) END AS month, CASE WHEN f = 5 THEN 'UNSPECIFIED' WHEN i = 0 THEN 'MONTHLY' ELSE 'ANNUAL' END AS period, CASE WHEN f <> 5 AND i = 1 THEN 'RECYCLING' ELSE {_list(_STREAMS)}[n % 7 + 1] END AS category,
  CAST(CASE WHEN f = 5 THEN NULL WHEN i = 0 THEN n % 4 WHEN n % 5 = 0 THEN o_orderkey ELSE n % 2 END AS DOUBLE) AS quantity,
  CASE WHEN f = 5 THEN 'SOURCE_DASH_NO_DATA' WHEN (i = 0 AND n % 4 = 0) OR (i = 1 AND n % 5 <> 0 AND n % 2 = 0) THEN 'MEASURED_ZERO' ELSE 'MEASURED' END AS value_state,
  CASE WHEN rep THEN 'MUNICIPAL_TOTAL_REPEATED_PER_CONTRACT' ELSE 'PER_CONTRACT' END AS attribution FROM h, (VALUES (0), (1)) AS v(i)""",
)
def workbook_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of label and value; blocks that stand under several contracts are one series of the municipality."""
    found = workbooks.quantities(_cells(spark, sf_dir), YEAR)
    return found.select("file", "row", "label", F.size("at_rows").alias("places"), "contract_row", "month", "period", "category", F.col("quantity").cast("double").alias("quantity"), "value_state", "attribution")


@query(
    "workbook_status",
    f"""WITH {_ORDERS}, s AS (SELECT file, f, count(*) AS n, CAST(sum({_AMOUNT}) AS DOUBLE) AS total, CAST(sum({_AMOUNT}) FILTER (WHERE {_PAID} = 'ACTUAL_PAID_AMOUNT' AND {_list(_BASES)}[n % 7 + 1] LIKE 'COLL%') AS DOUBLE) AS ok FROM c GROUP BY 1, 2)
SELECT file, CASE WHEN f = 6 THEN 'UNSUPPORTED_LAYOUT' WHEN f = 7 THEN 'DATA_B_MONTHLY_CATEGORY_GRID' ELSE 'DATA_A_CONTRACT_' || {_list(_LAYOUTS)}[f + 1] END AS layout, CASE WHEN f < 6 THEN n ELSE 0 END AS contracts,
  CASE WHEN f < 6 THEN total + CASE WHEN file % 3 = 0 THEN 1 ELSE 0 END END AS stated, CASE WHEN f < 6 THEN total END AS recomputed, CASE WHEN f < 6 THEN ok END AS eligible_sum,
  CASE WHEN f = 6 THEN 'UNSUPPORTED_LAYOUT' WHEN f = 7 THEN 'DATA_B_QUANTITY_VALIDATION' WHEN f = 5 THEN 'DATA_A_PAYMENT_ONLY' ELSE 'DATA_A_PAYMENT_AND_QUANTITY' END AS classification,
  concat_ws(',', CASE WHEN f = 6 THEN 'UNSUPPORTED_SOURCE_LAYOUT' END, CASE WHEN f < 6 AND file % 3 = 0 THEN 'INCONSISTENT_TOTAL' END, CASE WHEN f < 6 THEN 'NON_COLLECTION_TRANSPORT_BASIS' END) AS reasons FROM s""",
)
def workbook_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout, sums and use of each workbook."""
    found = workbooks.file_status(_cells(spark, sf_dir), YEAR)
    return found.select("file", "layout", "contracts", *[F.col(c).cast("double").alias(c) for c in ("stated", "recomputed", "eligible_sum")], "classification", "reasons")


@query(
    "workbook_grid",
    f"""WITH {_ORDERS}, k AS (SELECT unnest([0, 1, 2]) AS k), m AS (SELECT unnest(range(12)) AS m), v AS (SELECT file, k, m, count(o_orderkey) FILTER (WHERE o_orderkey % 12 = m AND o_orderkey % 3 = k) AS n FROM c, k, m WHERE f = {GRID} GROUP BY ALL),
t AS (SELECT file, k, NULL AS m, sum(n) + CASE WHEN file % 16 = 7 AND k = 1 THEN 1 ELSE 0 END AS n FROM v GROUP BY 1, 2), a AS (SELECT file, k, m, CAST(n AS BIGINT) AS n, file % 16 = 15 AND k = 2 AS off FROM (SELECT * FROM v UNION ALL SELECT * FROM t))
SELECT file, ['GENERAL', 'FOOD', 'RECYCLING'][k + 1] AS category, CASE WHEN m IS NOT NULL THEN '{YEAR}-' || lpad(CAST(m + 1 AS VARCHAR), 2, '0') END AS month, CASE WHEN NOT off THEN CAST(n AS DOUBLE) END AS quantity,
  CASE WHEN off THEN 'SOURCE_DASH_NO_DATA' WHEN n = 0 THEN 'MEASURED_ZERO' ELSE 'MEASURED' END AS value_state, CASE WHEN m IS NULL AND off THEN 'ZERO_TOTAL_QUANTITY' WHEN m IS NULL AND file % 16 = 7 AND k = 1 THEN 'INCONSISTENT_TOTAL' END AS limitation FROM a""",
)
def workbook_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months and totals of the monthly grids."""
    found = workbooks.grid_quantities(_cells(spark, sf_dir), YEAR)
    return found.select("file", "category", "month", F.col("quantity").cast("double").alias("quantity"), "value_state", "limitation")
