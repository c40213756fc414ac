"""Contract workbooks: every layout, every kind of cell, as delivered files have them."""

from __future__ import annotations

import pytest

from strataform.operators import workbooks

YEAR = 2024
CELLS = "file string, role string, row int, col int, kind string, value string"
HEAD = ["년도", "기관명", "계약명", "총 금액(원)"]
TAIL = ["최종 처리시설", "처리방식", "비고"]


def cells_of(file, role, grid):
    return [(file, role, r, c, "number" if isinstance(v, (int, float)) else "text", str(v)) for r, line in enumerate(grid, 1) for c, v in enumerate(line, 1) if v is not None]


def frame(spark, *files):
    return spark.createDataFrame([c for f in files for c in cells_of(*f)], CELLS)


def sheet(pairs=("월별 반출량 항목", "반출량"), rows=(), extra=(), head=HEAD):
    return [[*head, *pairs, *TAIL, *extra], *rows]


MONTHS = [f"{m}월" for m in range(1, 13)]


@pytest.fixture(scope="module")
def every(spark):
    one = [2024, "갑구", "생활폐기물 수집·운반", 100, "소각장 : 1월", 5, "소각장", "소각", None]
    grid = [["구분", *MONTHS, "계"], ["일반", *range(1, 13), 78], ["음식물", *["-"] * 12, 0], ["재활용", *[1.00004] * 12, 13], ["※ 비고"], ["계", None, "미제공", *[0] * 10, 0]]
    return frame(
        spark,
        ("pairs", "A", sheet(rows=[one])),
        ("ledger", "A", sheet(rows=[[*one, "2024-01"], [None] * 9 + ["2024.3"], [None] * 9 + ["2023-05"]], extra=["지급월", "월별 지급액 합계(원)"])),
        ("tonnes", "A", sheet(("항목", "반출량(톤)", "항목2", "반출량2(톤)"), [[2024, "갑구", "청소", 1, "a", 1, "b", 2, "x", "y", None]])),
        ("destinations", "A", sheet(("월별 반출량 항목(소각)", "값"), [one])),
        ("numbered", "A", sheet(("항목1", "항목1의 수치)"), [one])),
        ("dashes", "A", sheet(rows=[[2024, "갑구", "청소", "－", "-", "ㅡ", "x", "y", None]])),
        ("year", "A", sheet(rows=[one], head=["연도", "기관명", "계약명", "2024년 금액"])),
        ("odd", "A", sheet(("하나", "둘", "셋"), [[*one[:5], 1, 2, *one[6:]]])),
        ("headless", "A", sheet(rows=[one], head=["년도", "기관명", "계약명", "계약금액"])),
        ("grid", "B", grid),
        ("short", "B", [["구분", *MONTHS[:11], "계"]]),
    )


def test_layouts(every):
    assert {r.file: r.layout for r in workbooks.layouts(every, YEAR).collect()} == {
        "pairs": "DATA_A_CONTRACT_QUANTITY_PAIRS", "ledger": "DATA_A_CONTRACT_WITH_PAYMENT_LEDGER", "tonnes": "DATA_A_CONTRACT_TONNE_LABELLED_PAIRS",
        "destinations": "DATA_A_CONTRACT_DESTINATION_SPLIT", "numbered": "DATA_A_CONTRACT_NUMBERED_PAIRS", "dashes": "DATA_A_CONTRACT_DASH_ONLY_QUANTITY",
        "year": "DATA_A_CONTRACT_QUANTITY_PAIRS", "odd": "UNSUPPORTED_LAYOUT", "headless": "UNSUPPORTED_LAYOUT", "grid": "DATA_B_MONTHLY_CATEGORY_GRID", "short": "UNSUPPORTED_LAYOUT",
    }


def test_status_of_files(every):
    found = {r.file: (r.contracts, r.classification, r.reasons) for r in workbooks.file_status(every, YEAR).collect()}
    good = (1, "DATA_A_PAYMENT_AND_QUANTITY", "")
    assert found["pairs"] == found["ledger"] == found["tonnes"] == found["destinations"] == found["numbered"] == found["year"] == good
    assert found["dashes"] == (1, "EMPTY_OR_NO_DATA", "") and found["grid"] == (0, "DATA_B_QUANTITY_VALIDATION", "")
    assert found["odd"] == found["headless"] == found["short"] == (0, "UNSUPPORTED_LAYOUT", "UNSUPPORTED_SOURCE_LAYOUT")


def test_grid_cells(every):
    rows = workbooks.grid_quantities(every, YEAR).collect()
    assert len(rows) == 4 * 13 and {r.row for r in rows} == {2, 3, 4, 6}
    of = {(r.category, r.month): (None if r.quantity is None else float(r.quantity), r.value_state, r.limitation) for r in rows}
    assert of["GENERAL", "2024-12"] == (12.0, "MEASURED", None) and of["GENERAL", None] == (78.0, "MEASURED", None)
    assert of["FOOD", "2024-03"] == (None, "SOURCE_DASH_NO_DATA", None) and of["FOOD", None] == (None, "SOURCE_DASH_NO_DATA", "ZERO_TOTAL_QUANTITY")
    assert of["RECYCLING", "2024-01"] == (1.0, "MEASURED", None) and of["RECYCLING", None] == (13.0, "MEASURED", "INCONSISTENT_TOTAL")
    assert of["COMBINED", "2024-01"] == (None, "BLANK", None) and of["COMBINED", "2024-02"] == (None, "SOURCE_TEXT_NO_DATA", None) and of["COMBINED", None] == (0.0, "MEASURED_ZERO", None)


def test_contracts_and_their_blocks(spark):
    rows = [
        ["년도", "기관명", "계약명", "금액", None, None, None, None, None],
        [2024, "갑구", "음식물류폐기물 위탁처리", "6,556,861,120원", "소각장 : 1월", 5.5, "가;나 / 다", "소각", None],
        [None, None, None, None, "소각장 : 2월", "-", None, None, None],
        ["2024.2.26.~4.5", "갑구", "재활용품 수집운반 선별처리 용역", 50, "미제공", None, "", "", "업체: (주)을"],
        ["2024-03", "갑구", "생활폐기물(영흥면) 반입수수료 운반", "확인 불가", "소각장 : 1월", 5.5, None, None, "총금액은 계약금액 임"],
        [None, None, None, None, "소각장 : 2월", "-", None, None, None],
        [2024, "갑구", "기타", 1.25, "2023-06", 3, None, None, "예산/예상금액"],
        [None, None, "합계", 51, None, None, None, None, None],
        [None, None, None, "끝", "뒤 : 1월", 1, None, None, None],
    ]
    df = frame(spark, ("a", "A", sheet(rows=rows)))
    found = {r.row: r for r in workbooks.contracts(df, YEAR).collect()}
    assert sorted((r.row, r.row_end) for r in found.values()) == [(3, 4), (5, 5), (6, 7), (8, 8)]
    assert [found[i].accounting_basis for i in (3, 5, 6, 8)] == ["TREATMENT_SERVICE", "COLLECTION_TRANSPORT_WITH_TREATMENT", "FACILITY_INBOUND_FEE", "COLLECTION_TRANSPORT"]
    assert [found[i].waste_scope for i in (3, 5, 6, 8)] == ["FOOD_ONLY", "RECYCLING_ONLY", "ALL_MUNICIPAL", "UNKNOWN"]
    assert [None if found[i].amount is None else float(found[i].amount) for i in (3, 5, 6, 8)] == [6556861120.0, 50.0, None, 1.25]
    assert [found[i].eligible for i in (3, 5, 6, 8)] == [False, True, False, False]
    assert [found[i].payment_type for i in (3, 5, 6, 8)] == ["ACTUAL_PAID_AMOUNT", "ACTUAL_PAID_AMOUNT", "CONTRACT_AWARD_AMOUNT", "BUDGET_ESTIMATE"]
    assert [found[i].limitations for i in (3, 5, 6, 8)] == [["NON_COLLECTION_TRANSPORT_BASIS"], ["PARTIAL_PERIOD_COVERAGE"], ["PARTIAL_PERIOD_COVERAGE", "PARTIAL_GEOGRAPHIC_SCOPE", "NON_COLLECTION_TRANSPORT_BASIS"], []]
    assert [found[i].completeness for i in (3, 5, 6, 8)] == ["COMPLETE", "PARTIAL", "UNUSABLE", "COMPLETE"]
    assert found[3].destinations == ["가", "나", "다"] and found[5].contractor == "(주)을" and str(found[5].period_end) == "2024-04-05" and found[6].payment_text == "확인 불가"

    parts = sorted(workbooks.quantities(df, YEAR).collect(), key=lambda r: r.row)
    assert [(r.row, r.contract_row, r.at_rows, r.attribution[:9]) for r in parts] == [(3, None, [3, 6], "MUNICIPAL"), (4, None, [4, 7], "MUNICIPAL"), (5, 5, [5], "PER_CONTR"), (8, 8, [8], "PER_CONTR")]
    assert [(r.month, r.period, r.category, r.value_state, r.destination, r.mixed_years) for r in parts] == [
        ("2024-01", "MONTHLY", "FOOD", "MEASURED", "소각장", False), ("2024-02", "MONTHLY", "FOOD", "SOURCE_DASH_NO_DATA", "소각장", False),
        (None, "UNSPECIFIED", "RECYCLING", "SOURCE_TEXT_NO_DATA", "미제공", False), ("2023-06", "MONTHLY", "UNKNOWN", "MEASURED", "2023-06", True),
    ]
    (status,) = workbooks.file_status(df, YEAR).collect()
    assert (status.classification, status.reasons, float(status.stated), float(status.eligible_sum)) == ("DATA_A_PARTIAL_WASTE_SCOPE", "INCONSISTENT_TOTAL,NON_COLLECTION_TRANSPORT_BASIS,PARTIAL_WASTE_SCOPE", 51.0, 50.0)


def test_no_cells(spark):
    none = spark.createDataFrame([], CELLS)
    assert workbooks.file_status(none, YEAR).count() == workbooks.contracts(none, YEAR).count() == workbooks.grid_quantities(none, YEAR).count() == 0


def test_blocks_over_stretches(spark, monkeypatch):
    """Blocks, their ends and the total row are found over borders of stretches, also over stretches without any start."""
    body = [[2024, "갑구", f"청소 {i}", i, "소각장 : 1월", 1, "x", "y", None] if i in (1, 2, 9, 20) else [None] * 4 + ["소각장 : 2월", 2] + [None] * 3 for i in range(1, 26)]
    body[22][2] = "합계"
    df = frame(spark, ("a", "A", sheet(rows=body)))
    for stretch in (1, 3, 7, 4096):
        monkeypatch.setattr(workbooks, "STRETCH", stretch)
        assert sorted((r.row, r.row_end) for r in workbooks.contracts(df, YEAR).collect()) == [(2, 2), (3, 9), (10, 20), (21, 23)]
        parts = workbooks.quantities(df, YEAR).collect()
        assert {(r.row, r.contract_row) for r in parts} == {(i, max(b for b in (2, 3, 10, 21) if b <= i)) for i in range(2, 24)}


def test_no_window_reads_all_rows_for_each(spark):
    """A frame that begins after its row is read anew for each row, and a list over all copies stood in every copy."""
    df = frame(spark, ("a", "A", sheet(rows=[[2024, "갑구", "청소", 1, "a", 1, "x", "y", None]])))
    for made in (workbooks.contracts, workbooks.quantities, workbooks.file_status):
        plan = made(df, YEAR)._jdf.queryExecution().optimizedPlan().toString()
        assert "RowFrame, 1, unboundedfollowing" not in plan and not [line for line in plan.splitlines() if "Window [" in line and "collect_list" in line]


def test_status_counts_quantities_of_blocks_only(spark):
    blank = [None] * 9
    one = [2024, "갑구", "청소", 100, "a", None, "x", "y", None]
    value = [*blank[:4], "b", 5, *blank[6:]]
    total = [None, None, "합계", 100, *blank[4:]]
    files = {"before": [value, one, total], "within": [one, value, total], "after": [one, total, value], "begins": [one, total, [*one[:5], 7, *one[6:]]], "on_total": [one, [*total[:5], 3, *blank[6:]]]}
    cells = frame(spark, *[(name, "A", sheet(rows=rows)) for name, rows in files.items()])
    status = {r.file: "QUANTITY" in r.classification for r in workbooks.file_status(cells, YEAR).collect()}
    made = {r.file for r in workbooks.quantities(cells, YEAR).where("quantity IS NOT NULL").collect()}
    assert status == {name: name in made for name in files}
    assert made == {"within", "begins"}
