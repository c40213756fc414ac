"""What the words in a contract workbook mean: streams, scopes, accounting bases, payments, values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strataform.functions.labels import let, tidy

#: Words of the sources, in their own spellings, and what they stand for.
DASHES = ["-", "－", "–", "—", "ㅡ", "‐", "‑"]
NO_DATA = ["미제공", "자료없음", "확인불가", "자료부존재", "부존재", "해당없음", "없음"]
TOTAL_WORDS = ["합계", "총계", "소계", "계"]
INBOUND_FEE = ["반입수수료", "반입 수수료"]
TREATMENT = [
    "위탁처리", "위탁 처리", "처리위탁", "처리 위탁", "소각처리", "소각 처리", "선별처리", "선별 처리",
    "처리용역", "처리 용역", "처리대행", "처리 대행", "대행처리", "대행 처리",
]
TRANSPORT = ["수집", "운반", "수송", "청소"]
NARROW_SCOPES = {
    "GENERAL_ONLY": ["(일반)", "일반쓰레기", "가연성"],
    "FOOD_ONLY": ["음식물"],
    "RECYCLING_ONLY": ["재활용", "미선별플라스틱"],
    "MIXED_PARTIAL": ["대형폐기물"],
}
WHOLE_STREAM = ["생활폐기물", "생활쓰레기", "청소", "생활 폐기물"]
STREAMS = {"FOOD": ["음식물"], "RECYCLING": ["재활용"], "BULKY": ["대형"], "GENERAL": ["일반", "가연성"]}
STREAM_OF_SCOPE = {
    "ALL_MUNICIPAL": "COMBINED", "GENERAL_ONLY": "GENERAL", "FOOD_ONLY": "FOOD", "RECYCLING_ONLY": "RECYCLING", "MIXED_PARTIAL": "COMBINED", "UNKNOWN": "UNKNOWN",
}
EVERY_STREAM = ["GENERAL_ONLY", "FOOD_ONLY", "RECYCLING_ONLY"]
AWARD_NOTES = ["d열은 계약금액", "총금액은 계약금액", "총 금액은 계약금액", "지급액이 아닌 계약금액"]
BUDGET_NOTES = ["예산/예상금액", "실적 정산치 아닌", "예산·예상금액"]
PART_OF_CITY = r"\([^)]*[읍면][^)]*\)"
ELIGIBLE_BASES = ["COLLECTION_TRANSPORT", "COLLECTION_TRANSPORT_WITH_TREATMENT"]
PLACES = 4


def says(text: Column, words: list[str]) -> Column:
    """Whether a text has any of the words: all are looked for in one pass."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def _named(text: Column, kinds: dict[str, list[str]]) -> Column:
    """The kinds of which a text has a word."""
    return F.array_compact(F.array(*[F.when(says(text, words), F.lit(kind)) for kind, words in kinds.items()]))


def waste_scope(name: Column) -> Column:
    """One narrow stream that a contract names; several, or none but household waste, are the whole; else unknown."""

    def of(text: Column, narrow: Column) -> Column:
        whole = (F.size(narrow) > 1) | (F.size(narrow) == 0) & says(text, WHOLE_STREAM)
        return F.when(whole, "ALL_MUNICIPAL").when(F.size(narrow) == 1, F.get(narrow, 0)).otherwise("UNKNOWN")

    return let(tidy(name), lambda text: let(_named(text, NARROW_SCOPES), lambda narrow: of(text, narrow)))


def waste_category(label: Column, scope: Column) -> Column:
    """The stream that a label names, COMBINED for several; without one the stream of its contract's scope."""
    other = F.create_map(*[F.lit(x) for pair in STREAM_OF_SCOPE.items() for x in pair])[scope]
    of = lambda named: F.when(F.size(named) == 1, F.get(named, 0)).when(F.size(named) > 1, "COMBINED").otherwise(F.coalesce(other, F.lit("UNKNOWN")))
    return let(tidy(label), lambda text: let(_named(text, STREAMS), of))


def accounting_basis(name: Column) -> Column:
    """A gate fee is one whatever else is said; treatment counts only where a way of treatment is bought, alone or with haulage."""

    def of(text: Column) -> Column:
        bought = F.when(says(text, TRANSPORT), "COLLECTION_TRANSPORT_WITH_TREATMENT").otherwise("TREATMENT_SERVICE")
        return F.when(says(text, INBOUND_FEE), "FACILITY_INBOUND_FEE").when(says(text, TREATMENT), bought).otherwise("COLLECTION_TRANSPORT")

    return let(tidy(name), of)


def payment_type(note: Column) -> Column:
    """An amount is paid unless the note says that it is an award or an estimate."""
    return let(F.lower(tidy(note)), lambda text: F.when(says(text, AWARD_NOTES), "CONTRACT_AWARD_AMOUNT").when(says(text, BUDGET_NOTES), "BUDGET_ESTIMATE").otherwise("ACTUAL_PAID_AMOUNT"))


def geographic_scope(name: Column) -> Column:
    return F.when(tidy(name).rlike(PART_OF_CITY), "SUB_MUNICIPAL").otherwise("WHOLE_MUNICIPALITY")


def covers_every_stream(scopes: Column) -> Column:
    """Whether the scopes of contracts make up all streams together."""
    return F.array_contains(scopes, "ALL_MUNICIPAL") | (F.size(F.array_except(F.array(*[F.lit(s) for s in EVERY_STREAM]), scopes)) == 0)


def cell_value(kind: Column, value: Column, label: Column) -> tuple[Column, Column]:
    """The fields of ``cell_read``: number and state."""
    found = cell_read(kind, value, label)
    return found["number"], found["state"]


def quantity(kind: Column, value: Column) -> Column:
    """A number cell's number, half to even at four places; null for all else."""
    return F.when(kind == "number", F.bround(value.try_cast("decimal(28,12)"), PLACES).cast("decimal(20,4)"))


def cell_read(kind: Column, value: Column, label: Column) -> Column:
    """A quantity cell's number, half to even at four places, and its state; no text and no blank is ever a zero.

    A cell without text has the state that its label declares.
    """

    def stated(t: Column) -> Column:
        return F.when(t.isin(DASHES), "SOURCE_DASH_NO_DATA").when(F.replace(t, F.lit(" "), F.lit("")).isin(NO_DATA), "SOURCE_TEXT_NO_DATA")

    prose = let(tidy(value), lambda t: F.when(t != "", F.coalesce(stated(t), F.lit("SOURCE_TEXT_NO_DATA"))))
    number = quantity(kind, value)
    of = lambda n: F.struct(n.alias("number"), F.when(n == 0, "MEASURED_ZERO").when(n.isNotNull(), "MEASURED").otherwise(F.coalesce(prose, let(tidy(label), stated), F.lit("BLANK"))).alias("state"))
    return let(number, of)
