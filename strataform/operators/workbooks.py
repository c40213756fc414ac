"""Contract workbooks as tables of cells: layouts by their headers, contracts and quantities by windows.

Cells are rows: file, role (A: contracts, B: a grid of months), row, col, kind
(number or text) and value, all numbers as text. Nothing is found by its place:
header names give the columns, once a file, and cells meet them in a join on the
file. A contract's block is what lies between its row and the next one: windows
over stretches of ``STRETCH`` rows find it, and one over a file's stretches tells
each what lies before and after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataform.functions import labels, workbook_terms as terms
from strataform.functions.labels import tidy
from strataform.functions.staging import staged

#: Header names, marks of layouts, and rows of the monthly grid.
YEAR, ORGANISATION, CONTRACT, FACILITY, METHOD, NOTE = ["년도", "연도"], "기관명", "계약명", "최종 처리시설", "처리방식", "비고"
PAYMENT_BEGINS, PAYMENT_OF_YEAR = "총 금액", "{}년 금액"
LEDGER_MONTH, LEDGER_AMOUNT_BEGINS = "지급월", "월별 지급액 합계"
TONNES, DESTINATIONS, NUMBERED = ("반출량(톤)", "반출량2(톤)"), "월별 반출량 항목(", "의 수치)"
GRID_CATEGORY, GRID_TOTAL = "구분", "계"
GRID_ROWS = {"일반": "GENERAL", "음식물": "FOOD", "재활용": "RECYCLING", "계": "COMBINED"}
NAME_LENGTH, LABEL_LENGTH = 400, 200
#: Rows of a file that meet in one window, and files whose columns are sent to all tasks.
STRETCH, FEW = 4096, 10_000


def _sent(files: DataFrame) -> DataFrame:
    """Staged rows of files, to be joined: those of few files are sent to all tasks, so that cells stay where they are."""
    return F.broadcast(files) if files.count() <= FEW else files


def layouts(cells: DataFrame, year: int) -> DataFrame:
    """file, role, layout, and the columns that its headers name; UNSUPPORTED_LAYOUT where one that it needs is missing.

    The columns between payment and facility are pairs of label and value; an
    odd number of them isn't supported. Headers are staged, and so is the
    result: cells are read once for each of them, whoever asks.
    """
    head = staged(cells.where("row = 1")).withColumn("t", tidy(F.col("value")))
    first = lambda c: F.min(F.when(c, F.col("col")))
    t = F.col("t")
    months = [F.max(F.when(t.rlike(f"^0?{m}월(.*월)?$"), F.col("col"))) for m in range(1, 13)]
    found = head.groupBy("file", "role").agg(
        F.coalesce(*[first(t == name) for name in YEAR]).alias("year_col"),
        *[first(t == name).alias(column) for name, column in ((ORGANISATION, "organisation_col"), (CONTRACT, "contract_col"), (FACILITY, "facility_col"), (METHOD, "method_col"), (NOTE, "note_col"), (LEDGER_MONTH, "ledger_col"), (GRID_CATEGORY, "category_col"))],
        F.coalesce(first(t.startswith(PAYMENT_BEGINS)), first(t == PAYMENT_OF_YEAR.format(year))).alias("payment_col"),
        first(t.startswith(LEDGER_AMOUNT_BEGINS)).alias("ledger_amount_col"),
        F.max(F.when(t == GRID_TOTAL, F.col("col"))).alias("total_col"),
        F.array(*months).alias("month_cols"),
    )
    needed = [F.col(c).isNotNull() for c in ("year_col", "organisation_col", "contract_col", "payment_col", "facility_col", "method_col", "note_col")]
    whole = needed[0]
    for c in needed[1:]:
        whole = whole & c
    span = F.col("facility_col") - F.col("payment_col") - 1
    grid = F.col("category_col").isNotNull() & F.col("total_col").isNotNull() & (F.size(F.array_compact("month_cols")) == 12)
    fits = F.when(F.col("role") == "B", grid).otherwise(whole & (span >= 0) & (span % 2 == 0))
    found = found.withColumn("fits", F.coalesce(fits, F.lit(False)))

    found = staged(found)
    spans = found.where("role <> 'B' AND fits").select("file", "payment_col", "facility_col")
    between = "col > payment_col AND col < facility_col"
    told = lambda words: F.bool_or(F.contains(t, F.lit(words)))
    heads = head.join(spans, "file").where(between).groupBy("file").agg((told(TONNES[0]) & told(TONNES[1])).alias("tonnes"), told(DESTINATIONS).alias("destinations"), told(NUMBERED).alias("numbered"))
    written = cells.where("row > 1").join(_sent(spans), "file").where(between).groupBy("file").agg((F.count_if(~tidy(F.col("value")).isin(terms.DASHES)) == 0).alias("dashes"))
    kind = (
        F.when(~F.col("fits"), "UNSUPPORTED_LAYOUT")
        .when(F.col("role") == "B", "DATA_B_MONTHLY_CATEGORY_GRID")
        .when(F.col("ledger_col").isNotNull() & F.col("ledger_amount_col").isNotNull(), "DATA_A_CONTRACT_WITH_PAYMENT_LEDGER")
        .when(F.col("tonnes"), "DATA_A_CONTRACT_TONNE_LABELLED_PAIRS")
        .when(F.col("destinations"), "DATA_A_CONTRACT_DESTINATION_SPLIT")
        .when(F.col("numbered"), "DATA_A_CONTRACT_NUMBERED_PAIRS")
        .when(F.col("dashes"), "DATA_A_CONTRACT_DASH_ONLY_QUANTITY")
        .otherwise("DATA_A_CONTRACT_QUANTITY_PAIRS")
    )
    return staged(found.join(heads, "file", "left").join(written, "file", "left").withColumn("layout", kind).drop("tonnes", "destinations", "numbered", "dashes"))


def _amount(kind: Column, value: Column) -> Column:
    """Exact won of a number, or of a text that is an amount and nothing else."""
    return F.when(kind == "number", value.try_cast("decimal(38,6)")).otherwise(labels.money(value))


def _bodies(cells: DataFrame, found: DataFrame) -> DataFrame:
    """The cells below the header of contract files, with the columns of their file and the stretch of rows that they lie in."""
    return cells.where("row > 1").join(_sent(found.where("role <> 'B' AND fits")), "file").withColumn("stretch", F.floor(F.col("row") / STRETCH))


def _starts(rows: DataFrame) -> DataFrame:
    """Rows with ``total``, and with ``starts``: their number if a contract begins there."""
    name = tidy(F.col("contract.value"))
    total = name.isin(terms.TOTAL_WORDS)
    return rows.withColumn("total", total).withColumn("starts", F.when((name != "") & (name != CONTRACT) & ~total, F.col("row")))


def _contract_rows(own: DataFrame) -> DataFrame:
    """file, stretch, row, contract, total and starts of each row with a cell in the contract column."""
    return _starts(own.where("col = contract_col").groupBy("file", "stretch", "row").agg(F.max(F.struct("kind", "value")).alias("contract")))


def _stretches(own: DataFrame) -> DataFrame:
    """file, stretch, the last start before it and the first one after it, and the file's boundary: its first total row, or the row after its last."""
    firsts = _contract_rows(own).groupBy("file", "stretch").agg(F.min("starts").alias("first"), F.max("starts").alias("final"), F.min(F.when(F.col("total"), F.col("row"))).alias("total"))
    tops = own.groupBy("file", "stretch").agg(F.max("row").alias("top")).join(firsts, ["file", "stretch"], "left")
    whole = Window.partitionBy("file")
    # a frame that ends before the row, in either order: one that begins after it would be read anew for each row
    before = lambda order: whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tops.select(
        "file", "stretch", F.max("final").over(before(F.col("stretch"))).alias("earlier"), F.min("first").over(before(F.desc("stretch"))).alias("later"),
        F.coalesce(F.min("total").over(whole), F.max("top").over(whole) + 1).alias("boundary"),
    )


def _blocks(cells: DataFrame, found: DataFrame) -> DataFrame:
    """file, row and the cells of named columns for each row of contract files, with start and end of the block that it lies in (null: none)."""
    own = _bodies(cells, found)
    named = ["year", "organisation", "contract", "payment", "facility", "method", "note", "ledger"]
    rows = own.groupBy("file", "stretch", "row").agg(*[F.max(F.when(F.col("col") == F.col(f"{n}_col"), F.struct("kind", "value"))).alias(n) for n in named])
    rows = _starts(rows).drop("total").join(_stretches(own), ["file", "stretch"])
    near = Window.partitionBy("file", "stretch")
    later = F.coalesce(F.min("starts").over(near.orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, -1)), F.col("later"))
    rows = rows.withColumn("block", F.coalesce(F.max("starts").over(near.orderBy("row")), F.col("earlier"))).withColumn("later", later)
    # the start after a row is the one after its block's own row too
    rows = rows.withColumn("block_end", F.when(F.col("block").isNotNull(), F.greatest(F.col("block"), F.least(F.coalesce("later", "boundary"), F.col("boundary")) - 1)))
    return rows.withColumn("block", F.when(F.col("row") <= F.col("block_end"), F.col("block"))).drop("stretch", "earlier", "later")


def contracts(cells: DataFrame, year: int) -> DataFrame:
    """A row for each contract of workbooks of contracts: amount, what it pays for, whose, when, and why it is limited.

    ``eligible``: a number that was paid for collection or transport. Sums in
    total rows, headers that are repeated and rows after the total row's own
    contracts make no contracts. Workbooks of other layouts give no rows.
    """
    rows = _blocks(cells, layouts(cells, year))
    month = F.regexp_extract(tidy(F.col("ledger.value")), rf"^{year}[-.]([0-9]{{1,2}})$", 1)
    paid = rows.where("block IS NOT NULL").groupBy("file", "block").agg(F.array_compact(F.collect_set(F.when(month != "", month.cast("int")))).alias("months"))
    rows = rows.where("starts IS NOT NULL").join(paid, ["file", "block"], "left")
    # columns that many others are made of are made once
    rows = rows.withColumns({"name": tidy(F.col("contract.value")), "note_text": tidy(F.col("note.value")), "label": tidy(F.col("year.value")), "amount": _amount(F.col("payment.kind"), F.col("payment.value"))})
    rows = rows.withColumns({
        "dates": labels.dates(F.col("label"), F.lit(year)), "basis": terms.accounting_basis(F.col("name")), "kind": terms.payment_type(F.col("note_text")), "area": terms.geographic_scope(F.col("name")),
    })
    name, note, label, amount, basis, kind, area = (F.col(c) for c in ("name", "note_text", "label", "amount", "basis", "kind", "area"))
    # the bare year, of this delivery, is no part of a year
    part = F.col("dates.part") & (label != str(year))
    missing = (F.size("months") > 0) & (F.size("months") < 12)
    limits = F.array_compact(F.array(F.when(part, "PARTIAL_PERIOD_COVERAGE"), F.when(area == "SUB_MUNICIPAL", "PARTIAL_GEOGRAPHIC_SCOPE"), F.when(missing, "PAYMENT_PERIOD_COVERAGE_INCOMPLETE")))
    eligible = basis.isin(terms.ELIGIBLE_BASES)
    return rows.select(
        "file", "row", F.col("block_end").alias("row_end"), F.substring(name, 1, NAME_LENGTH).alias("contract_name"), labels.contractor(name, note).alias("contractor"),
        F.nullif(label, F.lit("")).alias("period_label"), F.col("dates.start").alias("period_start"), F.col("dates.end").alias("period_end"), "amount",
        F.when(F.col("payment.kind") == "text", F.nullif(tidy(F.col("payment.value")), F.lit(""))).alias("payment_text"), kind.alias("payment_type"), basis.alias("accounting_basis"),
        (amount.isNotNull() & (kind == "ACTUAL_PAID_AMOUNT") & eligible).alias("eligible"), terms.waste_scope(name).alias("waste_scope"), area.alias("geographic_scope"),
        labels.list_cell(F.col("facility.value")).alias("destinations"), labels.list_cell(F.col("method.value")).alias("methods"),
        F.when(amount.isNull(), "UNUSABLE").when(F.size(limits) > 0, "PARTIAL").otherwise("COMPLETE").alias("completeness"),
        F.concat(limits, F.when(~eligible, F.array(F.lit("NON_COLLECTION_TRANSPORT_BASIS"))).otherwise(F.array().cast("array<string>"))).alias("limitations"),
        F.nullif(tidy(F.col("organisation.value")), F.lit("")).alias("organisation"), F.nullif(note, F.lit("")).alias("note"),
    )


def quantities(cells: DataFrame, year: int) -> DataFrame:
    """A row for each pair of label and value in a contract's block.

    Blocks of one workbook that are equal, and have a number, are one series of
    the municipality: the first stays, with all the rows that it stands on and
    without a contract. Other blocks belong to their contract.
    """
    found = layouts(cells, year)
    rows = _blocks(cells, found)
    own = cells.where("row > 1").join(_sent(found.where("role <> 'B' AND fits").select("file", "payment_col", "facility_col")), "file").where("col > payment_col AND col < facility_col")
    place = F.col("col") - F.col("payment_col") - 1
    side = lambda n: F.max(F.when(place % 2 == n, F.struct("kind", "value")))
    pairs = own.groupBy("file", "row", F.floor(place / 2).cast("int").alias("pair"), "payment_col").agg(side(0).alias("named"), side(1).alias("cell"))
    pairs = pairs.join(rows.where("block IS NOT NULL").select("file", "row", "block"), ["file", "row"]).withColumn("l", tidy(F.col("named.value")))
    number_in = F.coalesce(F.col("cell.kind") == "number", F.lit(False))
    blocks = pairs.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("row", "pair", "l", "cell", "payment_col"))).alias("written"), F.bool_or(number_in).alias("measured"))
    text = F.to_json(F.transform("written", lambda w: F.struct(w.l, F.coalesce(w.cell.kind, F.lit("")), F.coalesce(w.cell.value, F.lit("")))))
    # equal blocks meet by the hash of their text, blocks without a number nowhere
    blocks = blocks.withColumn("mark", F.when(F.col("measured"), F.sha2(text, 256)).otherwise(F.col("block").cast("string")))
    series = blocks.groupBy("file", "mark").agg(F.min(F.struct("block", "written")).alias("first"), F.array_sort(F.collect_list("block")).alias("at"))
    series = series.select("file", F.col("first.block").alias("block"), "at", (F.size("at") > 1).alias("repeated"), F.explode("first.written").alias("w")).select("*", "w.*")
    scope = _contract_rows(_bodies(cells, found)).where("starts IS NOT NULL").select("file", F.col("row").alias("block"), terms.waste_scope(F.col("contract.value")).alias("scope"))
    # columns that many others are made of are made once
    out = series.join(scope, ["file", "block"]).withColumnRenamed("l", "label")
    label = F.col("label")
    out = out.withColumns({"read": terms.cell_read(F.col("cell.kind"), F.col("cell.value"), label), "period": labels.period_of(label, F.lit(year))})
    number, state, month, period = (F.col(c) for c in ("read.number", "read.state", "period.month", "period.kind"))
    cut = F.regexp_extract(label, "^(.*):[^:]*$", 1)
    return out.select(
        "file", "row", (F.col("payment_col") + 2 + F.col("pair") * 2).alias("col"), F.substring(label, 1, LABEL_LENGTH).alias("label"),
        F.when(F.col("repeated"), F.transform("at", lambda b: F.col("row") + b - F.col("block"))).otherwise(F.array("row")).alias("at_rows"),
        F.when(~F.col("repeated"), F.col("block")).alias("contract_row"), month.alias("month"), period.alias("period"), terms.waste_category(label, F.col("scope")).alias("category"),
        F.nullif(F.when(label.contains(":"), F.trim(cut)).otherwise(label), F.lit("")).alias("destination"), number.alias("quantity"), state.alias("value_state"),
        F.when(F.col("repeated"), "MUNICIPAL_TOTAL_REPEATED_PER_CONTRACT").otherwise("PER_CONTRACT").alias("attribution"),
        F.coalesce(F.substring(month, 1, 4) != str(year), F.lit(False)).alias("mixed_years"),
    )


def grid_quantities(cells: DataFrame, year: int, found: DataFrame | None = None) -> DataFrame:
    """The months and the total of each category of monthly grids: file, row, category, month (null: the total), quantity, state and limitation.

    A total of zero over nothing but dashes is no data, not a measure.
    """
    found = (layouts(cells, year) if found is None else found).where("role = 'B' AND fits")
    own = staged(cells.where("row > 1").join(_sent(found.select("file", "category_col", "month_cols", "total_col")), "file"))
    names = own.where("col = category_col").withColumn("t", tidy(F.col("value"))).where(F.col("t").isin(*GRID_ROWS))
    asked = names.select("file", "row", F.col("t").alias("category"), F.posexplode(F.concat("month_cols", F.array("total_col"))).alias("at", "col"))
    filled = asked.join(own.select("file", "row", "col", "kind", "value"), ["file", "row", "col"], "left")
    number, state = terms.cell_value(F.col("kind"), F.col("value"), F.lit(""))
    filled = filled.select("file", "row", "category", "at", number.alias("quantity"), state.alias("value_state"))
    months = Window.partitionBy("file", "row")
    is_month = F.col("at") < 12
    filled = filled.withColumn("sum", F.sum(F.when(is_month, F.col("quantity"))).over(months)).withColumn("dashes", F.count_if(is_month & (F.col("value_state") == "SOURCE_DASH_NO_DATA")).over(months))
    empty = ~is_month & (F.col("quantity") == 0) & (F.col("dashes") == 12)
    unequal = ~is_month & (F.col("quantity") != F.col("sum"))
    kinds = F.create_map(*[F.lit(x) for pair in GRID_ROWS.items() for x in pair])
    return filled.select(
        "file", "row", kinds[F.col("category")].alias("category"), F.when(is_month, F.concat(F.lit(f"{year}-"), F.lpad((F.col("at") + 1).cast("string"), 2, "0"))).alias("month"),
        F.when(~empty, F.col("quantity")).alias("quantity"), F.when(empty, "SOURCE_DASH_NO_DATA").otherwise(F.col("value_state")).alias("value_state"),
        F.when(empty, "ZERO_TOTAL_QUANTITY").when(unequal, "INCONSISTENT_TOTAL").alias("limitation"),
    )


def _sums(cells: DataFrame, found: DataFrame) -> DataFrame:
    """file and what its status takes of its contracts, from one pass over the cells: nothing of them depends on where a block ends.

    ``first`` and ``end`` are the rows of the first contract and of the first
    total; ``begun`` says whether a row that begins a contract has a quantity.
    """
    own = cells.where("row > 1").join(_sent(found.where("role <> 'B' AND fits").select("file", "contract_col", "payment_col", "note_col", "facility_col")), "file")
    named = ["contract", "payment", "note"]
    own = own.where(F.col("col").isin(*[F.col(f"{n}_col") for n in named]) | _valued())
    rows = own.groupBy("file", "row").agg(*[F.max(F.when(F.col("col") == F.col(f"{n}_col"), F.struct("kind", "value"))).alias(n) for n in named], F.bool_or(_valued()).alias("valued"))
    rows = _starts(rows.where("contract IS NOT NULL"))
    rows = rows.withColumns({"name": tidy(F.col("contract.value")), "amount": _amount(F.col("payment.kind"), F.col("payment.value")), "starting": F.col("starts").isNotNull()})
    rows = rows.withColumns({"basis": terms.accounting_basis(F.col("name")), "kind": terms.payment_type(F.col("note.value")), "scope": terms.waste_scope(F.col("name"))})
    starting, eligible = F.col("starting"), F.col("basis").isin(terms.ELIGIBLE_BASES)
    total = F.struct("row", "amount")
    sums = rows.groupBy("file").agg(
        F.count_if(starting).alias("contracts"), F.sum(F.when(starting, F.col("amount"))).alias("recomputed"), F.sum(F.when(starting & eligible & (F.col("kind") == "ACTUAL_PAID_AMOUNT"), F.col("amount"))).alias("eligible_sum"),
        F.collect_set(F.when(starting & eligible, F.col("scope"))).alias("scopes"), F.bool_or(starting & ~eligible).alias("other_basis"),
        F.min("starts").alias("first"), F.min(F.when(F.col("total"), total)).alias("total"), F.bool_or(starting & F.col("valued")).alias("begun"),
    )
    return staged(sums.select("*", F.col("total.row").alias("end"), F.col("total.amount").alias("stated")).drop("total"))


def _valued() -> Column:
    """Whether a cell has the quantity of a pair."""
    pair = (F.col("col") > F.col("payment_col")) & (F.col("col") < F.col("facility_col")) & ((F.col("col") - F.col("payment_col")) % 2 == 0)
    return pair & terms.quantity(F.col("kind"), F.col("value")).isNotNull()


def file_status(cells: DataFrame, year: int) -> DataFrame:
    """file, layout, sums of the source and of its contracts, whether they agree, whether all streams are covered, and what the file is good for.

    A place has one cell. Contracts, blocks and pairs aren't made for it: sums
    need the rows on which contracts begin, and a quantity is in a block if it
    is there, or after the first of them and before the first total.
    """
    found = layouts(cells, year)
    own = _sums(cells, found)
    spans = found.where("role <> 'B' AND fits").select("file", "payment_col", "facility_col").join(own.select("file", "first", "end"), "file")
    inside = (F.col("row") >= F.col("first")) & F.coalesce(F.col("row") < F.col("end"), F.lit(True))
    between = cells.where("row > 1").join(_sent(staged(spans)), "file").where(inside & _valued()).select("file", F.lit(True).alias("measured"))
    grids = grid_quantities(cells, year, found).select("file", F.col("quantity").isNotNull().alias("measured"))
    measured = between.union(own.select("file", "begun")).union(grids).groupBy("file").agg(F.bool_or("measured").alias("measured"))
    out = found.select("file", "role", "layout").join(own, "file", "left").join(measured, "file", "left")
    partial = (F.size("scopes") > 0) & ~terms.covers_every_stream(F.col("scopes"))
    paid, any_quantity = F.col("recomputed").isNotNull(), F.coalesce("measured", F.lit(False))
    use = (
        F.when(F.col("layout") == "UNSUPPORTED_LAYOUT", "UNSUPPORTED_LAYOUT")
        .when(F.col("role") == "B", F.when(any_quantity, "DATA_B_QUANTITY_VALIDATION").otherwise("EMPTY_OR_NO_DATA"))
        .when(paid & partial, "DATA_A_PARTIAL_WASTE_SCOPE")
        .when(paid & any_quantity, "DATA_A_PAYMENT_AND_QUANTITY")
        .when(paid, "DATA_A_PAYMENT_ONLY")
        .when(any_quantity, "DATA_A_QUANTITY_ONLY")
        .otherwise("EMPTY_OR_NO_DATA")
    )
    reasons = F.array_compact(F.array(F.when(F.col("layout") == "UNSUPPORTED_LAYOUT", "UNSUPPORTED_SOURCE_LAYOUT"), F.when(F.col("stated") != F.col("recomputed"), "INCONSISTENT_TOTAL"), F.when(F.col("other_basis"), "NON_COLLECTION_TRANSPORT_BASIS"), F.when(partial, "PARTIAL_WASTE_SCOPE")))
    return out.select("file", "layout", F.coalesce("contracts", F.lit(0)).alias("contracts"), "stated", "recomputed", "eligible_sum", use.alias("classification"), F.array_join(reasons, ",").alias("reasons"))
