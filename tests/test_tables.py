from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.operators import tables as tb


def frame(spark, *tables):
    return spark.createDataFrame([(f"t{i}", h, r, c, i) for i, (h, r, c) in enumerate(tables)], tb.TABLE)


COMPANY = (["Company", "Revenue", "Profit"], [["A", "1000000", "100000"], ["B", "2500000", "350000"], ["C", "1800000", "220000"]], "Sheet1")


def test_normalize(spark):
    df = frame(spark, ([" * Name ", "Total  Sum #"], [["x", " N/A "], ["y"], ["z", "1", "2"]], None), (["1", "2"], [["Date", "Revenue"], ["2020", "5"]], None), (["", None], [["a", "b"]], None), (["5", "6"], [["7", "8"]], None))
    got = {r.table_id: (r.headers, r["rows"]) for r in tb.normalized(df).collect()}
    assert got["t0"] == (["Name", "Total Sum"], [["x", ""], ["y", ""], ["z", "1"]])
    assert got["t1"] == (["Date", "Revenue"], [["2020", "5"]])
    assert got["t2"] == (["Column_1", "Column_2"], [["a", "b"]])
    assert got["t3"] == (["5", "6"], [["7", "8"]])
    off = {r.table_id: r.headers for r in tb.normalized(df, detect_header=False).collect()}
    assert off["t1"] == ["1", "2"]


def test_validity(spark):
    df = frame(spark, COMPANY, (["a", "b"], [["1", "2"]], None), (["a"], [["1"], ["2"]], None), (["a", "b"], [["", None], ["", " "]], None), ([], [["1", "2"], ["3", "4"]], None), (["a", "b"], [], None))
    assert [r.ok for r in df.orderBy("table_id").select(tb.is_valid(F.col("headers"), F.col("rows")).alias("ok")).collect()] == [True, False, False, False, True, False]


def test_profiles_of_the_company_table(spark):
    got = {r.header: r for r in tb.profiles(tb.cells(frame(spark, COMPANY))).collect()}
    assert got["Company"].type == "text" and got["Company"].sum is None
    assert (got["Revenue"].sum, round(got["Revenue"]["mean"], 2), got["Revenue"].min, got["Revenue"].max) == (5300000.0, 1766666.67, 1000000.0, 2500000.0)
    assert got["Profit"].sum == 670000.0


def test_numbers_as_pandas_reads_them(spark):
    rows = [[v] for v in ("1,000", "$5", "1d", "2f", "3", " 4 ", "", "1e2", ".5", "-6.", "x")]
    got = {r.value: r.x for r in tb.cells(frame(spark, (["n"], rows, None))).select("value", tb.to_plain_number(F.col("value")).alias("x")).collect()}
    assert got == {"1,000": None, "$5": None, "1d": None, "2f": None, "3": 3.0, " 4 ": 4.0, "": None, "1e2": 100.0, ".5": 0.5, "-6.": -6.0, "x": None}


def test_column_types(spark):
    cols = {"cur": ["$1", "€2", "x"], "pct": ["5%", "6 %", "7"], "num": ["1", "2,000", "(3)", "4M"], "date": ["1/2/2020", "Q1 2020", "x"], "txt": ["a", "b", "1"], "none": ["", None, ""]}
    rows = [[(v[i] if i < len(v) else "") for v in cols.values()] for i in range(4)]
    got = {r.header: r.type for r in tb.column_types(tb.cells(frame(spark, (list(cols), rows, None)))).collect()}
    assert got == {"cur": "currency", "pct": "percentage", "num": "numeric", "date": "date", "txt": "text", "none": "empty"}


def test_duplicate_headers_stay_apart(spark):
    got = sorted((r.col_idx, r.sum) for r in tb.profiles(tb.cells(frame(spark, (["v", "v"], [["1", "10"], ["2", "20"]], None)))).collect())
    assert got == [(0, 3.0), (1, 30.0)]


def test_markdown_and_row_text(spark):
    df = frame(spark, (["a", None], [["1", None, "x"], ["2"]], None), ([], [["1"]], None), (["a"], [], None)).select("table_id", tb.markdown(F.col("headers"), F.col("rows")).alias("md"), "headers", "rows")
    got = {r.table_id: r.md for r in df.collect()}
    assert got == {"t0": "| a |  |\n| --- | --- |\n| 1 |  |\n| 2 |  |\n", "t1": "", "t2": ""}
    row = frame(spark, (["a", "b", "c"], [["1", " ", "3"]], None)).select(tb.row_text(F.col("headers"), F.col("rows")[0], F.lit(7)).alias("x")).first().x
    assert row == "Row 7:\n  a: 1\n  c: 3"


def test_chunks_of_a_table(spark):
    big = (["Item", "Value"], [[f"i{n}", str(n)] for n in range(120)], None)
    got = tb.table_chunks(frame(spark, COMPANY, big, (["x"], [["1"]], None))).collect()
    parts = lambda t: sorted((r.part, r.seq) for r in got if r.table_id == t and r.part != "row")
    assert parts("t0") == [("full_data", 0), ("metrics", 0), ("schema", 0), ("summary", 0)]
    assert parts("t1") == [("partial_data", 0), ("partial_data", 50), ("partial_data", 100), ("schema", 0), ("summary", 0)]
    assert sum(r.part == "row" for r in got) == 123 and not any(r.table_id == "t2" for r in got)
    of = {r.part: r.content for r in got if r.table_id == "t0"}
    assert of["schema"] == "Table: Sheet1\nDimensions: 3 rows × 3 columns\n\nColumns:\n  - Company (text)\n  - Revenue (numeric)\n  - Profit (numeric)"
    assert "Summary Statistics for Sheet1:\n\nRevenue:\n  - Sum: 5,300,000.00\n  - Average: 1,766,666.67\n  - Min: 1,000,000.00" in of["summary"]
    assert "Revenue:\n  Total: 5,300,000.00" in of["metrics"]


def test_key_metrics_by_row_label(spark):
    got = tb.key_metrics(tb.cells(frame(spark, (["Line", "2020", "2021"], [["Net sales", "5", "6"], ["other", "1", "2"], ["Gross profit", None, "3"]], None)))).collect()
    assert sorted((r.metric, r.keyword, [(v.header, v.value) for v in r["values"]]) for r in got) == [("Gross profit", "gross", [("2021", "3")]), ("Net sales", "net", [("2020", "5"), ("2021", "6")])]


def test_live_chunks(spark):
    big = (["h", "v"], [[f"name {n}", None if n == 3 else str(n)] for n in range(120)], None)
    got = tb.live_chunks(frame(spark, COMPANY, big)).collect()
    assert sorted(r.part for r in got if r.table_id == "t0") == ["full_table", "schema"]
    assert next(r.content for r in got if r.table_id == "t0" and r.part == "schema") == "Sheet/Table: Sheet1\nTable Columns: Company, Revenue, Profit"
    assert next(r.content for r in got if r.table_id == "t1" and r.part == "row" and r.seq == 3) == "h: name 3 | v: None"


def test_compare(spark):
    a, b = frame(spark, (["x", "y", "z", "s"], [["1", "0", "0", "a"], ["2", "0", "0", "b"]], None)), frame(spark, (["x", "y", "z", "s", "w"], [["6", "5", "0", "c", "1"]], None))
    got = {r.header: (r.table1_sum, r.table2_sum, r.change, r.change_percent) for r in tb.compare_tables(a, b).collect()}
    assert got == {"x": (3.0, 6.0, 3.0, 100.0), "y": (0.0, 5.0, 5.0, float("inf")), "z": (0.0, 0.0, 0.0, 0.0)}


def test_numeric_summary(spark):
    got = {r.column: r for r in tb.numeric_summary(spark.createDataFrame([(1, 2.5, "a", None), (3, None, "b", None)], "i int, d double, s string, n double")).collect()}
    assert set(got) == {"i", "d", "n"} and got["i"].sum == 4.0 and got["d"]["mean"] == 2.5 and got["n"].sum == 0.0 and got["n"]["mean"] is None
    assert tb.numeric_summary(spark.createDataFrame([("a",)], "s string")).count() == 0


@pytest.mark.parametrize("bad", [None])
def test_empty_frame(spark, bad):
    assert tb.table_chunks(frame(spark, COMPANY).limit(0)).count() == 0


def test_no_piece_of_a_table_carries_all_its_rows(spark):
    """A copy of the rows beside each batch of 50 grows with the square of a table's length."""
    chunks = tb.table_chunks(frame(spark, COMPANY))
    carried = _carried(chunks._jdf.queryExecution().optimizedPlan())
    assert carried and not any("array<array<string>>" in kind for kinds in carried for kind in kinds)


def _carried(plan):
    """Of each Generate the types of the child's columns that go beside what it makes."""
    found = []
    if plan.nodeName() == "Generate":
        child, unneeded = plan.child().output(), plan.unrequiredChildIndex()
        gone = {unneeded.apply(i) for i in range(unneeded.size())}
        found.append([child.apply(i).dataType().simpleString() for i in range(child.size()) if i not in gone])
    for i in range(plan.children().size()):
        found += _carried(plan.children().apply(i))
    return found


def test_chunks_of_a_table_whose_first_row_is_the_header(spark):
    rows = [["Date", "Revenue"], *[[f"day {n}", f" {n} "] for n in range(55)], ["short"], ["long", "-", "x"]]
    got = tb.table_chunks(frame(spark, (["1", "2"], rows, None))).collect()
    of = {(r.part, r.seq): r.content for r in got}
    assert {k for k in of if k[0] != "row"} == {("schema", 0), ("summary", 0), ("metrics", 0), ("partial_data", 0), ("partial_data", 50)}
    assert sorted(seq for part, seq in of if part == "row") == list(range(57))
    assert of["row", 0] == "Row 1:\n  Date: day 0\n  Revenue: 0" and of["row", 56] == "Row 57:\n  Date: long"
    assert of["partial_data", 50].splitlines() == ["| Date | Revenue |", "| --- | --- |", *[f"| day {n} | {n} |" for n in range(50, 55)], "| short |  |", "| long |  |"]
    assert of["schema", 0].startswith("Table 1\nDimensions: 57 rows × 2 columns")
