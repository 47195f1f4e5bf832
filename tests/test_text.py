from __future__ import annotations

import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from skein.functions import text as tx


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""), ("", ""), ("  a \n\n\n b\t c  ", "a b c"), ("a\x00b\x07c\x7fd\x9fe", "abcde"), ("see https://x.org/path?q=1 now", "see /path?q=1 now"), ("ﬁn１２ n", "fin12 n"),
        ("mail a@b.org", "mail a@b.org"), ("tab em", "tab em"),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, tx.clean) == want


def test_clean_options(spark):
    assert one(spark, "Mail a.b@c.org Now", lambda c: tx.clean(c, tx.CleaningConfig(remove_emails=True, lowercase=True))) == "mail now"
    assert one(spark, "a  b\n\n\n\nc", lambda c: tx.clean(c, tx.CleaningConfig(preserve_newlines=True))) == "a b\n\nc"
    assert one(spark, "wait...... what -- ok", tx.clean_for_embedding) == "wait. what - ok"


def test_nfkc_equals_python(spark):
    rows = ["plain", "ﬀ ① ½ Å", "é", "日本語", "한글", None, ""]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").select("i", tx.nfkc(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [r and unicodedata.normalize("NFKC", r) if r else r for r in rows]


@pytest.mark.parametrize(("raw", "want"), [(None, ""), (" N/A ", ""), ("-", ""), ("--", "--"), (" 1,000 ", "1,000"), ("None", "")])
def test_table_cell(spark, raw, want):
    assert one(spark, raw, tx.clean_table_cell) == want


def test_financial_values(spark):
    v = one(spark, "$1,200.50 and 3.5% of 20 EUR", tx.financial_values)
    assert (v.currencies, v.percentages, v.numbers) == (["$1,200.50", "20 EUR"], ["3.5%"], ["1,200.50", "3.5", "20"])


def test_helpers(spark):
    assert one(spark, "abcdefghij", lambda c: tx.truncate(c, 8)) == "abcde..."
    assert one(spark, "abc", lambda c: tx.truncate(c, 8)) == "abc"
    assert one(spark, "-1,234.5 then 7 and , end", tx.numbers_in) == [-1234.5, 7.0]
    assert [one(spark, v, tx.file_size, "double") for v in (0.0, 1023.0, 1024.0, 5.5 * 1024**2, 1024.0**5 * 3)] == ["0.00 B", "1023.00 B", "1.00 KB", "5.50 MB", "3.00 PB"]
    assert [one(spark, v, lambda c: tx.currency(c, F.lit("EUR")), "double") for v in (12.5, 1500.0, 2.5e6, 3e9, 4e12, -2e6)] == ["€12.50", "€1.50K", "€2.50M", "€3.00B", "€4.00T", "€-2.00M"]
    assert one(spark, 5.0, lambda c: tx.currency(c, F.lit("XYZ")), "double") == "XYZ5.00"
    assert one(spark, 0.1234, tx.percentage, "double") == "12.34%"
    assert one(spark, [1, 2, 3, 4, 5], lambda c: tx.batches(c, 2), "array<int>") == [[1, 2], [3, 4], [5]]
    assert one(spark, [], lambda c: tx.batches(c, 2), "array<int>") == []


@pytest.mark.parametrize(("raw", "want"), [("2024-02-29", (2024, 2, 29)), ("03/04/2023", (2023, 3, 4)), ("25/12/2022", (2022, 12, 25)), ("March 5, 2021", (2021, 3, 5)), ("Mar 5, 2021", (2021, 3, 5)), ("1999", (1999, 1, 1)), ("Q3 2020", (2020, 1, 1)), ("soon", None), ("2023-02-30", (2023, 1, 1))])
def test_parse_date(spark, raw, want):
    assert one(spark, raw, tx.parse_date) == (want and datetime.date(*want))


def test_validation(spark):
    assert [one(spark, q, tx.valid_query).ok for q in ("abc", "ab", "<script>", "x onclick = y", "y" * 2001)] == [True, False, False, False, False]
    assert one(spark, ' <a href="x">\x01 & \n b ', tx.sanitized) == "&lt;a href=&quot;x&quot;&gt; &amp; b"


def test_file_size_with_a_largest_unit(spark):
    show = lambda v, *largest: one(spark, v, lambda c: tx.file_size(c, *largest), "double")
    assert [show(v, "GB") for v in (1023.0, 1024.0**3, 1024.0**4, 5 * 1024.0**5)] == ["1023.00 B", "1.00 GB", "1024.00 GB", "5242880.00 GB"]
    assert [show(v) for v in (1024.0**4, 5 * 1024.0**5, 0.125, None)] == ["1.00 TB", "5.00 PB", "0.12 B", None]


def test_fixed_prints_as_python_does(spark):
    values = [0.0, -0.001, 0.125, 0.375, 1.005, 2.675, 999.995, -2.5, 0.5, 1.5, 123456789.125, 2.0**48 + 0.1875, 2.0**47 + 0.5, 2.0**53 + 2, -(2.0**50) - 0.75, 9e18]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for decimals in (0, 1, 2, 4):
        assert [r.y for r in df.select(tx.fixed(F.col("x"), decimals).alias("y")).collect()] == [f"{v:.{decimals}f}" for v in values]
    assert one(spark, 1.005e9, lambda c: tx.currency(c, F.lit("USD")), "double") == "$1.00B"
    assert one(spark, 4e12, lambda c: tx.currency(c, F.lit("USD"), tx.SCALES[1:]), "double") == "$4000.00B"
    assert one(spark, 0.00125, lambda c: tx.percentage(c, 2), "double") == "0.12%"
