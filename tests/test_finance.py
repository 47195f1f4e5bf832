from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from skein.functions import finance as fi


def found(spark, text, expr):
    return spark.createDataFrame([(text,)], "x string").select(F.inline(expr(F.col("x")))).collect()


def test_currencies(spark):
    got = [(r.entity_type, r.value, r.normalized_number) for r in found(spark, "Sold for $1.5 million, 20 dollars, €30.25, £7 or 9 GBP, ₹5 and Rs. 12; US$5.", fi.currencies)]
    assert ("currency_USD", "$1.5 million", 1_500_000.0) in got and ("currency_USD", "20 dollars", 20.0) in got and ("currency_EUR", "€30.25", 30.25) in got
    assert ("currency_GBP", "£7", 7.0) in got and ("currency_GBP", "9 GBP", 9e9) in got  # as "b" is in it
    assert ("currency_INR", "₹5", 5.0) in got and ("currency_INR", "Rs. 12", 12.0) in got
    assert sum(v.endswith("$5") for _, v, _ in got) == 2  # patterns overlap
    assert [n for _, v, n in [(r.entity_type, r.value, r.normalized_number) for r in found(spark, "$5 to", fi.currencies)]] == [5e12]


def test_percentages_and_their_kinds(spark):
    far = " " * 60
    got = found(spark, f"growth of 5%{far}.{far}margin 7.5 %{far}.{far}a rate of -3%{far}.{far}market 1,000%{far}.{far}8%", fi.percentages)
    assert [(r.entity_type, r.normalized_number) for r in got] == [("percentage_growth", 5.0), ("percentage_margin", 7.5), ("percentage_rate", -3.0), ("percentage_share", 1000.0), ("percentage_other", 8.0)]


def test_dates(spark):
    text = "On 03/04/2023 and 2023-04-05, Jan 5, 2024, 6 february 2022, Q3 2023 and FY 2021"
    got = {r.value: r.normalized_ts for r in found(spark, text, fi.dates)}
    assert got == {"03/04/2023": None, "2023-04-05": None, "Jan 5, 2024": datetime.datetime(2024, 1, 5), "6 february 2022": datetime.datetime(2022, 2, 6), "Q3 2023": None, "FY 2021": None}
    fixed = {r.value: r.normalized_ts for r in found(spark, text, lambda c: fi.dates(c, fix_dates=True))}
    assert fixed["03/04/2023"] == datetime.datetime(2023, 3, 4) and fixed["2023-04-05"] == datetime.datetime(2023, 4, 5)


def test_metrics_and_contexts(spark):
    got = found(spark, "x" * 60 + " Gross margin was 12.5% while sales fell", fi.metrics)
    assert [(r.entity_type, r.value, r.normalized_number) for r in got] == [("metric_revenue", "sales", None), ("metric_margin", "margin", 12.5), ("metric_margin", "Gross margin", 12.5)]
    assert got[0].context.startswith("...") and not got[0].context.endswith("...")


def test_order_flags_and_empty(spark):
    text = "Revenue $5 grew 3% by Q1 2020"
    assert [r.confidence for r in found(spark, text, fi.entities)] == [0.9, 0.95, 0.85, 0.8]
    assert [r.confidence for r in found(spark, text, lambda c: fi.entities(c, currency=False, metric=False))] == [0.95, 0.85]
    assert found(spark, None, fi.entities) == [] and found(spark, "", fi.entities) == []


@pytest.mark.parametrize(("raw", "want"), [("1,234.5", 1234.5), ("(5)", -5.0), (",", None), ("", None)])
def test_numbers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(fi.to_number(F.col("x")).alias("y")).first().y == want


def test_many_matches_in_one_text_take_linear_time(spark):
    import time

    began = time.monotonic()
    assert len(found(spark, "growth of 5% and $3 million in Q1 2020; " * 8000, fi.entities)) == 8000 * 4
    assert time.monotonic() - began < 15


def test_contexts_equal_the_plain_rule(spark):
    text = "\u3000 " + "a" * 70 + " 5% " + "b" * 48 + "  c"
    (r,) = found(spark, text, fi.percentages)
    start, end = text.index("5%"), text.index("5%") + 2
    assert r.context == "..." + text[start - 50 : end + 50].strip() + "..."
    assert found(spark, " 5% ", fi.percentages)[0].context == "5%"
