"""Financial entities: amounts, percentages, dates and metric mentions, as arrays of structs.

They are found in Arrow batches: each pattern goes over a text once, and positions, values and contexts come
from its matches, so the work grows with a text's length and not with the square of what it holds.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_CHARS = 50
NUMBER_CHARS = 100

# The patterns, keywords and factors of the extraction rules, in the order of the results.
CURRENCY_PATTERNS = {
    "USD": (r"\$\s*([\d,]+(?:\.\d{1,2})?)\s*(?:million|billion|trillion|M|B|T)?", r"([\d,]+(?:\.\d{1,2})?)\s*(?:USD|dollars?)", r"US\$\s*([\d,]+(?:\.\d{1,2})?)"),
    "EUR": (r"€\s*([\d,]+(?:\.\d{1,2})?)", r"([\d,]+(?:\.\d{1,2})?)\s*(?:EUR|euros?)"),
    "GBP": (r"£\s*([\d,]+(?:\.\d{1,2})?)", r"([\d,]+(?:\.\d{1,2})?)\s*(?:GBP|pounds?)"),
    "INR": (r"₹\s*([\d,]+(?:\.\d{1,2})?)", r"([\d,]+(?:\.\d{1,2})?)\s*(?:INR|rupees?)", r"Rs\.?\s*([\d,]+(?:\.\d{1,2})?)"),
}
#: What a text must hold, in lower case, for the patterns of a currency to match at all.
CURRENCY_NEEDS = {"USD": (("$",), ("usd", "dollar"), ("us$",)), "EUR": (("€",), ("eur",)), "GBP": (("£",), ("gbp", "pound")), "INR": (("₹",), ("inr", "rupee"), ("rs",))}
PERCENTAGE = r"(-?[\d,]+(?:\.\d+)?)\s*%"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE_PATTERNS = (
    (r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", None),
    (r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", None),
    (rf"({MONTHS})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})", "mdy"),
    (rf"(\d{{1,2}})\s+({MONTHS})[a-z]*\.?\s+(\d{{4}})", "dmy"),
    (r"(Q[1-4])\s+(\d{4})", None),
    (r"FY\s*(\d{4})", None),
)
#: The order of day, month and year in the numeric dates; without fix_dates they stay unparsed.
NUMERIC_DATES = {0: "mdy", 1: "ymd"}
METRICS = {
    "revenue": ("revenue", "sales", "turnover", "top line"),
    "profit": ("profit", "earnings", "income", "bottom line"),
    "margin": ("margin", "gross margin", "operating margin", "net margin"),
    "growth": ("growth", "yoy", "year-over-year", "cagr"),
    "ratio": ("ratio", "p/e", "debt-to-equity", "current ratio", "roi", "roe"),
    "expense": ("expense", "cost", "expenditure", "opex", "capex"),
    "asset": ("asset", "total assets", "current assets", "fixed assets"),
    "liability": ("liability", "debt", "obligation", "payable"),
    "equity": ("equity", "shareholder equity", "book value"),
    "cash_flow": ("cash flow", "operating cash", "free cash flow", "fcf"),
}
MULTIPLIERS = {"trillion": 1e12, "t": 1e12, "billion": 1e9, "b": 1e9, "bn": 1e9, "million": 1e6, "m": 1e6, "mn": 1e6, "mm": 1e6, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lac": 1e5, "crore": 1e7, "cr": 1e7}
PERCENTAGE_KINDS = (("growth", ("growth", "increase", "decrease", "change", "yoy")), ("margin", ("margin", "gross", "operating", "net")), ("rate", ("rate", "interest", "discount")), ("share", ("share", "market", "ownership")))
NEAR_NUMBER = r"[\$€£₹]?\s*([\d,]+(?:\.\d+)?)\s*(?:million|billion|M|B)?"

ENTITY = "struct<entity_type:string,value:string,normalized_number:double,normalized_ts:timestamp_ntz,context:string,confidence:double>"
_FIELDS = (("entity_type", pa.string()), ("value", pa.string()), ("normalized_number", pa.float64()), ("normalized_ts", pa.timestamp("us")), ("context", pa.string()), ("confidence", pa.float64()))
#: What Unicode counts as white space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: One text and its lower case to its entities.
Finder = Callable[[str, str], Iterator[tuple]]


def to_number(value: Column) -> Column:
    """Commas and blanks dropped, parentheses negative; null if it does not parse."""
    v = F.regexp_replace(value, "[, ]", "")
    v = F.when(v.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(v, r"^\(|\)$", ""))).otherwise(v)
    return v.try_cast("double")


def _number(value: str) -> float | None:
    """As to_number, of digits, commas and a sign."""
    try:
        return float(value.replace(",", "").replace(" ", ""))
    except ValueError:
        return None


def _factor(value: str) -> float | None:
    low = value.lower()
    return next((factor for word, factor in MULTIPLIERS.items() if word in low), None)


def _context(text: str, start: int, end: int) -> str:
    low, high = max(0, start - CONTEXT_CHARS), min(len(text), end + CONTEXT_CHARS)
    return ("..." if low > 0 else "") + text[low:high].strip(_BLANKS) + ("..." if high < len(text) else "")


@cache
def _pattern(pattern: str, unicode: bool = False) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE if unicode else re.IGNORECASE | re.ASCII)


def _currencies(text: str, low: str) -> Iterator[tuple]:
    for code, patterns in CURRENCY_PATTERNS.items():
        for p, needs in zip(patterns, CURRENCY_NEEDS[code], strict=True):
            if any(n in low for n in needs):
                for m in _pattern(p).finditer(text):
                    number, factor = _number(m[1]), _factor(m[0])
                    yield f"currency_{code}", m[0], number * factor if number and factor else number, None, _context(text, *m.span()), 0.9


def _percentages(text: str, low: str) -> Iterator[tuple]:
    if "%" in text:
        for m in _pattern(PERCENTAGE).finditer(text):
            near = _context(text, *m.span())
            words = near.lower()
            kind = next((k for k, marks in PERCENTAGE_KINDS if any(w in words for w in marks)), "other")
            yield f"percentage_{kind}", m[0], _number(m[1]), None, near, 0.95


def _date(m: re.Match, order: str) -> datetime.datetime | None:
    part = dict(zip(order, m.groups(), strict=True))
    month = part["m"] if part["m"].isdigit() else MONTHS.lower().split("|").index(part["m"].lower()) + 1
    try:
        return datetime.datetime(int(part["y"]), int(month), int(part["d"]))
    except ValueError:
        return None


def _dates(text: str, low: str, fix_dates: bool) -> Iterator[tuple]:
    for i, (p, order) in enumerate(DATE_PATTERNS):
        order = order or (NUMERIC_DATES.get(i) if fix_dates else None)
        for m in _pattern(p).finditer(text):
            yield "date", m[0], None, _date(m, order) if order else None, _context(text, *m.span()), 0.85


def _metrics(text: str, low: str) -> Iterator[tuple]:
    for kind, words in METRICS.items():
        for word in words:
            if word in low:
                for m in _pattern(rf"\b{re.escape(word)}\b", unicode=True).finditer(text):
                    near = _pattern(NEAR_NUMBER).search(text[m.end() : m.end() + NUMBER_CHARS])
                    yield f"metric_{kind}", m[0], _number(near[1]) if near else None, None, _context(text, *m.span()), 0.8


def _found(text: Column, finders: list[Finder]) -> Column:
    """All that the finders give for each text, in their order; a null text has nothing."""

    def find(texts: pa.Array) -> pa.Array:
        offsets, rows = [0], []
        for t in texts.to_pylist():
            if t:
                low = t.lower()
                for f in finders:
                    rows.extend(f(t, low))
            offsets.append(len(rows))
        fields = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=[n for n, _ in _FIELDS]))

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, f"array<{ENTITY}>")(text)


def currencies(text: Column) -> Column:
    return _found(text, [_currencies])


def percentages(text: Column) -> Column:
    return _found(text, [_percentages])


def dates(text: Column, fix_dates: bool = False) -> Column:
    """Dates and fiscal periods; of numeric dates only the text is known unless fix_dates."""
    return _found(text, [partial(_dates, fix_dates=fix_dates)])


def metrics(text: Column) -> Column:
    return _found(text, [_metrics])


def entities(text: Column, currency: bool = True, percentage: bool = True, date: bool = True, metric: bool = True, fix_dates: bool = False) -> Column:
    """All entities: amounts, percentages, dates, metrics, in this order."""
    parts = ((currency, _currencies), (percentage, _percentages), (date, partial(_dates, fix_dates=fix_dates)), (metric, _metrics))
    return _found(text, [f for on, f in parts if on])
