"""Text cleaning and small scalar helpers, as Column expressions.

Everything but Unicode normalisation stays on the JVM.  `(?U)` gives Java's classes their Unicode meaning.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the cleaning rules.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
URL = r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CURRENCY = r"[$€£¥₹][\d,]+(?:\.\d{1,2})?|[\d,]+(?:\.\d{1,2})?\s*(?:USD|EUR|GBP|INR|JPY)"
PERCENTAGE = r"\d+(?:\.\d+)?%"
NUMBER = r"[\d,]+(?:\.\d+)?"
NULL_CELLS = ("nan", "none", "null", "-", "n/a", "na")

WORD = r"(?U)\w+"
BLANKS = r"(?U)\s+"


@dataclass(frozen=True)
class CleaningConfig:
    normalize_unicode: bool = True
    remove_control: bool = True
    remove_urls: bool = True
    remove_emails: bool = False
    collapse_whitespace: bool = True
    lowercase: bool = False
    #: collapse blanks but keep line ends, three or more of them as two
    preserve_newlines: bool = False


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Unicode compatibility form.  Python sees only texts that have other than ASCII characters."""
    return F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column, config: CleaningConfig | None = None) -> Column:
    """Normalise, drop control characters and URLs' hosts, collapse blanks, strip.  Null gives ''."""
    c = config or CleaningConfig()
    out = F.coalesce(text, F.lit(""))
    if c.normalize_unicode:
        out = nfkc(out)
    if c.remove_control:
        out = F.regexp_replace(out, CONTROL, "")
    if c.remove_urls:
        out = F.regexp_replace(out, f"(?U){URL}", "")
    if c.remove_emails:
        out = F.regexp_replace(out, EMAIL, "")
    if c.preserve_newlines:
        out = F.regexp_replace(F.regexp_replace(out, r"(?U)[^\S\n]+", " "), r"\n{3,}", "\n\n")
    elif c.collapse_whitespace:
        out = F.regexp_replace(out, BLANKS, " ")
    if c.lowercase:
        out = F.lower(out)
    return strip(out)


def clean_for_embedding(text: Column, config: CleaningConfig | None = None) -> Column:
    return F.regexp_replace(F.regexp_replace(clean(text, config), r"[.]{2,}", "."), r"[-]{2,}", "-")


def clean_table_cell(cell: Column, config: CleaningConfig | None = None) -> Column:
    s = strip(F.coalesce(cell.cast("string"), F.lit("")))
    return F.when(F.lower(s).isin(*NULL_CELLS), F.lit("")).otherwise(clean(s, config))


def financial_values(text: Column) -> Column:
    """struct(currencies, percentages, numbers): all matches of each pattern, in order."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.struct(every(CURRENCY).alias("currencies"), every(PERCENTAGE).alias("percentages"), every(NUMBER).alias("numbers"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def truncate(text: Column, max_length: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= max_length, text).otherwise(F.concat(F.left(text, F.lit(max_length - len(suffix))), F.lit(suffix)))


def numbers_in(text: Column) -> Column:
    """All numbers of a text as doubles, commas dropped; what does not parse is skipped."""
    found = F.regexp_extract_all(text, F.lit(r"-?[\d,]+\.?\d*"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda v: v.isNotNull())


def fixed(value: Column, decimals: int) -> Column:
    """A double with so many decimals, rounded half to even by its exact binary value, as C and Python print it.

    format_string rounds the shortest decimal that stands for the double instead: 1.005, which is a little less, would give 1.01.
    Of large values, for which that decimal has too few digits, the whole part is printed on its own.
    """
    shown = lambda v: F.call_function("format_number", v, F.lit("0." + "0" * decimals if decimals else "0"))
    whole = (value if decimals else F.rint(value)).try_cast("bigint")
    large = (whole.cast("decimal(19,0)") + shown(value - whole).cast(f"decimal({decimals + 2},{decimals})")).cast("string")
    return F.when(F.abs(value) < 10.0 ** (13 - decimals), shown(value)).when(F.abs(value) < 2.0**63, large).when(value.isNotNull(), F.format_string(f"%.{decimals}f", value))


def file_size(size: Column, largest: str = "PB") -> Column:
    """Bytes with a unit: B to PB or the largest that is wanted, steps of 1024, two decimals."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    last = units.index(largest)
    shown = lambda i: F.concat(fixed(size / F.lit(1024.0**i), 2), F.lit(f" {units[i]}"))
    out = shown(last)
    for i in range(last - 1, -1, -1):
        out = F.when(size / F.lit(1024.0**i) < 1024, shown(i)).otherwise(out)
    return out


#: Signs of currencies.
CURRENCY_SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥"}
SCALES = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))


def currency(value: Column, code: Column, scales: tuple[tuple[float, str], ...] = SCALES) -> Column:
    """An amount with its sign, in T, B, M or K (the scales) with two decimals, or in full."""
    sign = F.coalesce(F.create_map(*[F.lit(x) for kv in CURRENCY_SIGNS.items() for x in kv])[code], code)
    out = F.concat(sign, F.format_number(value, 2))
    for scale, letter in reversed(scales):
        out = F.when(F.abs(value) >= scale, F.concat(sign, fixed(value / scale, 2), F.lit(letter))).otherwise(out)
    return out


def percentage(value: Column, decimals: int = 2) -> Column:
    return F.concat(fixed(value * 100, decimals), F.lit("%"))


#: Notations of dates, in the order they are tried.
DATE_FORMATS = (("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"), ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("MMMM d, yyyy", r"[A-Z][a-z]+ \d{1,2}, \d{4}"), ("MMM d, yyyy", r"[A-Z][a-z]{2} \d{1,2}, \d{4}"), ("yyyy", r"\d{4}"))


def parse_date(text: Column) -> Column:
    """The date of the first notation that fits; else January 1 of the first year from 1900 to 2099; else null."""
    tried = [F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(form)).cast("date")) for form, shape in DATE_FORMATS]
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(*tried, F.when(year != "", F.make_date(year.cast("int"), F.lit(1), F.lit(1))))


def batches(items: Column, size: int) -> Column:
    """An array as an array of arrays of at most size."""
    return F.when(F.size(items) == 0, F.slice(F.array(items), F.lit(1), F.lit(0))).otherwise(F.transform(F.sequence(F.lit(1), F.size(items), F.lit(size)), lambda i: F.slice(items, i, F.lit(size))))


def valid_query(query: Column) -> Column:
    """struct(ok, message): 3 to 2000 characters and no script."""
    n = F.length(strip(query))
    message = F.when(query.isNull() | (n == 0), F.lit("Query is empty")).when(n < 3, F.lit("Query is too short")).when(F.length(query) > 2000, F.lit("Query is too long"))
    message = message.when(query.rlike(r"(?i)<script|javascript:|on\w+\s*="), F.lit("Query has forbidden content"))
    return F.struct(message.isNull().alias("ok"), F.coalesce(message, F.lit("")).alias("message"))


def sanitized(query: Column) -> Column:
    """HTML-escaped, without control characters, blanks collapsed."""
    out = query
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), BLANKS, " "))
