"""Tables inside documents: normalised, profiled, compared, and written out as chunks.

A table is a row (table_id, headers array<string>, rows array<array<string>>, caption, table_index); for
profiles it is exploded to cells keyed by column position, so that headers that repeat stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scoring import let

# What headers and numbers look like, empty cells, and words of key metrics.
HEADER_WORDS = (
    r"^(date|period|year|quarter|month)$", r"^(revenue|sales|income|profit|loss)$", r"^(expense|cost|expenditure)$", r"^(asset|liability|equity)$", r"^(total|subtotal|net|gross)$",
    r"^(q[1-4]|fy\s*\d{2,4})$", r"^(actual|budget|forecast|variance)$", r"^(ytd|mtd|qtd)$", r"^(amount|value|balance)$", r"^(%|percent|ratio|margin)$",
)
NUMBER = r"^[\$€£¥₹]?\s*[\(\-]?\s*[\d,]+\.?\d*\s*[\)]?\s*[%MBKTmk]?$"
CURRENCY, PERCENT, DATE = r"[\$€£¥₹]", r"%\s*$", r"(?i)\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|Q[1-4]\s*\d{4}|FY\s*\d{4}"
EMPTY_CELLS = ("nan", "none", "null", "n/a", "na", "-", "--", "—")
KEY_WORDS = ("total", "net", "gross", "revenue", "income", "profit", "loss", "ebitda", "ebit", "margin", "growth", "ratio")
MIN_ROWS, MIN_COLUMNS, MIN_FILLED, ROWS_PER_CHUNK, CHUNK_CHARS = 2, 2, 0.1, 50, 1000

#: What to_numeric reads: no commas, signs of currency or type suffixes.
PLAIN_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"

TABLE = "table_id string, headers array<string>, rows array<array<string>>, caption string, table_index int"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_header(h: Column) -> Column:
    s = F.regexp_replace(_strip(F.coalesce(h, F.lit(""))), r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^[*#\-•]\s*", ""), r"(?U)\s*[*#]$", "")


def clean_cell(c: Column) -> Column:
    """Blank for what stands for nothing; whole floats without their fraction."""
    s = _strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s).isin(*EMPTY_CELLS), F.lit("")).otherwise(s)


def _share(cells: Column, test) -> Column:
    return F.try_divide(F.size(F.filter(cells, test)).cast("double"), F.size(cells))


def looks_like_data(headers: Column) -> Column:
    return F.coalesce(_share(headers, lambda h: h.rlike(NUMBER)) > 0.5, F.lit(False))


def looks_like_header(cells: Column) -> Column:
    known = _share(cells, lambda h: h.rlike("(?i)" + "|".join(HEADER_WORDS)))
    return F.coalesce((known > 0.3) | (_share(cells, lambda h: ~h.rlike(NUMBER)) > 0.7), F.lit(False))


def _headed(tables: DataFrame, detect_header: bool = True) -> DataFrame:
    """Clean headers, a first row that is the real header promoted; the rows are left as they are."""
    df = tables.withColumn("headers", F.transform("headers", clean_header)).withColumn("__first", F.transform(F.try_element_at("rows", F.lit(1)), clean_header))
    promote = F.lit(detect_header) & looks_like_data(F.col("headers")) & F.col("__first").isNotNull() & looks_like_header(F.col("__first"))
    df = df.withColumn("__promote", F.coalesce(promote, F.lit(False)))
    df = df.withColumn("headers", F.when(F.col("__promote"), F.col("__first")).otherwise(F.col("headers"))).withColumn("rows", F.when(F.col("__promote"), F.slice("rows", F.lit(2), F.greatest(F.lit(0), F.size("rows") - 1))).otherwise(F.col("rows")))
    width = F.coalesce(F.size(F.try_element_at("rows", F.lit(1))), F.lit(0))
    numbered = F.when(width > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), width)), lambda i: F.concat(F.lit("Column_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    blank = F.coalesce(F.forall("headers", lambda h: h == ""), F.lit(True))
    return df.withColumn("headers", F.when(blank, numbered).otherwise(F.col("headers"))).drop("__first", "__promote")


def _fit(row: Column) -> Column:
    """A row of clean cells, as wide as the headers."""
    n = F.size("headers")
    return F.slice(F.concat(F.transform(row, clean_cell), F.array_repeat(F.lit(""), n)), F.lit(1), n)


def normalized(tables: DataFrame, detect_header: bool = True) -> DataFrame:
    """Clean headers and cells; a first row that is the real header promoted; rows as wide as the headers."""
    return _headed(tables, detect_header).withColumn("rows", F.transform("rows", _fit))


def is_valid(headers: Column, rows: Column) -> Column:
    """2 rows, 2 columns, a tenth of the cells filled."""
    width = F.when(F.size(headers) > 0, F.size(headers)).otherwise(F.coalesce(F.size(F.try_element_at(rows, F.lit(1))), F.lit(0)))
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: F.coalesce(_strip(c) != "", F.lit(False))))
    return (F.size(rows) >= MIN_ROWS) & (width >= MIN_COLUMNS) & (filled >= F.size(cells) * MIN_FILLED)


def cells(tables: DataFrame) -> DataFrame:
    """table_id, row_idx, col_idx, header, value; cells beyond the headers are left out."""
    return _cells_of(tables.select("table_id", "headers", F.posexplode("rows").alias("row_idx", "row")))


def _cells_of(rows: DataFrame) -> DataFrame:
    long = rows.select("table_id", "headers", "row_idx", F.posexplode("row").alias("col_idx", "value"))
    return long.where(F.col("col_idx") < F.size("headers")).select("table_id", "row_idx", "col_idx", F.col("headers")[F.col("col_idx")].alias("header"), "value")


def to_plain_number(v: Column) -> Column:
    return F.when(v.rlike(PLAIN_NUMBER), _strip(v).try_cast("double"))


def column_types(cell_rows: DataFrame) -> DataFrame:
    """table_id, col_idx, header, type: a vote of the filled cells."""
    v = F.col("value")
    filled = F.coalesce(v != "", F.lit(False))
    share = lambda test: F.try_divide(F.sum(F.when(filled & test, 1.0).otherwise(0.0)), F.sum(filled.cast("double")))
    votes = cell_rows.groupBy("table_id", "col_idx", "header").agg(
        F.sum(filled.cast("long")).alias("n"), share(v.rlike(CURRENCY)).alias("currency"), share(v.rlike(PERCENT)).alias("percentage"), share(v.rlike(NUMBER)).alias("numeric"), share(v.rlike(DATE)).alias("date"),
    )
    kind = F.when(F.col("n") == 0, "empty").when(F.col("currency") > 0.5, "currency").when(F.col("percentage") > 0.5, "percentage").when(F.col("numeric") > 0.7, "numeric").when(F.col("date") > 0.5, "date").otherwise("text")
    return votes.select("table_id", "col_idx", "header", kind.alias("type"))


def profiles(cell_rows: DataFrame) -> DataFrame:
    """table_id, col_idx, header, type (numeric, text, empty), and min, max, mean, sum, count of numeric columns."""
    x = to_plain_number(F.col("value"))
    by = cell_rows.withColumn("x", x).groupBy("table_id", "col_idx", "header").agg(F.count("value").alias("cells"), F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.sum("x").alias("sum"))
    numeric = F.col("n") > F.col("cells") * 0.5
    kind = F.when(F.col("cells") == 0, "empty").when(numeric, "numeric").otherwise("text")
    return by.select("table_id", "col_idx", "header", kind.alias("type"), *[F.when(numeric, F.col(c)).alias(c) for c in ("min", "max", "mean", "sum")], F.when(numeric, F.col("n")).alias("count"))


def _keyword(name: Column) -> Column:
    """The first key word that a name holds."""
    return F.try_element_at(F.filter(F.array(*[F.lit(w) for w in KEY_WORDS]), lambda w: F.lower(name).contains(w)), F.lit(1))


def key_metrics(cell_rows: DataFrame) -> DataFrame:
    """table_id, metric, keyword, total, average (of numeric columns by name) or values (of rows by their label)."""
    columns = profiles(cell_rows)
    named = columns.where("type = 'numeric'").withColumn("keyword", _keyword(F.col("header"))).where("keyword is not null")
    by_name = named.select("table_id", F.col("header").alias("metric"), "keyword", F.col("sum").alias("total"), F.col("mean").alias("average"), F.lit(None).cast("array<struct<header:string,value:string>>").alias("values"))
    label = cell_rows.where("col_idx = 0").withColumn("keyword", _keyword(F.col("value"))).where("keyword is not null").select("table_id", "row_idx", F.col("value").alias("metric"), "keyword")
    text_first = columns.where("col_idx = 0 and type = 'text'").select("table_id")
    others = cell_rows.where("col_idx > 0 and value is not null").groupBy("table_id", "row_idx").agg(F.sort_array(F.collect_list(F.struct("col_idx", "header", "value"))).alias("v"))
    rows = label.join(text_first, "table_id", "left_semi").join(others, ["table_id", "row_idx"])
    none = F.lit(None).cast("double")
    by_row = rows.select("table_id", "metric", "keyword", none.alias("total"), none.alias("average"), F.transform("v", lambda x: F.struct(x["header"].alias("header"), x["value"].alias("value"))).alias("values"))
    return by_name.unionByName(by_row)


def markdown(headers: Column, rows: Column) -> Column:
    n = F.size(headers)
    line = lambda xs: F.concat(F.lit("| "), F.array_join(xs, " | "), F.lit(" |\n"))
    row = lambda r: line(F.slice(F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), n)), F.lit(1), n))
    whole = F.concat(line(F.transform(headers, lambda h: F.coalesce(h, F.lit("")))), line(F.array_repeat(F.lit("---"), n)), F.array_join(F.transform(rows, row), ""))
    return F.when((n > 0) & (F.size(rows) > 0), whole).otherwise(F.lit(""))


def row_text(headers: Column, row: Column, number: Column) -> Column:
    parts = F.filter(F.arrays_zip(headers.alias("h"), F.slice(row, F.lit(1), F.size(headers)).alias("v")), lambda x: F.coalesce(_strip(x["v"]) != "", F.lit(False)))
    lines = F.transform(parts, lambda x: F.concat(F.lit("  "), x["h"], F.lit(": "), x["v"]))
    return F.concat_ws("\n", F.concat(F.lit("Row "), number.cast("string"), F.lit(":")), lines)


def _money(c: Column) -> Column:
    return F.format_number(c, 2)


def table_chunks(tables: DataFrame) -> DataFrame:
    """All chunks of valid tables, normalised: table_id, part (schema, summary, metrics, full_data, partial_data, row), seq, content, chunk_type.

    A table is taken apart before its cells are cleaned, and no piece carries the whole of it.
    """
    t = _headed(tables.where(is_valid(F.col("headers"), F.col("rows"))))
    each = t.select("table_id", "headers", F.posexplode("rows").alias("row_idx", "row")).withColumn("row", _fit(F.col("row")))
    long = _cells_of(each)
    columns = profiles(long)
    named = t.select("table_id", F.coalesce(F.concat(F.lit("Table: "), "caption"), F.concat(F.lit("Table "), (F.col("table_index") + 1).cast("string"))).alias("title"), "caption", F.size("rows").alias("r"), F.size("headers").alias("c"))
    listed = columns.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col_idx", F.concat(F.lit("  - "), "header", F.lit(" ("), "type", F.lit(")")).alias("l")))).alias("l"))
    dims = F.concat(F.lit("Dimensions: "), F.col("r").cast("string"), F.lit(" rows × "), F.col("c").cast("string"), F.lit(" columns"))
    schema = named.join(listed, "table_id").select("table_id", F.lit("schema").alias("part"), F.lit(0).alias("seq"), F.concat_ws("\n", "title", dims, F.lit("\nColumns:"), F.transform("l", lambda x: x["l"])).alias("content"), F.lit("table").alias("chunk_type"))
    stat = F.concat(F.lit("\n"), F.col("header"), F.lit(":\n  - Sum: "), _money(F.col("sum")), F.lit("\n  - Average: "), _money(F.col("mean")), F.lit("\n  - Min: "), _money(F.col("min")), F.lit("\n  - Max: "), _money(F.col("max")))
    stats = columns.where("type = 'numeric'").groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col_idx", stat.alias("l")))).alias("l"))
    opening = F.coalesce(F.concat(F.lit("Summary Statistics for "), "caption", F.lit(":")), F.lit("Table Summary Statistics:"))
    summary = named.join(stats, "table_id").select("table_id", F.lit("summary").alias("part"), F.lit(0).alias("seq"), F.concat_ws("\n", opening, F.transform("l", lambda x: x["l"])).alias("content"), F.lit("table").alias("chunk_type"))
    of_column = F.concat(F.lit("\n"), "metric", F.lit(":\n  Total: "), _money(F.col("total")), F.lit("\n  Average: "), _money(F.col("average")))
    of_row = F.concat_ws("\n", F.concat(F.lit("\n"), "metric", F.lit(":")), F.transform("values", lambda v: F.concat(F.lit("  "), v["header"], F.lit(": "), v["value"])))
    found = key_metrics(long).groupBy("table_id").agg(F.sort_array(F.collect_list(F.when(F.col("values").isNull(), of_column).otherwise(of_row))).alias("l"))
    metrics = found.select("table_id", F.lit("metrics").alias("part"), F.lit(0).alias("seq"), F.concat_ws("\n", F.lit("Key Financial Metrics:"), "l").alias("content"), F.lit("financial_data").alias("chunk_type"))
    starts = lambda r: F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(r) - 1), F.lit(ROWS_PER_CHUNK))
    pieces = let(F.col("rows"), lambda r: F.transform(starts(r), lambda i: F.struct(F.size(r).alias("n"), i.alias("seq"), F.slice(r, i + 1, F.lit(ROWS_PER_CHUNK)).alias("some"))))
    batch = t.select("table_id", "headers", pieces.alias("pieces")).select("table_id", "headers", F.inline("pieces"))
    data = batch.select("table_id", F.when(F.col("n") <= ROWS_PER_CHUNK, "full_data").otherwise("partial_data").alias("part"), "seq", markdown(F.col("headers"), F.transform("some", _fit)).alias("content"), F.lit("table").alias("chunk_type"))
    single = each.select("table_id", F.lit("row").alias("part"), F.col("row_idx").alias("seq"), row_text(F.col("headers"), F.col("row"), F.col("row_idx") + 1).alias("content"), F.lit("table").alias("chunk_type"))
    out = schema
    for more in (summary, metrics, data, single):
        out = out.unionByName(more)
    return out


def live_chunks(tables: DataFrame, chunk_size: int = CHUNK_CHARS) -> DataFrame:
    """What ingestion writes for a table: its columns, and the whole table or, past chunk_size, each row; null cells as None."""
    head = F.concat_ws("\n", F.concat(F.lit("Sheet/Table: "), F.col("caption")), F.concat(F.lit("Table Columns: "), F.array_join("headers", ", ")))
    schema = tables.select("table_id", F.lit("schema").alias("part"), F.lit(0).alias("seq"), head.alias("content"))
    md = tables.withColumn("md", markdown(F.col("headers"), F.col("rows"))).where("md != ''")
    whole = md.where(F.length("md") <= chunk_size).select("table_id", F.lit("full_table").alias("part"), F.lit(0).alias("seq"), F.col("md").alias("content"))
    each = md.where(F.length("md") > chunk_size).select("table_id", "headers", F.posexplode("rows").alias("seq", "row"))
    pairs = F.zip_with("headers", F.slice("row", F.lit(1), F.size("headers")), lambda h, v: F.concat(h, F.lit(": "), F.coalesce(v, F.lit("None"))))
    kept = F.slice(pairs, F.lit(1), F.least(F.size("headers"), F.size("row")))
    rows = each.select("table_id", F.lit("row").alias("part"), "seq", F.array_join(kept, " | ").alias("content"))
    return schema.unionByName(whole).unionByName(rows)


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each header that both tables have with numbers: table1_sum, table2_sum, change, change_percent."""
    sums = lambda t, name: cells(t).withColumn("x", to_plain_number(F.col("value"))).groupBy("header").agg(F.sum("x").alias(name)).where(F.col(name).isNotNull())
    both = sums(left, "table1_sum").join(sums(right, "table2_sum"), "header")
    change = F.col("table2_sum") - F.col("table1_sum")
    percent = F.when(F.col("table1_sum") != 0, F.try_divide(change, F.abs("table1_sum")) * 100).when(F.col("table2_sum") == 0, 0.0).otherwise(F.lit(float("inf")))
    return both.select("header", "table1_sum", "table2_sum", change.alias("change"), percent.alias("change_percent"))


def numeric_summary(df: DataFrame) -> DataFrame:
    """column, mean, sum, min, max of each numeric column, in one pass; the sum of nothing is 0."""
    names = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, mean double, sum double, min double, max double")
    aggs = [x for i, c in enumerate(names) for x in (F.avg(c).cast("double").alias(f"mean{i}"), F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(f"sum{i}"), F.min(c).cast("double").alias(f"min{i}"), F.max(c).cast("double").alias(f"max{i}"))]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in ("mean", "sum", "min", "max")]) for i, c in enumerate(names)])
    return df.agg(*aggs).select(F.inline(rows))
