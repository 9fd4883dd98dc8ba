"""Periods of a statement's columns, where their own headers don't say all. ``keys`` name the statement (company, filing, statement)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import month_dash_year, month_end, month_in_date, says_to_date, settles_day_first

_BARE_YEAR = r"((?:19|20)\d{2})"


def _year_in(text: Column) -> Column:
    return F.regexp_extract(text, _BARE_YEAR, 1).try_cast("int")


def _in_order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("col")


def _whole(keys: list[str]):
    return _in_order(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def day_first(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Adds day_first: one column whose values settle the order of day and month settles it for the statement."""
    return columns.withColumn("day_first", F.first(settles_day_first(F.col("header")), ignorenulls=True).over(_whole(keys)))


def comparative_year(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Adds fixed: the second column of a pair that repeats the first one's header is last year's, if a later pair compares years."""
    w = _in_order(keys)
    twin = (F.col("col") % 2 == 1) & (F.lag("header").over(w) == F.col("header")) & (F.lag("months").over(w) == F.col("months"))
    compares = F.year(F.lead("end", 1).over(w)) == F.year(F.lead("end", 2).over(w)) + 1
    return columns.withColumn("fixed", F.when(F.coalesce(twin & compares, F.lit(False)), F.last_day(F.add_months("end", -12))).otherwise(F.col("end")))


def undate_percents(columns: DataFrame, keys: list[str]) -> DataFrame:
    """A % column that shares its period with a figure column loses its date."""
    percent = F.col("header").contains("%")
    shared = F.max(~percent).over(Window.partitionBy(*keys, "end", "months"))
    return columns.withColumn("end", F.when(percent & shared, F.lit(None)).otherwise(F.col("end")))


def default_span(columns: DataFrame, span: Column) -> DataFrame:
    """A span printed once above a flow statement's columns goes to dated ones without one, unless their header says year to date."""
    default = F.when(F.col("flow") & F.col("end").isNotNull() & ~says_to_date(F.col("header")), span)
    return columns.withColumn("months", F.coalesce("months", default))


def year_to_date_columns(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Columns headed YTD and a year: they end with the year's month that the latest quarter beside them ends in."""
    y = F.when(says_to_date(F.col("header")) & F.col("header").rlike(_BARE_YEAR + r"\s*$"), _year_in(F.col("header")))
    latest = F.max(F.when(F.col("months") == 3, F.col("end"))).over(_whole(keys))
    found = columns.withColumn("y", y).withColumn("latest", latest).where("y is not null")
    return found.withColumns({"months": F.month("latest"), "end": month_end(F.col("y"), F.month("latest"))}).drop("y", "latest")


def flow_dates(columns: DataFrame, fiscal_start: Column) -> DataFrame:
    """Columns of a flow statement that are a date alone: a year to date from the fiscal year's first month."""
    return columns.where("flow and months is null and end is not null").withColumn("months", F.pmod(F.month("end") - fiscal_start, F.lit(12)) + 1)


def fiscal_start(columns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_month: the fiscal year's first month, from the first column of more than three months."""
    long_ = F.col("months") > 3
    return columns.groupBy(*keys).agg(F.min_by(F.pmod(F.month("end") - F.col("months"), F.lit(12)) + 1, F.when(long_, F.col("col"))).alias("start_month"))


def unstack(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Adds pos; a column that repeats header and end of the one before it goes."""
    w = _in_order(keys)
    again = F.struct("header", "end").eqNullSafe(F.lag(F.struct("header", "end")).over(w))
    return columns.withColumn("again", again).where("not again").drop("again").withColumn("pos", F.row_number().over(w) - 1)


def title_dates(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Adds months and end: if every header is a bare year, the month comes from the statement's title."""
    bare = F.min(F.col("header").rlike(rf"^{_BARE_YEAR}$")).over(Window.partitionBy(*keys))
    month = month_in_date(F.col("title"))
    df = columns.withColumn("bare", bare).withColumn("m", month)
    return df.withColumns({"months": F.when(F.col("bare") & F.col("flow"), F.col("m")), "end": F.when(F.col("bare"), month_end(F.col("header").try_cast("int"), F.col("m")))}).drop("bare", "m")


def pipe_headers(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, header: stacked header rows (line, text) of the widest kind, joined cell by cell."""
    rows = lines.withColumn("cells", F.split("text", r"\s*\|\s*")).withColumn("width", F.size("cells"))
    wide = rows.withColumn("most", F.max("width").over(Window.partitionBy(*keys))).where("width = most and most > 1")
    cells = wide.select(*keys, "line", F.posexplode("cells").alias("pos", "cell"))
    return cells.groupBy(*keys, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "cell"))), lambda x: x["cell"]), " ").alias("header"))


def cut_line(line: Column) -> Column:
    """The headers of a line like 'Particulars Jun-26 Mar-26 Growth': its dates, and what follows the last one."""
    dates = F.regexp_extract_all(line, F.lit(month_dash_year()), F.lit(0))
    tail = F.trim(F.regexp_extract(line, rf".*{month_dash_year()}(.*)$", 1))
    return F.concat(dates, F.when(tail != "", F.array(tail)).otherwise(F.array().cast("array<string>")))


def cover_period(columns: DataFrame, cover: DataFrame, filing: list[str]) -> DataFrame:
    """Undated columns take their filing's cover period if the cover names one only; another year in the header moves it there."""
    one = cover.groupBy(*filing).agg(F.countDistinct("end").alias("ends"), F.max("end").alias("cover")).where("ends = 1").drop("ends")
    df = columns.join(one, filing, "left")
    y = F.coalesce(_year_in(F.col("header")), F.year("cover"))
    fixed = {"end": F.coalesce("end", month_end(y, F.month("cover"))), "months": F.coalesce("months", F.when(says_to_date(F.col("header")), F.month("cover")))}
    return df.withColumns(fixed).drop("cover")


def group_labels(columns: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col, header: band labels lost from a statement's columns come back from its anchor's labels if all years agree."""
    cols = columns.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "header"))), lambda x: x["header"]).alias("headers"))
    df = cols.join(anchors, keys, "left")
    agree = (F.size("headers") == F.size("labels")) & F.forall(F.zip_with("headers", "labels", lambda h, a: _year_in(h) == _year_in(a)), lambda b: b)
    return df.select(*keys, F.posexplode(F.when(agree, F.col("labels")).otherwise(F.col("headers"))).alias("col", "header"))


def note_periods(notes: DataFrame, primary: DataFrame, filing: list[str]) -> DataFrame:
    """Adds months and end to undated columns of flow notes: the income statement's period of the same year, the first one printed."""
    first = primary.groupBy(*filing, F.year("end").alias("y")).agg(F.min_by(F.struct("months", "end"), "col").alias("p"))
    return notes.withColumn("y", F.col("header").try_cast("int")).join(first, [*filing, "y"], "left").withColumns({"months": F.col("p.months"), "end": F.col("p.end")}).drop("y", "p")


def spans_by_end(columns: DataFrame, filing: list[str]) -> DataFrame:
    """filing, end, months: the longest span that any statement has for an end."""
    return columns.where("months is not null").groupBy(*filing, "end").agg(F.max("months").alias("months"))


def segment_spans(columns: DataFrame, filing: list[str]) -> DataFrame:
    """Dated columns without a span take the longest of their filing for that end."""
    spans = spans_by_end(columns, filing).withColumnRenamed("months", "span")
    return columns.join(spans, [*filing, "end"], "left").withColumn("months", F.coalesce("months", "span")).drop("span")


def split_tables(tables: DataFrame, filing: list[str], back: int = 3) -> DataFrame:
    """tables(page, ord, k, ends): one without headers takes the last k dates of the nearest earlier table, at most ``back`` tables and one page back."""
    w = Window.partitionBy(*filing).orderBy("ord").rangeBetween(-back, -1)
    near = F.last(F.when(F.col("ends").isNotNull(), F.struct("page", "ends")), ignorenulls=True).over(w)
    df = tables.withColumn("near", near)
    fits = F.col("near.page") >= F.col("page") - 1
    tail = F.slice("near.ends", F.size("near.ends") - F.col("k") + 1, F.col("k"))
    return df.withColumn("ends", F.coalesce("ends", F.when(fits, tail))).drop("near")
