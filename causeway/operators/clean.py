"""Cleaning, reshaping and combining indicator files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import MONTH_DAYS, lookup, parse_number, unit_in_parens, without_parens

KEY = ("country", "state", "county", "source", "unit", "variable", "year", "month")


def normalize_strings(df: DataFrame, *columns: str) -> DataFrame:
    """Trims the columns."""
    return df.withColumns({c: F.trim(c) for c in columns})


def parse_numbers(df: DataFrame, column: str) -> DataFrame:
    """Numbers with thousands commas; rows that can't be read go."""
    return df.withColumn(column, parse_number(F.col(column))).na.drop(subset=[column])


def split_units(df: DataFrame, variable: str = "variable", unit: str = "unit") -> DataFrame:
    """Unit from parentheses in the variable's name, which loses them."""
    return df.withColumns({unit: F.coalesce(unit_in_parens(F.col(variable)), unit) if unit in df.columns else unit_in_parens(F.col(variable)), variable: without_parens(F.col(variable))})


def unit_overrides(df: DataFrame, units: Mapping[str, str], variable: str = "variable", unit: str = "unit") -> DataFrame:
    """Fixed units for listed variables."""
    return df.withColumn(unit, F.coalesce(lookup(F.col(variable), units), unit))


def rename_values(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """Listed values renamed, others kept."""
    return df.withColumn(column, F.coalesce(lookup(F.col(column), names), column))


def layout_rules(df: DataFrame, renames: Mapping[str, str], survey: str | None = None) -> DataFrame:
    """Renames the columns that are there; a survey column gives area (first word) and year (last)."""
    out = df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns})
    if survey and survey in out.columns:
        words = F.split(F.trim(survey), r"\s+")
        out = out.withColumns({"area": F.element_at(words, 1), "year": F.element_at(words, -1).try_cast("int")}).drop(survey)
    return out


def compose_variable(df: DataFrame, element: str, item: str, into: str = "variable") -> DataFrame:
    return df.withColumn(into, F.concat_ws(", ", element, item))


def drop_ranged(df: DataFrame, *columns: str) -> DataFrame:
    """Without rows whose year or month is a range."""
    return reduce(lambda d, c: d.where(~F.coalesce(F.col(c).cast("string").contains("-"), F.lit(False))), columns, df)


def expand_year_range(df: DataFrame, year: str = "year", value: str = "value") -> DataFrame:
    """A row for each year of '2010-2012'; a year with a row of its own keeps its value."""
    others = [c for c in df.columns if c not in (year, value)]
    ranged = F.col(year).contains("-")
    single = df.where(~ranged).withColumn(year, F.col(year).cast("int"))
    bounds = F.split(year, "-")
    spread = df.where(ranged).withColumn(year, F.explode(F.sequence(bounds[0].cast("int"), bounds[1].cast("int"))))
    s, r = single.alias("s"), spread.alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*others, year]])
    return single.select(*df.columns).union(r.join(s, on, "left_anti").select(*df.columns))


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def long_to_wide(df: DataFrame, ids: Sequence[str], pivot: str, values: Sequence, value: str = "value") -> DataFrame:
    """One column for each listed value, holding the mean."""
    return df.groupBy(*ids).pivot(pivot, list(values)).agg(F.avg(value))


def constant_columns(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in constants.items()})


def split_date(df: DataFrame, date: str, year: str = "year", month: str = "month") -> DataFrame:
    """Year and month of a y-m-d string."""
    d = F.try_to_timestamp(F.col(date).cast("string"))
    return df.withColumns({year: F.year(d), month: F.month(d)})


def range_filter(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def country_filter(df: DataFrame, countries: Sequence[str], column: str = "country") -> DataFrame:
    return df.where(F.col(column).isin(*countries))


def direction_coalesce(df: DataFrame, places: Sequence[str], incoming: str = "Incoming Migrants", variable: str = "variable") -> DataFrame:
    """Each place (country, state, ...) from destination_<place> for incoming variables, else from source_<place>.

    The two columns of a place become one. A null variable isn't incoming.
    """
    into = F.coalesce(F.col(variable) == incoming, F.lit(False))
    gone = [f"{end}_{p}" for p in places for end in ("source", "destination")]
    return df.withColumns({p: F.when(into, F.col(f"destination_{p}")).otherwise(F.col(f"source_{p}")) for p in places}).drop(*gone)


def end_or_start_date(df: DataFrame) -> DataFrame:
    """year and month from end_year and end_month; where the end has none (null, -1; 0), from the start's."""
    year = F.when(F.coalesce("end_year", F.lit(-1)) == -1, F.col("start_year")).otherwise(F.col("end_year"))
    month = F.when(F.coalesce("end_month", F.lit(0)) == 0, F.col("start_month")).otherwise(F.col("end_month"))
    return df.withColumns({"year": year, "month": month}).drop("start_year", "start_month", "end_year", "end_month")


def daily_to_monthly(df: DataFrame, unit: str = "unit", month: str = "month", value: str = "value") -> DataFrame:
    """Daily amounts times the month's days (February 28; month 0 counts 30)."""
    days = F.when(F.col(month).between(1, 12), F.element_at(F.array(*map(F.lit, MONTH_DAYS)), F.greatest(F.lit(1), F.least(F.lit(12), F.col(month))))).otherwise(30)
    return df.withColumns({value: F.when(F.col(unit) == "Daily", F.col(value) * days).otherwise(F.col(value)), unit: F.when(F.col(unit) == "Daily", F.lit("Monthly")).otherwise(F.col(unit))})


def percent_of_total(df: DataFrame, which: Column, total: float, value: str = "value") -> DataFrame:
    """Percentages of the rows `which` as shares of a constant total."""
    return df.withColumn(value, F.when(which, F.col(value) / 100 * total).otherwise(F.col(value)))


def redacted(df: DataFrame, column: str, stands_for: float | None = None) -> DataFrame:
    """'*' as null or the given number; the rest as numbers."""
    return df.withColumn(column, F.when(F.trim(column) == "*", F.lit(stands_for).cast("double")).otherwise(parse_number(F.col(column))))


def header_sections(df: DataFrame, file: str, line: str, label: str, cells: Sequence[str], into: str = "section") -> DataFrame:
    """Rows below a header row (all other cells empty) get its label; header rows go."""
    header = reduce(lambda a, b: a & b, [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in cells])
    last = F.last(F.when(header, F.col(label)), ignorenulls=True).over(Window.partitionBy(file).orderBy(line))
    return df.withColumns({into: last, "__header": header}).where("NOT __header").drop("__header")


def resolve_region(df: DataFrame, states: DataFrame, counties: DataFrame, region: str = "region") -> DataFrame:
    """state and county of a region: a state by name (any case), else a county with its first state.

    states: state. counties: county, state.
    """
    s = states.groupBy(F.lower("state").alias("__s")).agg(F.min("state").alias("__state"))
    c = counties.groupBy(F.lower("county").alias("__c")).agg(F.min("county").alias("__county"), F.min("state").alias("__of"))
    joined = df.join(s, F.lower(F.trim(region)) == F.col("__s"), "left").join(c, F.lower(F.trim(region)) == F.col("__c"), "left")
    return joined.select(*df.columns, F.coalesce("__state", "__of").alias("state"), F.when(F.col("__state").isNull(), F.coalesce("__county", region)).alias("county"))


def rename_groundings(df: DataFrame, column: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Path rewrites in the given order, then underscores for spaces."""
    name = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, F.col(column))
    return df.withColumn(column, F.translate(name, " ", "_"))


def position_year(df: DataFrame, partition: Sequence[str], order: Sequence[str], last: int, into: str = "year") -> DataFrame:
    """Years by row position, counted back from the last row's."""
    w = Window.partitionBy(*partition)
    return df.withColumn(into, last - F.count("*").over(w) + F.row_number().over(w.orderBy(*order)))


def combine_sources(*frames: DataFrame, value: str = "value") -> DataFrame:
    """All rows of frames with different columns, without those that lack a value."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).na.drop(subset=[value])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def dedup_by_key(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row for each key, with the smallest value."""
    return df.groupBy(*key).agg(F.min(value).alias(value))


def shared_names(a: DataFrame, b: DataFrame, column: str = "name") -> DataFrame:
    return a.select(column).intersect(b.select(column))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(name) and edges(src, dst) without gone(name), and the names of gone that aren't there."""
    left = nodes.join(gone, "name", "left_anti")
    kept = edges.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti")
    return left, kept.select("src", "dst"), gone.distinct().join(nodes, "name", "left_anti")


def remove_edges(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges without gone(src, dst), and those of gone that aren't there with the reason."""
    s, d, e = nodes.select(F.col("name").alias("src"), F.lit(True).alias("__s")), nodes.select(F.col("name").alias("dst"), F.lit(True).alias("__d")), edges.select("src", "dst", F.lit(True).alias("__e"))
    told = gone.distinct().join(s, "src", "left").join(d, "dst", "left").join(e, ["src", "dst"], "left")
    reason = F.when(F.col("__s").isNull(), "bad source").when(F.col("__d").isNull(), "bad target").when(F.col("__e").isNull(), "no edge")
    return edges.join(gone, ["src", "dst"], "left_anti"), told.select("src", "dst", reason.alias("reason")).where("reason IS NOT NULL")


def union_timestamps(df: DataFrame, column: str) -> DataFrame:
    """All time points with an observation."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()
